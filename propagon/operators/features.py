"""Feature tables of windows and users, and profiles of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 8


def _over_one(a: Column, b: Column) -> Column:
    """a by b, where b counts 1 at least."""
    return a / F.greatest(b, F.lit(1.0))


def _rounded(values: dict[str, Column]) -> list[Column]:
    return [F.round(v.cast("double"), DIGITS).alias(k) for k, v in values.items()]


def window_features(multi: DataFrame) -> DataFrame:
    """Counts of every window and scope; heat is the number of reposts."""
    counts = [f"{k}_{s}" for k in ("num_retweets", "num_active_users") for s in ("cur", "ctx", "cum")] + ["num_edges_cur", "num_edges_ctx"]
    heat = [F.col(f"num_retweets_{s}").cast("double").alias(f"heat_{s}") for s in ("cur", "ctx", "cum")]
    return multi.select("cascade_idx", "window_idx", *counts, *heat, F.col("delta_heat").cast("double").alias("delta_heat_cur"))


def window_features_v2(multi: DataFrame) -> DataFrame:
    """``window_features`` with growth, density and ratios against the window before."""
    w = Window.partitionBy("cascade_idx")
    before = lambda k: F.lag(k, 1, 0.0).over(w.orderBy("window_idx"))
    f = window_features(multi).withColumn("last", F.count("*").over(w)).withColumn("active", F.col("num_active_users_cur").cast("double"))
    f = f.withColumns({"heat0": before("heat_cur"), "delta0": before("delta_heat_cur"), "active0": before("active")})
    density = lambda s: F.col(f"num_edges_{s}") / F.greatest(F.col(f"num_active_users_{s}") * F.greatest(F.col(f"num_active_users_{s}") - 1, F.lit(1.0)), F.lit(1.0))
    a, h, d = F.col("active"), F.col("heat_cur"), F.col("delta_heat_cur")
    derived = {
        "window_position_norm": _over_one(F.col("window_idx") - 1, F.col("last") - 1.0), "retweet_growth_rate": _over_one(d, F.col("heat0")), "retweet_acceleration": d - F.col("delta0"),
        "active_user_growth_rate": _over_one(a - F.col("active0"), F.col("active0")), "active_user_ratio": _over_one(a, F.col("num_active_users_cum")), "edge_density_cur": density("cur"), "edge_density_ctx": density("ctx"),
        "edge_density_gap": density("cur") - density("ctx"), "heat_per_user_cur": _over_one(h, a), "heat_per_edge_cur": _over_one(h, F.col("num_edges_cur")), "burstiness_ratio": _over_one(d, h), "active_span_ratio": _over_one(a, F.col("num_retweets_cum")),
    }
    return f.select(*window_features(multi).columns, *_rounded(derived))


def node_features(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``nodes`` with the texts of each user that are visible in the window, all and those that are no root."""
    repost = F.col("text_visible_type") != "root_always_visible"
    t = texts.groupBy("cascade_idx", "window_idx", "user_idx").agg(F.count_if(repost).alias("num_texts_cur"), F.count("*").alias("num_texts_visible"), *_rounded({"avg_text_len_cur": F.avg(F.when(repost, F.col("text_length"))), "avg_text_len_visible": F.avg("text_length")}))
    return nodes.join(t, ["cascade_idx", "window_idx", "user_idx"], "left").na.fill(0)


def node_features_v2(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Growth, balances and shares of the window and of the cascade (all its windows, later ones included), and the columns of
    ``nodes`` named by ``keep``."""
    by_user, cw, c = Window.partitionBy("cascade_idx", "user_idx").orderBy("window_idx"), Window.partitionBy("cascade_idx", "window_idx"), Window.partitionBy("cascade_idx")
    deg = {s: (F.col(f"in_degree_{s}") + F.col(f"out_degree_{s}")).cast("double") for s in ("cur", "ctx", "cum")}
    posts = {s: F.col(f"num_posts_{s}").cast("double") for s in ("cur", "ctx", "cum")}
    x = nodes.withColumns({"posts_w": F.sum("num_posts_cur").over(cw), "degree_w": F.sum(deg["cur"]).over(cw), "active_w": F.count_if(F.col("num_posts_cur") > 0).over(cw), "posts_c": F.sum("num_posts_cum").over(c), "degree_c": F.sum(deg["cum"]).over(c), "windows": F.max("window_idx").over(c).cast("double"), "posts0": F.lag("num_posts_cur", 1, 0).over(by_user)})
    seen, since = F.col("first_seen_time").cast("double"), F.col("time_since_first_seen").cast("double")
    balance = {f"degree_balance_{s}": F.col(f"out_degree_{s}") - F.col(f"in_degree_{s}") for s in ("cur", "ctx", "cum")}
    share = _over_one(posts["cur"], F.col("posts_w"))
    derived = {
        "num_posts_delta_cur": posts["cur"] - posts["ctx"], "num_posts_growth_rate": _over_one(posts["cur"] - posts["ctx"], posts["ctx"]), **balance, "degree_growth_rate": _over_one(deg["cur"] - deg["ctx"], deg["ctx"]), "active_window_ratio": _over_one(F.col("active_window_count"), F.col("windows")),
        "activity_intensity": _over_one(posts["cur"], since + 1), "first_seen_norm": _over_one(seen, seen + since), "time_since_first_seen_norm": _over_one(since, seen + since), "window_position_norm": _over_one(F.col("window_idx") - 1, F.col("windows") - 1),
        "same_window_active_share": F.when(posts["cur"] > 0, _over_one(F.lit(1.0), F.col("active_w"))).otherwise(0.0), "same_window_post_share": share, "node_contribution_share_cur": share, "node_contribution_share_cum": _over_one(posts["cum"], F.col("posts_c")),
        "node_degree_share_cur": _over_one(deg["cur"], F.col("degree_w")), "node_degree_share_cum": _over_one(deg["cum"], F.col("degree_c")),
    }
    again = (F.col("num_posts_cur") > 0) & (F.col("posts0") <= 0) & (F.col("num_posts_cum") > F.col("num_posts_cur"))
    return x.select("cascade_idx", "window_idx", "user_idx", *keep, *_rounded(derived), again.cast("int").alias("reactivation_flag"))


#: Columns of a node in a pack that are no text and no tree column and not derived, text columns, tree columns.
NODE_BASE = ("is_root", "first_seen_time", "time_since_first_seen", *(f"{k}_{s}" for k in ("num_posts", "in_degree", "out_degree") for s in ("cur", "ctx", "cum")), "active_window_count")
NODE_TEXT = ("num_texts_cur", "num_texts_visible", "avg_text_len_cur", "avg_text_len_visible")
TREE = ("depth", "parent_time_gap", "parent_score", "time_score", "text_score", "activity_score", "depth_penalty", "load_penalty", "root_fallback_flag")


def with_tree_columns(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """``nodes`` with TREE of (cascade_idx, user_idx, *TREE) and has_tree_feature; all 0 for a user without a row there."""
    t = tree.select("cascade_idx", "user_idx", *TREE, F.lit(1).alias("has_tree_feature"))
    return nodes.join(t, ["cascade_idx", "user_idx"], "left").na.fill(0, ["has_tree_feature", *TREE])


def full_node_features(nodes: DataFrame, texts: DataFrame, tree: DataFrame) -> DataFrame:
    """All columns of a node: counts, texts, derived columns, the share and the length of its texts, and TREE.

    Without rows in ``texts`` the text columns are 0.
    """
    x = node_features_v2(node_features(nodes, texts), NODE_BASE + NODE_TEXT)
    x = x.withColumns({"text_visibility_ratio": F.round(_over_one(F.col("num_texts_visible"), F.col("num_posts_cum")), DIGITS), "text_length_gap": F.round(F.col("avg_text_len_visible") - F.col("avg_text_len_cur"), DIGITS)})
    return with_tree_columns(x, tree)


def edge_counts(edge_windows: DataFrame, kind: str) -> DataFrame:
    """Per cascade and window: edges, those whose ``kind`` names a follow, and those of each scope (a blank one is current)."""
    scope = F.coalesce(F.nullif(F.col("window_scope"), F.lit("")), F.lit("current"))
    follow = F.lower(F.coalesce(F.col(kind), F.lit(""))).contains("follow")
    return edge_windows.groupBy("cascade_idx", "window_idx").agg(F.count("*").alias("edge_count"), F.count_if(follow).alias("follow_edge_count"), *(F.count_if(scope == s).alias(f"{s}_edge_count") for s in ("current", "context")))


def edge_scopes(edge_windows: DataFrame) -> DataFrame:
    """Rows of each scope; a blank scope is the current one."""
    scope = F.coalesce(F.nullif(F.col("window_scope"), F.lit("")), F.lit("current"))
    return edge_windows.groupBy(scope.alias("window_scope")).agg(F.count("*").alias("edges"))


def profile(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per column: rows, missing, NaN and infinite values, mean, population deviation, least and largest of the finite ones, and
    whether all are zero."""
    flat = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("v")) for k in names))).alias("x")).select("x.*")
    v = F.col("v")
    infinite = F.abs(v) == float("inf")
    good = F.when(v.isNotNull() & ~F.isnan(v) & ~infinite, v)
    return flat.groupBy("feature").agg(F.count("*").alias("rows"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.isnan(v)).alias("nan"), F.count_if(infinite).alias("inf"), F.round(F.avg(good), 6).alias("mean"), F.round(F.stddev_pop(good), 6).alias("std"), F.min(good).alias("min"), F.max(good).alias("max"), (F.count_if(good != 0) == 0).cast("int").alias("all_zero"))

"""Causal window tables: counts per cascade and window, panels of users, edges and texts.

Times go to buckets of one step; a bucket is joined to the windows it feeds by number, so no range join is needed.
Bucket 0 holds negative times, which count for cumulative scopes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVATION, STEP, CONTEXT = 1800, 300, 600


def bucket(rel: Column, step: int = STEP) -> Column:
    return F.when(rel < 0, 0).otherwise(F.floor(rel / step) + 1).cast("long")


def grid(cascades: DataFrame, obs: int = OBSERVATION, step: int = STEP) -> DataFrame:
    """Every cascade with the windows 1 .. T that end at multiples of the step."""
    w = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(obs // step).cast("long"))).alias("window_idx")
    return cascades.select("cascade_idx").distinct().select("cascade_idx", w).withColumn("end_time", F.col("window_idx") * step)


def fed(rows: DataFrame, keys: list[str], obs: int = OBSERVATION, step: int = STEP, context: int = CONTEXT) -> DataFrame:
    """(keys, window_idx, scope) of every row: its own window (cur), those whose context holds it (ctx), all later (cum)."""
    last, back = obs // step, context // step
    b = rows.withColumn("b", bucket(F.col("relative_time"), step)).where(F.col("b") <= last)
    own = F.when(F.col("b") >= 1, F.array(F.struct(F.lit("cur").alias("scope"), F.col("b").alias("window_idx")))).otherwise(F.array().cast("array<struct<scope:string,window_idx:bigint>>"))
    ctx = F.when(F.col("b") >= 1, F.transform(F.sequence(F.col("b"), F.least(F.col("b") + back - 1, F.lit(last).cast("long"))), lambda w: F.struct(F.lit("ctx").alias("scope"), w.alias("window_idx")))).otherwise(F.array().cast("array<struct<scope:string,window_idx:bigint>>"))
    cum = F.transform(F.sequence(F.greatest(F.col("b"), F.lit(1).cast("long")), F.lit(last).cast("long")), lambda w: F.struct(F.lit("cum").alias("scope"), w.alias("window_idx")))
    return b.select(*keys, F.explode(F.concat(own, ctx, cum)).alias("x")).select(*keys, "x.*")


def _up_to(values: dict[str, Column], last: int) -> list[Column]:
    """Sums of each value up to every bucket: name_0 .. name_last, from one aggregate and without a row a window."""
    return [F.sum(F.when(F.col("b") <= k, v).otherwise(0)).alias(f"{name}_{k}") for name, v in values.items() for k in range(last + 1)]


def _scopes(name: str, out: str, w: int, back: int) -> list[Column]:
    """Sums of a value in the current, context and cumulative scope of window w, as differences of sums up to buckets."""
    to = lambda k: F.col(f"{name}_{k}")
    return [(to(w) - to(w - 1)).alias(f"{out}_cur"), (to(w) - to(max(w - back, 0))).alias(f"{out}_ctx"), to(w).alias(f"{out}_cum")]


def multiscale_windows(posts: DataFrame, edges: DataFrame, obs: int = OBSERVATION, step: int = STEP, context: int = CONTEXT) -> DataFrame:
    """Reposts, active users and edges of each window in the current, context and cumulative scope, and the step's growth.

    Reposts are counted by user and bucket first; a user is active in a scope where its count there is above 0.
    """
    last, back = obs // step, context // step
    b = bucket(F.col("relative_time"), step)
    p = posts.where("is_root = 0").withColumn("b", b).where(F.col("b") <= last)
    users = p.groupBy("cascade_idx", "user_idx").agg(*_up_to({"n": F.lit(1)}, last))
    n = users.groupBy("cascade_idx").agg(*(F.sum(f"n_{k}").alias(f"n_{k}") for k in range(last + 1)), *(F.count_if(c > 0).alias(f"u{w}_{c_name}") for w in range(1, last + 1) for c_name, c in zip(("cur", "ctx", "cum"), _scopes("n", "n", w, back), strict=True)))
    m = edges.withColumn("b", b).where(F.col("b") <= last).groupBy("cascade_idx").agg(*_up_to({"e": F.lit(1)}, last))
    g = posts.select("cascade_idx").distinct().join(n, "cascade_idx", "left").join(m, "cascade_idx", "left").na.fill(0)
    heat = lambda w: F.col(f"n_{w}") - F.col(f"n_{w - 1}")
    each = [
        F.struct(F.lit(w).cast("long").alias("window_idx"), F.lit(w * step).cast("long").alias("end_time"), *_scopes("n", "num_retweets", w, back), *(F.col(f"u{w}_{s}").alias(f"num_active_users_{s}") for s in ("cur", "ctx", "cum")), *_scopes("e", "num_edges", w, back), (heat(w) - heat(w - 1) if w > 1 else heat(w)).alias("delta_heat"))
        for w in range(1, last + 1)
    ]
    return g.select("cascade_idx", F.inline(F.array(*each)))


def fixed_windows(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of half-open windows of one step, cumulative reposts and growth; windows are full ones only."""
    w = multiscale_windows(posts, edges)
    return w.select("cascade_idx", "window_idx", (F.col("end_time") - STEP).alias("start_time"), "end_time", F.col("num_retweets_cur").alias("num_retweets"), F.col("num_retweets_cum").alias("cum_retweets"), F.col("num_active_users_cur").alias("num_active_users"), F.col("num_edges_cur").alias("num_edges"), "delta_heat")


def node_windows(posts: DataFrame, edges: DataFrame, obs: int = OBSERVATION, step: int = STEP, context: int = CONTEXT, texts: bool = False, users: DataFrame | None = None) -> DataFrame:
    """Every user from the window first seen on: posts and degrees per scope, time since then, windows with posts or edges so
    far, and whether the user has a root.

    With ``texts`` also num_texts_visible of ``text_stats``, and with ``users`` its columns by (cascade_idx, user_idx): both join
    while a user is one row, so that no window goes through a join.
    """
    ends = edges.select("cascade_idx", F.col("src").alias("user_idx"), "relative_time", F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select("cascade_idx", F.col("dst").alias("user_idx"), "relative_time", F.lit(1).alias("i"), F.lit(0).alias("o")))
    act = posts.select("cascade_idx", "user_idx", "relative_time", F.lit(1).alias("p"), F.lit(0).alias("i"), F.lit(0).alias("o"), "is_root").unionByName(ends.withColumn("p", F.lit(0)).withColumn("is_root", F.lit(0)))
    last, back = obs // step, context // step
    act = act.withColumn("b", bucket(F.col("relative_time"), step))
    # one row a user; what comes after the last window counts in no bucket
    shown = [F.sum(F.when((F.col("is_root") == 1) | (F.col("b") <= k), F.col("p")).otherwise(0)).alias(f"t_{k}") for k in range(1, last + 1)] if texts else []
    n = act.groupBy("cascade_idx", "user_idx").agg(F.min("relative_time").alias("first_seen_time"), F.max("is_root").alias("is_root"), *_up_to({k: F.col(k) for k in "pio"}, last), *shown)
    more = [k for k in users.columns if k not in ("cascade_idx", "user_idx")] if users is not None else []
    n = n.join(users, ["cascade_idx", "user_idx"], "left") if more else n
    n = n.join(posts.select("cascade_idx").distinct(), "cascade_idx", "left_semi")
    active = [(sum((F.col(f"{k}_{w}") - F.col(f"{k}_{w - 1}") for k in "pio"), F.lit(0)) > 0).cast("long") for w in range(1, last + 1)]
    each = [F.struct(F.lit(w).cast("long").alias("window_idx"), *_scopes("p", "num_posts", w, back), *_scopes("i", "in_degree", w, back), *_scopes("o", "out_degree", w, back), (F.lit(w * step) - F.col("first_seen_time")).alias("time_since_first_seen"), sum(active[:w], F.lit(0).cast("long")).alias("active_window_count"), *([F.col(f"t_{w}").alias("num_texts_visible")] if texts else [])) for w in range(1, last + 1)]
    more += ["num_texts_visible"] if texts else []
    return n.select("cascade_idx", "user_idx", "first_seen_time", "is_root", *more[: len(more) - texts], F.inline(F.array(*each))).where("time_since_first_seen > 0").select("cascade_idx", "window_idx", "user_idx", "first_seen_time", "is_root", *(f"{k}_{s}" for k in ("num_posts", "in_degree", "out_degree") for s in ("cur", "ctx", "cum")), "time_since_first_seen", "active_window_count", *more)


def fixed_node_windows(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """The panel of users over windows of one step, with counts of the window and up to its end."""
    names = {"num_posts_cur": "num_posts_in_window", "num_posts_cum": "cum_posts", "in_degree_cur": "in_degree_window", "out_degree_cur": "out_degree_window", "in_degree_cum": "cum_in_degree", "out_degree_cum": "cum_out_degree"}
    return node_windows(posts, edges).select("cascade_idx", "window_idx", "user_idx", "is_root", "first_seen_time", *(F.col(k).alias(v) for k, v in names.items()), "time_since_first_seen")


def edge_windows(edges: DataFrame) -> DataFrame:
    """Each edge in the windows whose current or context scope holds it."""
    e = fed(edges, ["cascade_idx", "src", "dst", "dst_tweet"]).where("scope <> 'cum'")
    return e.withColumn("window_scope", F.when(F.col("scope") == "cur", "current").otherwise("context")).drop("scope")


def text_windows(posts: DataFrame) -> DataFrame:
    """Texts visible at each window's end: roots always, reposts that came before it. Only visible windows are made."""
    last = OBSERVATION // STEP
    first = F.when(F.col("is_root") == 1, 1).otherwise(F.greatest(bucket(F.col("relative_time")), F.lit(1))).cast("long")
    g = posts.where(first <= last).withColumn("window_idx", F.explode(F.sequence(first, F.lit(last).cast("long")))).withColumn("end_time", F.col("window_idx") * STEP)
    kind = F.when(F.col("is_root") == 1, "root_always_visible").when(F.col("relative_time") >= F.col("end_time") - STEP, "current_window").otherwise("history_visible")
    return g.select("cascade_idx", "window_idx", "tweet_idx", "user_idx", "relative_time", kind.alias("text_visible_type"), F.length("text").cast("long").alias("text_length"))


def text_stats(texts: DataFrame) -> DataFrame:
    """Visible texts of each user and window: number, non-root number and mean length."""
    return texts.groupBy("cascade_idx", "window_idx", "user_idx").agg(F.count("*").alias("num_texts_visible"), F.count_if(F.col("text_visible_type") != "root_always_visible").alias("num_texts_cur"), F.round(F.avg("text_length"), 6).alias("avg_text_length"))


def window_diagnostics(windows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of each table, windows without reposts, texts shown before they exist."""
    early = texts.where("text_visible_type <> 'root_always_visible'").agg(F.count_if(F.col("relative_time") >= F.col("window_idx") * STEP).alias("early_texts"), F.count("*").alias("repost_texts"))
    return windows.agg(F.count("*").alias("windows"), F.count_if(F.col("num_retweets_cur") == 0).alias("empty_windows")).crossJoin(nodes.agg(F.count("*").alias("node_rows"))).crossJoin(early)

"""Evidence on users and windows of a cascade without its texts: behaviour, time, structure, coordination, relations.

``nodes`` is a panel of users with the columns of ``windows.node_windows``, num_texts_cur, num_texts_visible and those of
``with_tree``. Totals of a window are aggregated and joined, so that a window of many users is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propagon.operators.components import grouped_components
from propagon.operators.coordination import coordination, links
from propagon.sources.shared import written

KEYS = ["cascade_idx", "window_idx"]
ID = [*KEYS, "user_idx"]
#: Seconds of a time bin, bounds of early and late windows.
BIN_SECONDS, EARLY, LATE = 60, 0.33, 0.67
DIGITS = 8


def log1p_pos(c: Column) -> Column:
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0))


def _made(rows: DataFrame, ids: list[str], values: dict[str, Column]) -> DataFrame:
    return rows.select(*ids, *(F.round(v.cast("double"), DIGITS).alias(k) for k, v in values.items()))


def with_tree(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """``nodes`` with depth (greatest), parent_time_gap and parent_score (means) of each user's posts in the tree, 0 without
    one; ``tree`` (cascade_idx, user_idx, depth, time_gap, parent_score)."""
    t = tree.groupBy("cascade_idx", "user_idx").agg(F.max("depth").alias("depth"), F.round(F.avg("time_gap"), DIGITS).alias("parent_time_gap"), F.round(F.avg("parent_score"), DIGITS).alias("parent_score"), F.lit(1).alias("has_tree_feature"))
    return nodes.join(t, ["cascade_idx", "user_idx"], "left").na.fill(0, ["depth", "parent_time_gap", "parent_score", "has_tree_feature"])


def _parts(nodes: DataFrame) -> DataFrame:
    deg = {s: F.col(f"in_degree_{s}") + F.col(f"out_degree_{s}") for s in ("cur", "ctx", "cum")}
    seen = F.col("first_seen_time") + F.col("time_since_first_seen")
    return nodes.withColumns({"active": (F.col("num_posts_cur") > 0).cast("int"), "bin": F.floor(seen / BIN_SECONDS), "denom": F.greatest(seen, F.lit(1)), **{f"deg_{s}": v for s, v in deg.items()}})


def _with_totals(x: DataFrame, **totals: Column) -> DataFrame:
    return x.join(x.groupBy(*KEYS).agg(*(v.alias(k) for k, v in totals.items())), KEYS)


def behaviour(nodes: DataFrame) -> DataFrame:
    """Posts, texts and activity of each user, their shares of the window, and returns after a pause."""
    x = _with_totals(_parts(nodes), pm=F.sum("num_posts_cur"), cm=F.sum("num_posts_cum"))
    last = F.lag("num_posts_cur", 1, 0).over(Window.partitionBy("cascade_idx", "user_idx").orderBy("window_idx"))
    w = F.col("window_idx")
    return _made(x.withColumn("last", last), ID, {
        "beh_active_cur": F.col("active"), "beh_posts_cur_log": log1p_pos(F.col("num_posts_cur")), "beh_posts_cum_log": log1p_pos(F.col("num_posts_cum")), "beh_visible_texts_cur_log": log1p_pos(F.col("num_texts_cur")), "beh_visible_texts_cum_log": log1p_pos(F.col("num_texts_visible")),
        "beh_contribution_share_cur": safe_div(F.col("num_posts_cur"), F.col("pm")), "beh_contribution_share_cum": safe_div(F.col("num_posts_cum"), F.col("cm")), "beh_active_window_count_log": log1p_pos(F.col("active_window_count")), "beh_active_window_ratio": F.col("active_window_count") / (w + 1),
        "beh_first_seen_norm": clamp01(F.col("first_seen_time") / F.col("denom")), "beh_time_since_first_seen_norm": clamp01(F.col("time_since_first_seen") / F.col("denom")), "beh_window_reactivation": ((F.col("active") == 1) & (F.col("last") <= 0) & (w > 0)).cast("int"),
    })


def timing(nodes: DataFrame, windows: DataFrame) -> DataFrame:
    """Place of the window, change of activity, and users who act in the same bin."""
    x = _parts(nodes)
    same = x.where("active = 1").groupBy(*KEYS, "bin").agg(F.count("*").alias("same"))
    actives = x.groupBy(*KEYS).agg(F.greatest(F.sum("active"), F.lit(1)).alias("actives"))
    most = windows.groupBy("cascade_idx").agg(F.greatest(F.max("window_idx"), F.lit(1)).alias("most"))
    by = Window.partitionBy("cascade_idx", "user_idx").orderBy("window_idx")
    x = x.join(same, [*KEYS, "bin"], "left").join(actives, KEYS).join(most, "cascade_idx", "left").na.fill(0, ["same"]).na.fill(1, ["most"])
    x = x.withColumn("delta", F.col("num_posts_cur") - F.lag("num_posts_cur", 1, 0).over(by)).withColumn("acc", F.col("delta") - F.lag("delta", 1, 0).over(by))
    pos, share = F.col("window_idx") / F.col("most"), F.col("same") / F.col("actives")
    return _made(x, ID, {
        "tmp_window_pos": pos, "tmp_first_seen_window_norm": clamp01(F.col("first_seen_time") / F.col("denom")), "tmp_time_since_first_seen_norm": clamp01(F.col("time_since_first_seen") / F.col("denom")), "tmp_is_early_participant": (pos <= EARLY).cast("int"), "tmp_is_late_participant": (pos >= LATE).cast("int"),
        "tmp_activity_delta": F.col("delta"), "tmp_activity_acceleration": F.col("acc"), "tmp_same_bin_user_count_log": log1p_pos(F.col("same")), "tmp_same_bin_user_share": share, "tmp_nearest_event_gap_norm": clamp01(F.col("parent_time_gap") / F.greatest(F.col("time_since_first_seen"), F.lit(1))), "tmp_burst_bin_rank": share, "tmp_temporal_sync_score": share,
    })


def local_clustering(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, user_idx, clustering) of every end of an edge: linked pairs of neighbours by all pairs. A user with a self loop
    is its own neighbour, linked with all others."""
    e = edges.select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    pairs = e.where("u <> v")
    both = pairs.union(pairs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    deg = both.groupBy(*keys, "u").agg(F.count("*").alias("k"))
    # edges point to the end with more neighbours, so that a busy user starts few wedges
    ku, kv = deg.withColumnRenamed("k", "ku"), deg.withColumnsRenamed({"u": "v", "k": "kv"})
    up = F.struct("ku", "u") < F.struct("kv", "v")
    o = pairs.join(ku, [*keys, "u"]).join(kv, [*keys, "v"]).select(*keys, F.when(up, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("v"))
    tri = o.join(o.select(*keys, F.col("u").alias("v"), F.col("v").alias("w")), [*keys, "v"]).join(o.select(*keys, "u", F.col("v").alias("w")), [*keys, "u", "w"])
    t = tri.select(*keys, F.explode(F.array("u", "v", "w")).alias("u")).groupBy(*keys, "u").agg(F.count("*").alias("t"))
    loops = e.where("u = v").select(*keys, "u", F.lit(1).alias("loop"))
    x = deg.join(loops, [*keys, "u"], "full").join(t, [*keys, "u"], "left").na.fill(0)
    n = F.col("k") + F.col("loop")
    return x.select(*keys, F.col("u").alias("user_idx"), F.when(n > 1, (F.col("t") + F.col("loop") * F.col("k")) / (n * (n - 1) / 2)).otherwise(0.0).alias("clustering"))


def scope(edge_windows: DataFrame, name: str) -> DataFrame:
    """Edges of one scope; whatever is not context is current."""
    is_context = F.coalesce(F.col("window_scope"), F.lit("")) == "context"
    return edge_windows.where(is_context if name == "context" else ~is_context).select(*KEYS, "src", "dst")


def structure(nodes: DataFrame, edge_windows: DataFrame) -> DataFrame:
    """Degrees, their shares of the window, depth and clustering."""
    x = _with_totals(_parts(nodes), tc=F.sum("deg_cur"), tm=F.sum("deg_cum"), md=F.greatest(F.max("depth"), F.lit(1)))
    x = x.join(local_clustering(scope(edge_windows, "current"), KEYS), ID, "left").na.fill(0.0, ["clustering"])
    logs = {f"str_{side}_degree_{s}_log": log1p_pos(F.col(f"{side}_degree_{s}") if side != "total" else F.col(f"deg_{s}")) for s in ("cur", "ctx") for side in ("in", "out", "total")}
    return _made(x, ID, {
        **logs, "str_degree_cum_log": log1p_pos(F.col("deg_cum")), "str_degree_delta": F.col("deg_cur") - F.col("deg_ctx"), "str_degree_share_cur": safe_div(F.col("deg_cur"), F.col("tc")), "str_degree_share_cum": safe_div(F.col("deg_cum"), F.col("tm")),
        "str_proxy_depth_norm": clamp01(F.col("depth") / F.col("md")), "str_parent_score": F.col("parent_score"), "str_child_count_log": log1p_pos(F.col("out_degree_cur")), "str_local_clustering": F.col("clustering"),
    })


def coordination_graph(nodes: DataFrame, edge_windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """``coordination`` of the active users of each window."""
    active = written(_parts(nodes).where("active = 1").select(*ID, F.col("bin").cast("long"), F.col("depth").cast("long")), "active")
    return coordination(active, links(active, edge_windows.select(*KEYS, "src", "dst"), candidates))


def coordination_evidence(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """Links of each user in the coordination graph, now and so far, and its component."""
    n = nodes.groupBy(*KEYS).agg(F.count("*").alias("n"))
    most = graph.groupBy(*KEYS).agg(F.greatest(F.max("component"), F.lit(1)).alias("most"))
    x = nodes.select(*ID).join(graph, ID, "left").join(n, KEYS).join(most, KEYS, "left").na.fill(0).withColumn("most", F.greatest("most", F.lit(1)))
    so_far = F.sum("degree").over(Window.partitionBy("cascade_idx", "user_idx").orderBy("window_idx"))
    d = F.col("degree")
    return _made(x.withColumn("so_far", so_far), ID, {
        "coord_sync_degree_cur_log": log1p_pos(d), "coord_sync_weight_sum_cur": F.col("weight"), "coord_sync_degree_cum_log": log1p_pos(F.col("so_far")), "coord_component_size_ratio": F.col("component") / F.col("n"), "coord_component_rank_norm": F.col("component") / F.col("most"), "coord_follow_supported_sync_ratio": safe_div(F.col("follow_links"), d),
        "coord_same_parent_sync_count_log": log1p_pos(F.col("depth_links")), "coord_same_time_bin_sync_count_log": log1p_pos(F.col("bin_links")), "coord_coordination_clustering": F.col("density"), "coord_coordination_density_local": d / F.greatest(F.col("n") - 1, F.lit(1)),
    })


def overlaps(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(keys, src, dst, ways) of each different candidate edge that the window has: 1 in one direction, 2 in both."""
    s = candidates.where("src <> dst").select("cascade_idx", "src", "dst").distinct()
    e = edges.select(*KEYS, "src", "dst").distinct()
    back = e.select(*KEYS, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return s.join(e.union(back), ["cascade_idx", "src", "dst"]).groupBy(*KEYS, "src", "dst").agg(F.count("*").alias("ways"))


def edge_overlap(candidates: DataFrame, edge_windows: DataFrame) -> DataFrame:
    """Per window and scope: edges, matches with candidates in either direction, and their ratio."""
    out = None
    for name in ("current", "context"):
        e = scope(edge_windows, name)
        x = e.groupBy(*KEYS).agg(F.count("*").alias("edges")).join(overlaps(candidates, e).groupBy(*KEYS).agg(F.sum("ways").alias("matches")), KEYS, "left").na.fill(0)
        x = x.select(*KEYS, F.lit(name).alias("window_scope"), "edges", "matches", F.round(F.col("matches") / F.col("edges"), DIGITS).alias("ratio"))
        out = x if out is None else out.unionByName(x)
    return out


def relations(nodes: DataFrame, candidates: DataFrame, edge_windows: DataFrame) -> DataFrame:
    """Candidate edges of each user, how far window edges and active neighbours follow them."""
    e = candidates.where("src <> dst").select("cascade_idx", "src", "dst")
    ends = e.select("cascade_idx", F.col("src").alias("user_idx"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select("cascade_idx", F.col("dst").alias("user_idx"), F.col("src").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    pair = ends.groupBy("cascade_idx", "user_idx", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    both = (F.col("o") > 0) & (F.col("i") > 0)
    per = pair.groupBy("cascade_idx", "user_idx").agg(F.sum("i").alias("inc"), F.sum("o").alias("out"), F.count("*").alias("neighbours"), F.count_if(both).alias("reciprocal"), (F.count("*") + F.count_if(both)).alias("incident"))
    x = _parts(nodes)
    seen = x.select(*KEYS, F.col("user_idx").alias("other"), "active", "deg_cur")
    near = pair.select("cascade_idx", "user_idx", "other").join(seen, ["cascade_idx", "other"]).groupBy(*ID).agg(F.sum("active").alias("active_near"), F.avg("deg_cur").alias("degree_near"))
    sizes, out = x.groupBy(*KEYS).agg(F.count("*").alias("n")), x.select(*ID)
    for k in ("current", "context"):
        m = overlaps(candidates, scope(edge_windows, k)).select(*KEYS, F.explode(F.array("src", "dst")).alias("user_idx")).groupBy(*ID).agg(F.count("*").alias(k))
        out = out.join(m, ID, "left")
    ratio = edge_overlap(candidates, edge_windows).where("window_scope = 'current'").select(*KEYS, "ratio")
    out = out.join(per, ["cascade_idx", "user_idx"], "left").join(near, ID, "left").join(sizes, KEYS).join(ratio, KEYS, "left").na.fill(0)
    total, some = F.col("inc") + F.col("out"), F.col("active_near") / F.greatest(F.col("neighbours"), F.lit(1))
    return _made(out, ID, {
        "glob_follow_in_cand_log": log1p_pos(F.col("inc")), "glob_follow_out_cand_log": log1p_pos(F.col("out")), "glob_follow_total_cand_log": log1p_pos(total), "glob_follow_candidate_share": total / F.greatest(F.col("n") - 1, F.lit(1)), "glob_follow_current_overlap": safe_div(F.col("current"), F.col("incident")), "glob_follow_context_overlap": safe_div(F.col("context"), F.col("incident")),
        "glob_follow_sync_overlap": some, "glob_follow_neighbor_active_mean": some, "glob_follow_neighbor_degree_mean": F.col("degree_near"), "glob_follow_reciprocal_count_log": log1p_pos(F.col("reciprocal")), "glob_follow_supported_edge_ratio": F.col("ratio"),
    })


def _spread(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Per window: ``gini``, ``entropy``, ``most``, ``total`` and ``cells`` (above 0) of a value, from one row a different value."""
    v = rows.select(*KEYS, F.greatest(value.cast("double"), F.lit(0.0)).alias("v")).groupBy(*KEYS, "v").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*KEYS)
    v = v.withColumn("before", F.coalesce(F.sum("m").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum(F.col("m") * F.col("v")).over(w))
    p, m = F.col("v") / F.col("all"), F.col("m")
    a = v.groupBy(*KEYS).agg(F.sum("m").alias("n"), F.max("all").alias("total"), F.max("v").alias("most"), F.sum(F.when(F.col("v") > 0, m).otherwise(0)).alias("cells"), F.sum(F.col("v") * (m * F.col("before") + m * (m + 1) / 2)).alias("s"), (-F.sum(F.when(F.col("v") > 0, m * p * F.log(p + 1e-12)))).alias("e"))
    some, n = F.col("total") > 0, F.col("n")
    return a.select(*KEYS, F.when(some, 2 * F.col("s") / (n * F.col("total")) - (n + 1) / n).otherwise(0.0).alias(f"{name}_gini"), F.when(some, F.col("e") / F.log(F.greatest("cells", F.lit(2)))).otherwise(0.0).alias(f"{name}_entropy"), F.col("most").alias(f"{name}_most"), F.col("total").alias(f"{name}_total"), F.col("cells").alias(f"{name}_cells"))


def largest_component(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(keys, largest): size of the largest component that holds a user, active ones where there are any, by their number."""
    roots = grouped_components(edges, KEYS, "src", "dst")
    sizes = roots.join(roots.groupBy(*KEYS, "root").agg(F.count("*").alias("size")), [*KEYS, "root"]).select(*KEYS, F.col("node").alias("user_idx"), "size")
    x = nodes.select(*ID, "active").join(sizes, ID, "left").na.fill(1, ["size"])
    a = x.groupBy(*KEYS).agg(F.sum("active").alias("actives"), F.max(F.when(F.col("active") == 1, F.col("size"))).alias("of_active"), F.max("size").alias("of_all"), F.count("*").alias("n"))
    return a.select(*KEYS, F.when(F.col("actives") > 0, F.col("of_active") / F.col("actives")).otherwise(F.col("of_all") / F.col("n")).alias("largest"))


def window_evidence(windows: DataFrame, nodes: DataFrame, graph: DataFrame, candidates: DataFrame, edge_windows: DataFrame) -> DataFrame:
    """Heat, users, bins, edges, depths, coordination and candidates of each window; ``windows`` as from
    ``windows.multiscale_windows``."""
    x = _parts(nodes)
    first = x.where("active = 1").groupBy("cascade_idx", "user_idx").agg(F.min("window_idx").alias("window_idx")).groupBy(*KEYS).agg(F.count("*").alias("new"))
    tree = F.col("has_tree_feature") > 0
    per = x.groupBy(*KEYS).agg(F.count("*").alias("nodes"), F.sum("active").alias("actives"), F.avg(F.when(tree, F.col("depth"))).alias("depth_mean"), F.max(F.when(tree, F.col("depth"))).alias("depth_max"))
    bins = _spread(x.where("active = 1").groupBy(*KEYS, "bin").agg(F.count("*").alias("v")), F.col("v"), "bin")
    deg, branch = _spread(x, F.col("deg_cur"), "deg").select(*KEYS, "deg_gini"), _spread(x, F.floor("out_degree_cur"), "branch").select(*KEYS, "branch_entropy")
    linked = F.when(F.col("degree") > 0, F.col("component"))
    co = graph.groupBy(*KEYS).agg((F.sum("degree") / 2).alias("co_edges"), (F.sum("follow_links") / 2).alias("co_follow"), F.max("component").alias("co_largest"), F.avg(linked).alias("co_mean"))
    glob = candidates.where("src <> dst").select("cascade_idx", "src", "dst").distinct().groupBy("cascade_idx").agg(F.count("*").alias("glob"))
    current = scope(edge_windows, "current")
    shared = edge_overlap(candidates, edge_windows)
    r = windows.select(*KEYS, *(F.col(f"num_retweets_{s}").alias(f"heat_{s}") for s in ("cur", "cum")), "num_active_users_cur", "num_active_users_cum")
    for part in (per, first, bins, deg, branch, co, largest_component(current, x)):
        r = r.join(part, KEYS, "left")
    for name in ("current", "context"):
        r = r.join(shared.where(F.col("window_scope") == name).select(*KEYS, F.col("edges").alias(f"edges_{name}"), F.col("ratio").alias(f"ratio_{name}")), KEYS, "left")
    r = r.join(glob, "cascade_idx", "left").na.fill(0)
    by = Window.partitionBy("cascade_idx").orderBy("window_idx")
    r = r.withColumn("delta", F.col("heat_cur") - F.lag("heat_cur", 1, 0).over(by)).withColumn("acc", F.col("delta") - F.lag("delta", 1, 0).over(by))
    n = F.greatest(F.col("nodes"), F.lit(1))
    every, actives, heat = n * F.greatest(n - 1, F.lit(1)), F.col("actives"), F.col("heat_cur")
    return _made(r, KEYS, {
        "win_heat_cur_log": log1p_pos(heat), "win_heat_cum_log": log1p_pos(F.col("heat_cum")), "win_delta_heat": F.col("delta"), "win_growth_rate": F.col("delta") / F.greatest(heat, F.lit(1)), "win_acceleration": F.col("acc"), "win_active_users_cur_log": log1p_pos(F.col("num_active_users_cur")), "win_active_users_cum_log": log1p_pos(F.col("num_active_users_cum")),
        "win_new_user_ratio": safe_div(F.col("new"), actives), "win_repeat_user_ratio": safe_div(actives - F.col("new"), actives), "win_temporal_entropy": F.col("bin_entropy"), "win_max_bin_share": safe_div(F.col("bin_most"), actives), "win_gini_time_bin": F.col("bin_gini"), "win_burstiness": safe_div(F.col("bin_most"), F.col("bin_total")), "win_active_bin_ratio": (F.col("bin_cells") > 0).cast("int"),
        "win_edge_count_cur_log": log1p_pos(F.col("edges_current")), "win_edge_count_ctx_log": log1p_pos(F.col("edges_context")), "win_density_cur": F.col("edges_current") / every, "win_density_ctx": F.col("edges_context") / every, "win_degree_gini": F.col("deg_gini"), "win_largest_component_ratio": F.col("largest"), "win_depth_mean": F.col("depth_mean"), "win_depth_max": F.col("depth_max"), "win_branch_entropy": F.col("branch_entropy"),
        "win_coord_edge_count_log": log1p_pos(F.col("co_edges")), "win_coord_density": F.col("co_edges") / (every / 2), "win_coord_largest_component_ratio": F.col("co_largest") / n, "win_coord_avg_component_size": F.col("co_mean"), "win_coord_follow_supported_ratio": safe_div(F.col("co_follow"), F.col("co_edges")),
        "win_global_candidate_edge_count_log": log1p_pos(F.col("glob")), "win_global_candidate_density": F.col("glob") / every, "win_global_follow_overlap_cur": F.col("ratio_current"), "win_global_follow_overlap_ctx": F.col("ratio_context"),
    })

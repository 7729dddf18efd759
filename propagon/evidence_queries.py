"""Queries on evidence, ancestry and depths with their SQL; ``register`` adds them to the catalogue it is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from propagon.operators import ancestry, evidence, features, graph, windows
from propagon.sources import cascades as src
from propagon.sources.shared import written


def _log(x: str) -> str:
    return f"ln(1 + greatest(CAST({x} AS DOUBLE), 0))"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN ({a}) / ({b}) ELSE 0 END"


def _clamp(x: str) -> str:
    return f"greatest(least({x}, 1), 0)"


def _list(values: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), 8) AS {k}" for k, v in values.items())


IDS = "cascade_idx, window_idx, user_idx"
DEPTHS = """,
dep(cascade_idx, t, depth) AS (
  SELECT cascade_idx, child_tweet_idx, CAST(1 AS BIGINT) FROM tr WHERE (cascade_idx, parent_tweet_idx) NOT IN (SELECT (cascade_idx, child_tweet_idx) FROM tr) UNION ALL
  SELECT tr.cascade_idx, child_tweet_idx, depth + 1 FROM tr JOIN dep ON dep.cascade_idx = tr.cascade_idx AND t = parent_tweet_idx)"""
#: The panel of users with texts and tree columns.
PANEL = """,
tf AS (SELECT tr.cascade_idx, child_user_idx AS user_idx, max(depth) AS depth, round(avg(time_gap), 8) AS parent_time_gap, round(avg(exp(-time_gap / 1800)), 8) AS parent_score FROM tr JOIN dep ON dep.cascade_idx = tr.cascade_idx AND t = child_tweet_idx GROUP BY ALL),
vt0 AS (SELECT cascade_idx, window_idx, user_idx, count(CASE WHEN text_visible_type <> 'root_always_visible' THEN 1 END) AS num_texts_cur, count(*) AS num_texts_visible FROM tw GROUP BY ALL),
ev AS (SELECT nw.*, coalesce(num_texts_cur, 0) AS num_texts_cur, coalesce(num_texts_visible, 0) AS num_texts_visible, coalesce(depth, 0) AS depth, coalesce(parent_time_gap, 0) AS parent_time_gap, coalesce(parent_score, 0) AS parent_score, depth IS NOT NULL AS treed,
    CAST(num_posts_cur > 0 AS INT) AS active, (first_seen_time + time_since_first_seen) // 60 AS bin, greatest(first_seen_time + time_since_first_seen, 1) AS denom, in_degree_cur + out_degree_cur AS gc, in_degree_ctx + out_degree_ctx AS gx, in_degree_cum + out_degree_cum AS gm
  FROM nw LEFT JOIN vt0 USING (cascade_idx, window_idx, user_idx) LEFT JOIN tf USING (cascade_idx, user_idx)),
ewin AS (SELECT cascade_idx, window_idx, src, dst, 'current' AS scope FROM edges JOIN win ON relative_time >= end_time - 300 AND relative_time < end_time
  UNION ALL SELECT cascade_idx, window_idx, src, dst, 'context' FROM edges JOIN win ON relative_time >= greatest(end_time - 600, 0) AND relative_time < end_time),
people AS (SELECT DISTINCT cascade_idx, user_idx FROM posts),
cd AS (SELECT a.cascade_idx, src, dst FROM follows JOIN people a ON a.user_idx = src JOIN people b ON b.user_idx = dst AND b.cascade_idx = a.cascade_idx WHERE src <> dst)"""
COORD = """,
st AS (SELECT DISTINCT cascade_idx, window_idx, least(src, dst) AS a, greatest(src, dst) AS b FROM ewin),
fl AS (SELECT DISTINCT cascade_idx, least(src, dst) AS a, greatest(src, dst) AS b FROM cd),
pr AS (SELECT x.cascade_idx, x.window_idx, x.user_idx AS a, y.user_idx AS b, x.bin = y.bin AS sb, x.depth = y.depth AND x.depth > 0 AS sd, st.a IS NOT NULL AS se, fl.a IS NOT NULL AS sf
  FROM ev x JOIN ev y ON y.cascade_idx = x.cascade_idx AND y.window_idx = x.window_idx AND x.user_idx < y.user_idx AND x.active = 1 AND y.active = 1
  LEFT JOIN st ON st.cascade_idx = x.cascade_idx AND st.window_idx = x.window_idx AND st.a = x.user_idx AND st.b = y.user_idx LEFT JOIN fl ON fl.cascade_idx = x.cascade_idx AND fl.a = x.user_idx AND fl.b = y.user_idx),
aj AS (SELECT cascade_idx, window_idx, a AS u, b AS v, sb, sd, se, sf FROM pr WHERE sb OR sd OR se OR sf UNION ALL SELECT cascade_idx, window_idx, b, a, sb, sd, se, sf FROM pr WHERE sb OR sd OR se OR sf),
reach(cascade_idx, window_idx, u, v) AS (SELECT DISTINCT cascade_idx, window_idx, u, u FROM aj UNION SELECT r.cascade_idx, r.window_idx, r.u, aj.v FROM reach r JOIN aj ON aj.cascade_idx = r.cascade_idx AND aj.window_idx = r.window_idx AND aj.u = r.v),
cs AS (SELECT cascade_idx, window_idx, u AS user_idx, count(*) AS component FROM reach GROUP BY ALL),
ag AS (SELECT cascade_idx, window_idx, u AS user_idx, count(*) AS degree, round(CAST(sum(0.35 * sb::INT + 0.25 * sd::INT + 0.2 * se::INT + 0.2 * sf::INT) AS DOUBLE), 8) AS weight, sum(sf::INT) AS follow_links, sum(sd::INT) AS depth_links, sum(sb::INT) AS bin_links FROM aj GROUP BY ALL),
ln AS (SELECT p.cascade_idx, p.window_idx, p.u AS user_idx, count(*) AS links FROM aj p JOIN aj q ON q.cascade_idx = p.cascade_idx AND q.window_idx = p.window_idx AND q.u = p.u AND p.v < q.v JOIN aj z ON z.cascade_idx = p.cascade_idx AND z.window_idx = p.window_idx AND z.u = p.v AND z.v = q.v GROUP BY ALL),
co AS (SELECT cascade_idx, window_idx, user_idx, coalesce(degree, 0) AS degree, coalesce(weight, 0) AS weight, CAST(coalesce(follow_links, 0) AS BIGINT) AS follow_links, CAST(coalesce(depth_links, 0) AS BIGINT) AS depth_links, CAST(coalesce(bin_links, 0) AS BIGINT) AS bin_links, coalesce(component, 0) AS component,
    round(CASE WHEN degree > 1 THEN coalesce(links, 0) / (degree * (degree - 1) / 2) ELSE 0 END, 8) AS density
  FROM ev LEFT JOIN ag USING (cascade_idx, window_idx, user_idx) LEFT JOIN cs USING (cascade_idx, window_idx, user_idx) LEFT JOIN ln USING (cascade_idx, window_idx, user_idx) WHERE active = 1)"""
OVER = """,
ways AS (SELECT g.cascade_idx, x.window_idx, x.scope, g.src, g.dst, count(*) AS ways FROM cd g JOIN (SELECT DISTINCT cascade_idx, window_idx, scope, src, dst FROM ewin UNION ALL SELECT DISTINCT cascade_idx, window_idx, scope, dst, src FROM ewin) x ON x.cascade_idx = g.cascade_idx AND x.src = g.src AND x.dst = g.dst GROUP BY ALL),
ov AS (SELECT e.cascade_idx, e.window_idx, e.scope, e.edges, CAST(coalesce(m.m, 0) AS BIGINT) AS matches, round(coalesce(m.m, 0) / e.edges, 8) AS ratio FROM (SELECT cascade_idx, window_idx, scope, count(*) AS edges FROM ewin GROUP BY ALL) e LEFT JOIN (SELECT cascade_idx, window_idx, scope, sum(ways) AS m FROM ways GROUP BY ALL) m USING (cascade_idx, window_idx, scope))"""
BY_USER = "OVER (PARTITION BY cascade_idx, user_idx ORDER BY window_idx)"
BY_WINDOW = "OVER (PARTITION BY cascade_idx, window_idx)"
BEHAVIOUR = {
    "beh_active_cur": "active", "beh_posts_cur_log": _log("num_posts_cur"), "beh_posts_cum_log": _log("num_posts_cum"), "beh_visible_texts_cur_log": _log("num_texts_cur"), "beh_visible_texts_cum_log": _log("num_texts_visible"), "beh_contribution_share_cur": _div("num_posts_cur", "pm"), "beh_contribution_share_cum": _div("num_posts_cum", "cm"),
    "beh_active_window_count_log": _log("active_window_count"), "beh_active_window_ratio": "active_window_count / (window_idx + 1)", "beh_first_seen_norm": _clamp("first_seen_time / denom"), "beh_time_since_first_seen_norm": _clamp("time_since_first_seen / denom"), "beh_window_reactivation": "CAST(num_posts_cur > 0 AND p0 <= 0 AS INT)",
}
TIMING = {
    "tmp_window_pos": "window_idx / 6", "tmp_first_seen_window_norm": _clamp("first_seen_time / denom"), "tmp_time_since_first_seen_norm": _clamp("time_since_first_seen / denom"), "tmp_is_early_participant": "CAST(window_idx / 6 <= CAST(0.33 AS DOUBLE) AS INT)", "tmp_is_late_participant": "CAST(window_idx / 6 >= CAST(0.67 AS DOUBLE) AS INT)",
    "tmp_activity_delta": "d", "tmp_activity_acceleration": f"d - lag(d, 1, 0) {BY_USER}", "tmp_same_bin_user_count_log": _log("same"), "tmp_same_bin_user_share": "same / greatest(actives, 1)", "tmp_nearest_event_gap_norm": _clamp("parent_time_gap / greatest(time_since_first_seen, 1)"), "tmp_burst_bin_rank": "same / greatest(actives, 1)", "tmp_temporal_sync_score": "same / greatest(actives, 1)",
}
STRUCTURE = {
    "str_in_degree_cur_log": _log("in_degree_cur"), "str_out_degree_cur_log": _log("out_degree_cur"), "str_total_degree_cur_log": _log("gc"), "str_in_degree_ctx_log": _log("in_degree_ctx"), "str_out_degree_ctx_log": _log("out_degree_ctx"), "str_total_degree_ctx_log": _log("gx"), "str_degree_cum_log": _log("gm"), "str_degree_delta": "gc - gx",
    "str_degree_share_cur": _div("gc", f"(sum(gc) {BY_WINDOW})"), "str_degree_share_cum": _div("gm", f"(sum(gm) {BY_WINDOW})"), "str_proxy_depth_norm": f"depth / greatest(max(depth) {BY_WINDOW}, 1)", "str_parent_score": "parent_score", "str_child_count_log": _log("out_degree_cur"), "str_local_clustering": "coalesce(clustering, 0)",
}
COORDINATION = {
    "coord_sync_degree_cur_log": _log("degree"), "coord_sync_weight_sum_cur": "weight", "coord_sync_degree_cum_log": _log("so_far"), "coord_component_size_ratio": "component / n", "coord_component_rank_norm": "component / greatest(most, 1)", "coord_follow_supported_sync_ratio": _div("follow_links", "degree"), "coord_same_parent_sync_count_log": _log("depth_links"),
    "coord_same_time_bin_sync_count_log": _log("bin_links"), "coord_coordination_clustering": "density", "coord_coordination_density_local": "degree / greatest(n - 1, 1)",
}
RELATIONS = {
    "glob_follow_in_cand_log": _log("coalesce(inc, 0)"), "glob_follow_out_cand_log": _log("coalesce(outc, 0)"), "glob_follow_total_cand_log": _log("coalesce(inc, 0) + coalesce(outc, 0)"), "glob_follow_candidate_share": "(coalesce(inc, 0) + coalesce(outc, 0)) / greatest(n - 1, 1)", "glob_follow_current_overlap": "coalesce(mc / (inc + outc), 0)", "glob_follow_context_overlap": "coalesce(mx / (inc + outc), 0)",
    "glob_follow_sync_overlap": "coalesce(na / nn, 0)", "glob_follow_neighbor_active_mean": "coalesce(na / nn, 0)", "glob_follow_neighbor_degree_mean": "coalesce(nd, 0)", "glob_follow_reciprocal_count_log": _log("coalesce(rec, 0)"), "glob_follow_supported_edge_ratio": "coalesce(ratio, 0)",
}
WINDOW = {
    "win_heat_cur_log": _log("num_retweets_cur"), "win_heat_cum_log": _log("num_retweets_cum"), "win_delta_heat": "d", "win_growth_rate": "d / greatest(num_retweets_cur, 1)", "win_acceleration": "d - lag(d, 1, 0) OVER (PARTITION BY cascade_idx ORDER BY window_idx)", "win_active_users_cur_log": _log("num_active_users_cur"), "win_active_users_cum_log": _log("num_active_users_cum"),
    "win_new_user_ratio": "coalesce(fresh / nullif(act, 0), 0)", "win_repeat_user_ratio": "coalesce((act - fresh) / nullif(act, 0), 0)", "win_temporal_entropy": "coalesce(be, 0)", "win_max_bin_share": "coalesce(bm / nullif(act, 0), 0)", "win_gini_time_bin": "coalesce(bg, 0)", "win_burstiness": "coalesce(bm / bt, 0)", "win_active_bin_ratio": "CAST(coalesce(bm, 0) > 0 AS INT)",
    "win_edge_count_cur_log": _log("coalesce(ec, 0)"), "win_edge_count_ctx_log": _log("coalesce(ex, 0)"), "win_density_cur": "coalesce(ec, 0) / ev1", "win_density_ctx": "coalesce(ex, 0) / ev1", "win_degree_gini": "coalesce(dg, 0)", "win_largest_component_ratio": "coalesce(largest, 0)", "win_depth_mean": "coalesce(dm, 0)", "win_depth_max": "coalesce(dx, 0)", "win_branch_entropy": "coalesce(oe, 0)",
    "win_coord_edge_count_log": _log("coalesce(ce, 0)"), "win_coord_density": "coalesce(ce, 0) / (ev1 / 2)", "win_coord_largest_component_ratio": "coalesce(cl, 0) / n1", "win_coord_avg_component_size": "coalesce(cm, 0)", "win_coord_follow_supported_ratio": "coalesce(cf / nullif(ce, 0), 0)",
    "win_global_candidate_edge_count_log": _log("coalesce(gl, 0)"), "win_global_candidate_density": "coalesce(gl, 0) / ev1", "win_global_follow_overlap_cur": "coalesce(rc, 0)", "win_global_follow_overlap_ctx": "coalesce(rx, 0)",
}


def _spread(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT cascade_idx, window_idx, max(v) AS most, sum(v) AS total, CASE WHEN sum(v) > 0 THEN 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*) ELSE 0 END AS gini, CASE WHEN max(s) > 0 THEN -sum(CASE WHEN v > 0 THEN v / s * ln(v / s + 1e-12) END) / ln(greatest(count(CASE WHEN v > 0 THEN 1 END), 2)) ELSE 0 END AS entropy
  FROM (SELECT *, row_number() OVER (PARTITION BY cascade_idx, window_idx ORDER BY v) AS i, sum(v) OVER (PARTITION BY cascade_idx, window_idx) AS s FROM ({rows})) GROUP BY ALL)"""


def register(c) -> None:
    """``c``: the catalogue module."""
    base = c.NODES + c.TEXTS.replace(c.GRID, "") + c.TREE + DEPTHS + PANEL

    def add(name, query, sql):
        c.QUERIES[name] = query
        c.SQL[name] = f"WITH RECURSIVE {src.SQL}{sql}"

    def tree_of(s, d):
        return graph.time_only_tree(c._posts(s, d))

    def panel(s, d):
        posts, tree = c._posts(s, d), tree_of(s, d)
        deep = tree.join(ancestry.depths(tree), ["cascade_idx", "child_tweet_idx"]).select("cascade_idx", F.col("child_user_idx").alias("user_idx"), "depth", "time_gap", F.exp(-F.col("time_gap") / 1800).alias("parent_score"))
        return written(evidence.with_tree(features.node_features(windows.node_windows(posts, c._edges(s, d)), windows.text_windows(posts)), deep), "panel")

    def edge_windows(s, d):
        return written(windows.edge_windows(c._edges(s, d)), "edges")

    def candidates(s, d):
        return written(graph.candidate_edges(src.follows(s, d), c._posts(s, d)).select("cascade_idx", "src", "dst"), "candidates")

    def coordination(s, d):
        return evidence.coordination_graph(panel(s, d), edge_windows(s, d), candidates(s, d))

    add("tree_depths", lambda s, d: ancestry.depths(tree_of(s, d)), c.TREE + DEPTHS + " SELECT cascade_idx, t AS child_tweet_idx, depth FROM dep")
    add("first_with_ancestors", lambda s, d: ancestry.first_with_ancestors(c._posts(s, d), tree_of(s, d), 5), c.TREE + """,
first5 AS (SELECT cascade_idx, tweet_idx FROM posts QUALIFY row_number() OVER (PARTITION BY cascade_idx ORDER BY relative_time, tweet_idx) <= 5 OR is_root = 1),
up(cascade_idx, tweet_idx) AS (SELECT * FROM first5 UNION SELECT tr.cascade_idx, parent_tweet_idx FROM up JOIN tr ON tr.cascade_idx = up.cascade_idx AND child_tweet_idx = tweet_idx) SELECT * FROM up""")
    late = {"first_with_ancestors_of_last": 3}
    for name, most in late.items():
        # the latest posts in place of the earliest, so that ancestors are many
        add(name, lambda s, d, most=most: ancestry.first_with_ancestors(c._posts(s, d).withColumn("relative_time", -F.col("relative_time")), tree_of(s, d), most), c.TREE + f""",
last3 AS (SELECT cascade_idx, tweet_idx FROM posts QUALIFY row_number() OVER (PARTITION BY cascade_idx ORDER BY relative_time DESC, tweet_idx) <= {most} OR is_root = 1),
up(cascade_idx, tweet_idx) AS (SELECT * FROM last3 UNION SELECT tr.cascade_idx, parent_tweet_idx FROM up JOIN tr ON tr.cascade_idx = up.cascade_idx AND child_tweet_idx = tweet_idx) SELECT * FROM up""")
    near = lambda k, q, t: f"(SELECT {k} FROM (SELECT {k}, row_number() OVER (ORDER BY {k}) - 1 AS i, count(*) OVER () AS n FROM {t}) WHERE i = round_even((n - 1) * {q}, 0))"
    sim = lambda t: f"(SELECT avg(CASE WHEN len(a.b) > 0 AND len(b.b) > 0 THEN len(list_intersect(a.b, b.b)) / len(list_distinct(list_concat(a.b, b.b))) ELSE 0 END) FROM {t} z JOIN gg a ON a.tweet_idx = child_tweet_idx JOIN gg b ON b.tweet_idx = parent_tweet_idx)"
    measures = {
        "num_tree_edges": "(SELECT count(*) FROM td)", "avg_depth": "(SELECT avg(depth) FROM td)", "depth_p50": near("depth", 0.5, "td"), "depth_p90": near("depth", 0.9, "td"), "depth_p95": near("depth", 0.95, "td"), "max_depth": "(SELECT max(depth) FROM td)", "time_gap_mean": "(SELECT avg(time_gap) FROM td)", "time_gap_median": near("time_gap", 0.5, "td"), "time_gap_p90": near("time_gap", 0.9, "td"),
        "num_branching_parents": "(SELECT count(*) FROM bp WHERE k > 1)", "branch_entropy": "(SELECT -sum(k / n * ln(k / n + 1e-12)) FROM bp)", "top1_parent_child_ratio": "(SELECT max(k) / max(n) FROM bp)", "top5_parent_child_ratio": "(SELECT sum(k) / max(n) FROM (SELECT * FROM bp ORDER BY k DESC LIMIT 5))",
        "parent_child_text_sim_mean": sim("tr"), "random_pair_text_sim_mean": sim("bl"), "text_sim_lift": f"{sim('tr')} - {sim('bl')}",
    }
    add("tree_shape", lambda s, d: ancestry.tree_shape(tree_of(s, d), c._posts(s, d)), c.TREE + DEPTHS + """,
td AS (SELECT tr.*, depth FROM tr JOIN dep ON dep.cascade_idx = tr.cascade_idx AND t = child_tweet_idx), bp AS (SELECT parent_tweet_idx, count(*) AS k, (SELECT count(*) FROM tr) AS n FROM tr GROUP BY ALL),
g AS (SELECT tweet_idx, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM posts), gg AS (SELECT tweet_idx, CASE WHEN length(t) <= 2 THEN [t] ELSE list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) END AS b FROM g),
pl AS (SELECT cascade_idx, tweet_idx, row_number() OVER (PARTITION BY cascade_idx ORDER BY relative_time, tweet_idx) - 1 AS i FROM posts),
bl AS (SELECT tr.cascade_idx, tr.child_tweet_idx, q.tweet_idx AS parent_tweet_idx FROM tr JOIN pl p ON p.tweet_idx = child_tweet_idx JOIN pl q ON q.cascade_idx = p.cascade_idx AND q.i = 12345 % greatest(p.i, 1) AND p.i > 0)
""" + " UNION ALL ".join(f"SELECT '{k}' AS measure, round(CAST({v} AS DOUBLE), 6) AS value" for k, v in measures.items()))

    add("behaviour_evidence", lambda s, d: evidence.behaviour(panel(s, d)), base + f", z AS (SELECT *, sum(num_posts_cur) {BY_WINDOW} AS pm, sum(num_posts_cum) {BY_WINDOW} AS cm, lag(num_posts_cur, 1, 0) {BY_USER} AS p0 FROM ev) SELECT {IDS}, {_list(BEHAVIOUR)} FROM z")
    add("timing_evidence", lambda s, d: evidence.timing(panel(s, d), windows.multiscale_windows(c._posts(s, d), c._edges(s, d))), base + f", z AS (SELECT *, sum(active) OVER (PARTITION BY cascade_idx, window_idx, bin) AS same, sum(active) {BY_WINDOW} AS actives, num_posts_cur - lag(num_posts_cur, 1, 0) {BY_USER} AS d FROM ev) SELECT {IDS}, {_list(TIMING)} FROM z")
    add("structure_evidence", lambda s, d: evidence.structure(panel(s, d), edge_windows(s, d)), base + f""",
un AS (SELECT DISTINCT cascade_idx, window_idx, u, v FROM (SELECT cascade_idx, window_idx, src AS u, dst AS v FROM ewin WHERE scope = 'current' UNION ALL SELECT cascade_idx, window_idx, dst, src FROM ewin WHERE scope = 'current')),
nk AS (SELECT cascade_idx, window_idx, u, count(*) AS k FROM un GROUP BY ALL),
lk AS (SELECT p.cascade_idx, p.window_idx, p.u, count(*) AS t FROM un p JOIN un q ON q.cascade_idx = p.cascade_idx AND q.window_idx = p.window_idx AND q.u = p.u AND p.v < q.v JOIN un r ON r.cascade_idx = p.cascade_idx AND r.window_idx = p.window_idx AND r.u = p.v AND r.v = q.v GROUP BY ALL),
cl AS (SELECT cascade_idx, window_idx, u AS user_idx, CASE WHEN k > 1 THEN coalesce(t, 0) / (k * (k - 1) / 2) ELSE 0 END AS clustering FROM nk LEFT JOIN lk USING (cascade_idx, window_idx, u))
SELECT {IDS}, {_list(STRUCTURE)} FROM ev LEFT JOIN cl USING (cascade_idx, window_idx, user_idx)""")
    add("coordination_graph", coordination, base + COORD + " SELECT * FROM co")

    def coordinated(s, d):
        p = panel(s, d)
        return evidence.coordination_evidence(p, written(evidence.coordination_graph(p, edge_windows(s, d), candidates(s, d)), "coordination"))

    add("coordination_evidence", coordinated, base + COORD + f""",
z AS (SELECT {IDS}, coalesce(degree, 0) AS degree, coalesce(weight, 0) AS weight, coalesce(follow_links, 0) AS follow_links, coalesce(depth_links, 0) AS depth_links, coalesce(bin_links, 0) AS bin_links, coalesce(component, 0) AS component, coalesce(density, 0) AS density,
  sum(coalesce(degree, 0)) {BY_USER} AS so_far, count(*) {BY_WINDOW} AS n, max(coalesce(component, 0)) {BY_WINDOW} AS most FROM ev LEFT JOIN co USING (cascade_idx, window_idx, user_idx)) SELECT {IDS}, {_list(COORDINATION)} FROM z""")
    add("edge_overlap", lambda s, d: evidence.edge_overlap(candidates(s, d), edge_windows(s, d)), base + OVER + " SELECT cascade_idx, window_idx, scope AS window_scope, edges, matches, ratio FROM ov")
    add("relation_evidence", lambda s, d: evidence.relations(panel(s, d), candidates(s, d), edge_windows(s, d)), base + OVER + f""",
pc AS (SELECT cascade_idx, user_idx, sum(o) AS outc, sum(i) AS inc FROM (SELECT cascade_idx, src AS user_idx, 1 AS o, 0 AS i FROM cd UNION ALL SELECT cascade_idx, dst, 0, 1 FROM cd) GROUP BY ALL),
nb AS (SELECT cascade_idx, src AS u, dst AS v FROM cd UNION SELECT cascade_idx, dst, src FROM cd), nbc AS (SELECT cascade_idx, u AS user_idx, count(*) AS nn FROM nb GROUP BY ALL),
rp AS (SELECT a.cascade_idx, a.src AS user_idx, count(*) AS rec FROM cd a JOIN cd b ON b.cascade_idx = a.cascade_idx AND b.src = a.dst AND b.dst = a.src GROUP BY ALL),
ne AS (SELECT e.cascade_idx, e.window_idx, nb.u AS user_idx, sum(active) AS na, avg(gc) AS nd FROM nb JOIN ev e ON e.cascade_idx = nb.cascade_idx AND e.user_idx = nb.v GROUP BY ALL),
mm AS (SELECT cascade_idx, window_idx, user_idx, sum(CAST(scope = 'current' AS INT)) AS mc, sum(CAST(scope = 'context' AS INT)) AS mx FROM (SELECT cascade_idx, window_idx, scope, src AS user_idx FROM ways UNION ALL SELECT cascade_idx, window_idx, scope, dst FROM ways) GROUP BY ALL),
z AS (SELECT ev.*, count(*) {BY_WINDOW} AS n FROM ev)
SELECT {IDS}, {_list(RELATIONS)} FROM z LEFT JOIN pc USING (cascade_idx, user_idx) LEFT JOIN nbc USING (cascade_idx, user_idx) LEFT JOIN rp USING (cascade_idx, user_idx) LEFT JOIN ne USING (cascade_idx, window_idx, user_idx) LEFT JOIN mm USING (cascade_idx, window_idx, user_idx) LEFT JOIN (SELECT cascade_idx, window_idx, ratio FROM ov WHERE scope = 'current') USING (cascade_idx, window_idx)""")

    def window_rows(s, d):
        p, e, k = panel(s, d), edge_windows(s, d), candidates(s, d)
        graph_rows = written(evidence.coordination_graph(p, e, k), "coordination")
        return evidence.window_evidence(windows.multiscale_windows(c._posts(s, d), c._edges(s, d)), p, graph_rows, k, e)

    both = c.MULTI + c.NODES.replace(c.GRID, "") + c.TEXTS.replace(c.GRID, "") + c.TREE + DEPTHS + PANEL + COORD + OVER
    add("window_evidence", window_rows, both + f""",
un AS (SELECT cascade_idx, window_idx, src AS u, dst AS v FROM ewin WHERE scope = 'current' UNION SELECT cascade_idx, window_idx, dst, src FROM ewin WHERE scope = 'current'),
near(cascade_idx, window_idx, u, v) AS (SELECT DISTINCT cascade_idx, window_idx, u, u FROM un UNION SELECT r.cascade_idx, r.window_idx, r.u, un.v FROM near r JOIN un ON un.cascade_idx = r.cascade_idx AND un.window_idx = r.window_idx AND un.u = r.v),
nz AS (SELECT cascade_idx, window_idx, u AS user_idx, count(*) AS size FROM near GROUP BY ALL),
lz AS (SELECT cascade_idx, window_idx, CASE WHEN sum(active) > 0 THEN max(CASE WHEN active = 1 THEN coalesce(size, 1) END) / sum(active) ELSE max(coalesce(size, 1)) / count(*) END AS largest, count(*) AS n, sum(active) AS act, avg(CASE WHEN treed THEN depth END) AS dm, max(CASE WHEN treed THEN depth END) AS dx FROM ev LEFT JOIN nz USING (cascade_idx, window_idx, user_idx) GROUP BY ALL),
fr AS (SELECT cascade_idx, window_idx, count(*) AS fresh FROM (SELECT cascade_idx, user_idx, min(window_idx) AS window_idx FROM ev WHERE active = 1 GROUP BY ALL) GROUP BY ALL),
{_spread("sbin", "SELECT cascade_idx, window_idx, bin, count(*) AS v FROM ev WHERE active = 1 GROUP BY ALL")}, {_spread("sdeg", "SELECT cascade_idx, window_idx, gc AS v FROM ev")}, {_spread("sout", "SELECT cascade_idx, window_idx, out_degree_cur AS v FROM ev")},
sco AS (SELECT cascade_idx, window_idx, sum(degree) / 2 AS ce, sum(follow_links) / 2 AS cf, max(component) AS cl, avg(CASE WHEN degree > 0 THEN component END) AS cm FROM co GROUP BY ALL),
glb AS (SELECT cascade_idx, count(*) AS gl FROM cd GROUP BY ALL),
z AS (SELECT mw.*, lz.* EXCLUDE (cascade_idx, window_idx), coalesce(fresh, 0) AS fresh, b.most AS bm, b.total AS bt, b.gini AS bg, b.entropy AS be, g.gini AS dg, o.entropy AS oe, ce, cf, cl, cm, gl, oc.edges AS ec, oc.ratio AS rc, ox.edges AS ex, ox.ratio AS rx,
    num_retweets_cur - lag(num_retweets_cur, 1, 0) OVER (PARTITION BY mw.cascade_idx ORDER BY mw.window_idx) AS d, greatest(coalesce(n, 0), 1) AS n1, greatest(coalesce(n, 0), 1) * greatest(coalesce(n, 0) - 1, 1) AS ev1
  FROM mw LEFT JOIN lz USING (cascade_idx, window_idx) LEFT JOIN fr USING (cascade_idx, window_idx) LEFT JOIN sbin b USING (cascade_idx, window_idx) LEFT JOIN sdeg g USING (cascade_idx, window_idx) LEFT JOIN sout o USING (cascade_idx, window_idx) LEFT JOIN sco USING (cascade_idx, window_idx) LEFT JOIN glb USING (cascade_idx)
  LEFT JOIN (SELECT * FROM ov WHERE scope = 'current') oc USING (cascade_idx, window_idx) LEFT JOIN (SELECT * FROM ov WHERE scope = 'context') ox USING (cascade_idx, window_idx))
SELECT cascade_idx, window_idx, {_list(WINDOW)} FROM z""")

"""All registered queries and their SQL. Every query reads whole tables; the SQL is written on its own, for DuckDB."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from propagon.operators import calibration, features, graph, key_users, labels, metrics, org, packs, sampling, stability, temporal, trees, windows
from propagon.sources import cascades as src
from propagon.sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    SQL[name] = f"WITH {src.SQL}{sql}"


def _posts(s, d):
    return org.posts(src.raw_posts(s, d))


def _edges(s, d):
    return org.star_edges(_posts(s, d))


GRID = """,
win AS (SELECT i AS window_idx, i * 300 AS end_time FROM range(1, 7) t(i)),
grid AS (SELECT cascade_idx, window_idx, end_time FROM (SELECT DISTINCT cascade_idx FROM posts), win)"""
MULTI = GRID + """,
multi AS (
  SELECT g.cascade_idx, g.window_idx, g.end_time,
    count(CASE WHEN p.relative_time >= g.end_time - 300 THEN 1 END) AS num_retweets_cur,
    count(CASE WHEN p.relative_time >= greatest(0, g.end_time - 600) THEN 1 END) AS num_retweets_ctx, count(p.tweet_idx) AS num_retweets_cum,
    count(DISTINCT CASE WHEN p.relative_time >= g.end_time - 300 THEN p.user_idx END) AS num_active_users_cur,
    count(DISTINCT CASE WHEN p.relative_time >= greatest(0, g.end_time - 600) THEN p.user_idx END) AS num_active_users_ctx,
    count(DISTINCT p.user_idx) AS num_active_users_cum
  FROM grid g LEFT JOIN reposts p ON p.cascade_idx = g.cascade_idx AND p.relative_time < g.end_time GROUP BY ALL),
multi_edges AS (
  SELECT g.cascade_idx, g.window_idx, count(CASE WHEN e.relative_time >= g.end_time - 300 THEN 1 END) AS num_edges_cur,
    count(CASE WHEN e.relative_time >= greatest(0, g.end_time - 600) THEN 1 END) AS num_edges_ctx, count(e.dst) AS num_edges_cum
  FROM grid g LEFT JOIN edges e ON e.cascade_idx = g.cascade_idx AND e.relative_time < g.end_time GROUP BY ALL),
mw AS (SELECT m.*, e.* EXCLUDE (cascade_idx, window_idx), num_retweets_cur - lag(num_retweets_cur, 1, 0) OVER (PARTITION BY m.cascade_idx ORDER BY m.window_idx) AS delta_heat
  FROM multi m JOIN multi_edges e USING (cascade_idx, window_idx))"""
NODES = GRID + """,
act AS (
  SELECT cascade_idx, user_idx, relative_time, 1 AS p, 0 AS i, 0 AS o, is_root AS r FROM posts UNION ALL
  SELECT cascade_idx, src, relative_time, 0, 0, 1, 0 FROM edges UNION ALL SELECT cascade_idx, dst, relative_time, 0, 1, 0, 0 FROM edges),
firsts AS (SELECT cascade_idx, user_idx, min(relative_time) AS first_seen_time, max(r) AS is_root FROM act GROUP BY ALL),
nw0 AS (
  SELECT g.cascade_idx, g.window_idx, f.user_idx, f.is_root, f.first_seen_time, g.end_time - f.first_seen_time AS time_since_first_seen,
    """ + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN a.relative_time >= {low} THEN a.{k} ELSE 0 END), 0) AS BIGINT) AS {n}_{s}" for k, n in (("p", "num_posts"), ("i", "in_degree"), ("o", "out_degree")) for s, low in (("cur", "g.end_time - 300"), ("ctx", "greatest(0, g.end_time - 600)"), ("cum", "-1000000"))
) + """
  FROM grid g JOIN firsts f ON f.cascade_idx = g.cascade_idx AND f.first_seen_time < g.end_time
  LEFT JOIN act a ON a.cascade_idx = g.cascade_idx AND a.user_idx = f.user_idx AND a.relative_time < g.end_time GROUP BY ALL),
nw AS (SELECT *, CAST(sum(CAST(num_posts_cur + in_degree_cur + out_degree_cur > 0 AS INT)) OVER (PARTITION BY cascade_idx, user_idx ORDER BY window_idx) AS BIGINT) AS active_window_count FROM nw0)"""
TEXTS = GRID + """,
tw AS (SELECT g.cascade_idx, g.window_idx, p.tweet_idx, p.user_idx, p.relative_time,
    CASE WHEN p.is_root = 1 THEN 'root_always_visible' WHEN p.relative_time >= g.end_time - 300 THEN 'current_window' ELSE 'history_visible' END AS text_visible_type,
    length(p.text) AS text_length
  FROM grid g JOIN posts p ON p.cascade_idx = g.cascade_idx AND (p.is_root = 1 OR p.relative_time < g.end_time))"""
BIN = "CASE " + " ".join(f"WHEN relative_time <= {b} THEN {i}" for i, b in enumerate(temporal.BINS, 1)) + " ELSE 13 END"
SIZE = "CASE " + " ".join(f"WHEN total <= {b} THEN '{n}'" for b, n in temporal.SIZES) + " ELSE '5001+' END"
TIMES = f""",
rt AS (SELECT *, {BIN} AS bin FROM raw_posts WHERE is_root = 0 AND relative_time >= 0),
ct0 AS (SELECT r.cascade_idx, count(t.cascade_idx) AS total, {", ".join(f"count(CASE WHEN t.relative_time <= {s} THEN 1 END) AS cum_{k}" for k, s in temporal.CUMULATIVE.items())},
  {", ".join(f"count(CASE WHEN t.bin = {i} THEN 1 END) AS bin_{i}" for i in range(1, 8))} FROM roots r LEFT JOIN rt t USING (cascade_idx) GROUP BY ALL),
ct AS (SELECT *, {", ".join(f"round(CASE WHEN total > 0 THEN cum_{k} / total ELSE 0 END, 6) AS ratio_{k}" for k in temporal.CUMULATIVE)},
  CAST(cum_30m >= 8 AS INT) AS pass_30m_8, CAST(cum_2h >= 10 AS INT) AS pass_2h_10, {SIZE} AS size_bucket FROM ct0),
lists AS (SELECT 'A' AS list, cascade_idx, total FROM ct WHERE cum_30m >= 8 UNION ALL SELECT 'B', cascade_idx, total FROM ct WHERE cum_1h >= 8 UNION ALL SELECT 'C', cascade_idx, total FROM ct WHERE cum_2h >= 10)"""
TREE = """,
tree AS (SELECT c.cascade_idx, c.tweet_idx AS child_tweet_idx, c.user_idx AS child_user_idx, max({'a': p.relative_time, 'b': p.tweet_idx, 'c': p.user_idx}) AS m, c.relative_time,
    count(CASE WHEN p.relative_time >= c.relative_time - 1800 THEN 1 END) AS near, count(*) AS every
  FROM posts c JOIN posts p ON p.cascade_idx = c.cascade_idx AND p.relative_time < c.relative_time WHERE c.is_root = 0 GROUP BY ALL),
tr AS (SELECT cascade_idx, child_tweet_idx, child_user_idx, m.b AS parent_tweet_idx, m.c AS parent_user_idx, relative_time - m.a AS time_gap, CASE WHEN near > 0 THEN near ELSE every END AS candidate_count FROM tree)"""
USERS = """,
users AS (SELECT DISTINCT user_idx FROM posts),
sub AS (SELECT src, dst FROM follows WHERE src IN (SELECT user_idx FROM users) AND dst IN (SELECT user_idx FROM users))"""

# windows
_add("multiscale_window", lambda s, d: windows.multiscale_windows(_posts(s, d), _edges(s, d)), MULTI + " SELECT * FROM mw")
_add("fixed_window", lambda s, d: windows.fixed_windows(_posts(s, d), _edges(s, d)), MULTI + " SELECT cascade_idx, window_idx, end_time - 300 AS start_time, end_time, num_retweets_cur AS num_retweets, num_retweets_cum AS cum_retweets, num_active_users_cur AS num_active_users, num_edges_cur AS num_edges, delta_heat FROM mw")
_add("node_window", lambda s, d: windows.node_windows(_posts(s, d), _edges(s, d)), NODES + " SELECT * FROM nw")
_add("edge_window", lambda s, d: windows.edge_windows(_edges(s, d)), GRID + " SELECT e.cascade_idx, src, dst, dst_tweet, window_idx, 'current' AS window_scope FROM edges e JOIN win ON relative_time >= end_time - 300 AND relative_time < end_time UNION ALL SELECT e.cascade_idx, src, dst, dst_tweet, window_idx, 'context' FROM edges e JOIN win ON relative_time >= greatest(0, end_time - 600) AND relative_time < end_time WHERE relative_time >= 0")
_add("text_window", lambda s, d: windows.text_windows(_posts(s, d)), TEXTS + " SELECT * FROM tw")
_add("text_stats", lambda s, d: windows.text_stats(windows.text_windows(_posts(s, d))), TEXTS + " SELECT cascade_idx, window_idx, user_idx, count(*) AS num_texts_visible, count(CASE WHEN text_visible_type <> 'root_always_visible' THEN 1 END) AS num_texts_cur, round(avg(text_length), 6) AS avg_text_length FROM tw GROUP BY ALL")
_add("window_diagnostics", lambda s, d: windows.window_diagnostics(windows.multiscale_windows(_posts(s, d), _edges(s, d)), windows.node_windows(_posts(s, d), _edges(s, d)), windows.text_windows(_posts(s, d))), MULTI + NODES.replace(GRID, "") + TEXTS.replace(GRID, "") + " SELECT count(*) AS windows, count(CASE WHEN num_retweets_cur = 0 THEN 1 END) AS empty_windows, (SELECT count(*) FROM nw) AS node_rows, (SELECT count(CASE WHEN relative_time >= window_idx * 300 THEN 1 END) FROM tw WHERE text_visible_type <> 'root_always_visible') AS early_texts, (SELECT count(*) FROM tw WHERE text_visible_type <> 'root_always_visible') AS repost_texts FROM mw")
# base relations
_add("post_table", _posts, " SELECT *, 1704067200 + (cascade_idx - 1) * 86400 + relative_time AS time_epoch FROM posts")
_add("star_edges", _edges, " SELECT cascade_idx, src, dst, src_tweet, dst_tweet, relative_time FROM edges")
_add("quality_counters", lambda s, d: org.quality_counters(src.raw_posts(s, d)), " SELECT count(*) AS rows, count(CASE WHEN relative_time < 0 THEN 1 END) AS negative, count(CASE WHEN relative_time > 1800 THEN 1 END) AS late, count(CASE WHEN is_root = 1 THEN 1 END) AS roots, count(*) - (SELECT count(*) FROM posts) AS duplicates FROM raw_posts")
CASCADES = """,
seen AS (SELECT cascade_idx, count(*) AS n, count(CASE WHEN relative_time BETWEEN 0 AND 1800 THEN 1 END) AS o, max(relative_time) AS m, max(CASE WHEN relative_time BETWEEN 0 AND 1800 THEN relative_time END) AS d FROM raw_posts WHERE is_root = 0 GROUP BY ALL),
casc AS (SELECT cascade_idx, tweet_idx AS root_tweet_idx, user_idx AS root_user_idx, 1704067200 + (cascade_idx - 1) * 86400 AS root_time_epoch, coalesce(n, 0) AS final_retweet_count, coalesce(o, 0) AS observed_retweet_count, greatest(coalesce(m, 0), 0) AS duration, coalesce(d, 0) AS observed_duration FROM roots LEFT JOIN seen USING (cascade_idx)),
cascade_t AS (SELECT *, concat_ws(';', CASE WHEN observed_retweet_count < 8 THEN 'min_retweets' END, CASE WHEN observed_duration < 300 THEN 'min_duration' END, CASE WHEN root_user_idx <= 0 THEN 'bad_root_user_idx' END, CASE WHEN root_time_epoch <= 0 THEN 'bad_root_time_epoch' END) AS drop_reason FROM casc)"""
_add("cascade_table", lambda s, d: org.cascade_table(src.raw_posts(s, d)), CASCADES + " SELECT *, CAST(drop_reason = '' AS INT) AS valid_for_training FROM cascade_t")
_add("drop_reasons", lambda s, d: org.cascade_table(src.raw_posts(s, d)).groupBy("drop_reason").agg(F.count("*").alias("cascades")), CASCADES + " SELECT drop_reason, count(*) AS cascades FROM cascade_t GROUP BY ALL")
_add("size_distribution", lambda s, d: org.distribution(org.cascade_table(src.raw_posts(s, d)), "final_retweet_count"), CASCADES + " SELECT count(*) AS n, CAST(min(final_retweet_count) AS DOUBLE) AS min, CAST(max(final_retweet_count) AS DOUBLE) AS max, round(avg(final_retweet_count), 6) AS mean, " + ", ".join(f"round(quantile_cont(final_retweet_count, {q}), 6) AS {n}" for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + " FROM casc")
_add("user_table", lambda s, d: org.user_table(_posts(s, d)), " SELECT user_idx, 1 AS is_active_in_events, max(is_root) AS is_root_user, 1 - min(is_root) AS is_retweet_user, count(CASE WHEN is_root = 1 THEN 1 END) AS num_root_posts, count(CASE WHEN is_root = 0 THEN 1 END) AS num_retweets FROM posts WHERE user_idx > 0 GROUP BY ALL")
_add("org_node_window", lambda s, d: org.org_node_windows(_posts(s, d)), """,
we AS (SELECT *, CASE WHEN relative_time = 1800 THEN 6 ELSE relative_time // 300 + 1 END AS window_id FROM edges WHERE relative_time BETWEEN 0 AND 1800),
acts AS (SELECT cascade_idx, window_id, dst AS user_idx, 1 AS p, 1 AS i, 0 AS o FROM we UNION ALL SELECT cascade_idx, window_id, src, 0, 0, 1 FROM we UNION ALL SELECT cascade_idx, 1, user_idx, 1, 0, 0 FROM roots),
nn AS (SELECT cascade_idx, window_id, user_idx, CAST(sum(p) AS BIGINT) AS num_posts, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM acts GROUP BY ALL)
SELECT *, CAST(sum(in_degree) OVER w AS BIGINT) AS in_degree_cum, CAST(sum(out_degree) OVER w AS BIGINT) AS out_degree_cum FROM nn WINDOW w AS (PARTITION BY cascade_idx, user_idx ORDER BY window_id)""")
_add("follow_table", lambda s, d: org.follow_table(src.follows(s, d), _posts(s, d)), USERS + " SELECT * FROM (SELECT src, dst, CAST(src IN (SELECT user_idx FROM users) AS INT) AS src_active, CAST(dst IN (SELECT user_idx FROM users) AS INT) AS dst_active FROM follows) WHERE src_active + dst_active > 0")
_add("dedup_lines", lambda s, d: org.dedup_lines(src.table(s, d, "events").select((F.expr("event_id div 64")).alias("file"), F.col("event_type").alias("event"), "event_id"), ["event"], "event_id", "file"), " SELECT event_id // 64 AS file, event_type AS event, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 64, event_type ORDER BY event_id) = 1 OR trim(event_type) = ''")
_add("event_counters", lambda s, d: org.all_counters(src.raw_posts(s, d), src.raw_posts(s, d).where("is_root = 1 and cascade_idx > 2")), ", rr AS (SELECT * FROM roots WHERE cascade_idx > 2), e AS (SELECT p.*, r.cascade_idx IS NOT NULL AS known FROM raw_posts p LEFT JOIN rr r USING (cascade_idx) WHERE p.is_root = 0), g AS (SELECT *, row_number() OVER (PARTITION BY tweet_idx ORDER BY event_seq) AS rn FROM e WHERE known AND tweet_idx > 0 AND user_idx > 0), k AS (SELECT * FROM g WHERE rn = 1 AND tweet_idx NOT IN (SELECT tweet_idx FROM rr)) SELECT count(CASE WHEN NOT known THEN 1 END) AS missing_cascade_root, count(CASE WHEN known AND (tweet_idx <= 0 OR user_idx <= 0) THEN 1 END) AS bad_event_rows, count(CASE WHEN known AND user_idx <= 0 THEN 1 END) AS missing_user_idx, (SELECT count(CASE WHEN relative_time < 0 THEN 1 END) FROM g) AS negative_relative_time, (SELECT count(*) FROM g) - (SELECT count(*) FROM k) AS duplicate_tweet_idx, (SELECT count(CASE WHEN coalesce(text, '') = '' THEN 1 END) FROM k) AS missing_retweet_text, (SELECT count(CASE WHEN coalesce(text, '') = '' THEN 1 END) FROM rr) AS missing_root_text FROM e")
_add("overlapping_windows", lambda s, d: org.overlapping_windows(_posts(s, d)), " SELECT cascade_idx, tweet_idx, i AS window_id FROM posts JOIN range(1, 7) t(i) ON relative_time >= (i - 1) * 300 AND (relative_time < least((i - 1) * 300 + 600, 1800) OR (i = 6 AND relative_time = 1800))")
ACTIVITY = """, wa AS (SELECT cascade_idx, CASE WHEN is_root = 1 THEN 1 WHEN relative_time = 1800 THEN 6 ELSE relative_time // 300 + 1 END AS window_id, user_idx, is_root, CASE WHEN is_root = 1 THEN 0 ELSE relative_time END AS t, CAST(coalesce(text, '') <> '' AS INT) AS h FROM posts WHERE is_root = 1 OR relative_time BETWEEN 0 AND 1800),
wx AS (SELECT cascade_idx, window_id, user_idx, count(*) AS active_count, count(CASE WHEN is_root = 0 THEN 1 END) AS retweet_count, CAST(sum(h) AS BIGINT) AS text_count, min(t) AS first_active_time, max(t) AS last_active_time, max(is_root) AS is_root, max(h) AS has_text FROM wa GROUP BY ALL)"""
_add("window_activity", lambda s, d: org.window_activity(_posts(s, d)), ACTIVITY + " SELECT * FROM wx")
_add("window_sizes", lambda s, d: org.window_sizes(org.window_activity(_posts(s, d))), ACTIVITY + ", n AS (SELECT cascade_idx, window_id, count(*) AS nodes, sum(retweet_count) AS retweets FROM wx GROUP BY ALL) SELECT count(*) AS windows, round(avg(nodes), 6) AS avg_nodes, round(quantile_cont(nodes, 0.5), 6) AS median_nodes, round(avg(retweets), 6) AS avg_retweets, round(quantile_cont(retweets, 0.5), 6) AS median_retweets FROM n")
_add("integrity", lambda s, d: org.integrity(src.raw_posts(s, d), _posts(s, d), org.window_activity(_posts(s, d))), ACTIVITY + " SELECT CAST(bool_and(cascade_idx > 0 AND tweet_idx > 0 AND user_idx > 0) AS INT) AS all_positive, (SELECT CAST(bool_and(window_id BETWEEN 1 AND 6) AS INT) FROM wx) AS windows_in_range, CAST(count(DISTINCT cascade_idx) = count(DISTINCT CASE WHEN is_root = 1 THEN cascade_idx END) AS INT) AS roots_exist, CAST(count(DISTINCT cascade_idx) = (SELECT count(DISTINCT CASE WHEN is_root = 1 AND window_id = 1 THEN cascade_idx END) FROM wx) AS INT) AS roots_in_first_window FROM posts")
_add("setting_sweep", lambda s, d: org.setting_sweep(src.raw_posts(s, d)), ", v AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {o}, {m}, {x})" for k, (o, _, _, m, x) in org.SETTINGS.items()) + ") t(setting, o, m, x)), p AS (SELECT setting, r.cascade_idx, count(CASE WHEN e.relative_time BETWEEN 0 AND o THEN 1 END) < m AS few, coalesce(max(CASE WHEN e.relative_time BETWEEN 0 AND o THEN e.relative_time END), 0) < x AS short FROM v CROSS JOIN roots r LEFT JOIN raw_posts e ON e.cascade_idx = r.cascade_idx AND e.is_root = 0 GROUP BY setting, r.cascade_idx, m, x) SELECT setting, count(*) AS cascades, count(CASE WHEN NOT few AND NOT short THEN 1 END) AS valid, count(CASE WHEN few THEN 1 END) AS min_retweets, count(CASE WHEN short THEN 1 END) AS min_duration FROM p GROUP BY ALL")
# time
_add("cascade_times", lambda s, d: temporal.cascade_times(src.raw_posts(s, d)), TIMES + " SELECT * FROM ct")
_add("bin_summary", lambda s, d: temporal.bin_summary(src.raw_posts(s, d)), TIMES + " SELECT i AS bin, count(bin) AS retweets, count(DISTINCT cascade_idx) AS cascades, round(count(bin) / (SELECT count(*) FROM rt), 6) AS ratio FROM range(1, 14) t(i) LEFT JOIN rt ON bin = i GROUP BY ALL")
_add("size_by_bin", lambda s, d: temporal.size_by_bin(src.raw_posts(s, d)), TIMES + f" SELECT z AS size_bucket, i AS bin, count(rt.cascade_idx) AS retweets FROM (SELECT unnest([{', '.join(repr(n) for _, n in temporal.SIZES)}, '5001+']) AS z) CROSS JOIN range(1, 14) t(i) LEFT JOIN (SELECT rt.*, size_bucket FROM rt JOIN ct USING (cascade_idx)) rt ON rt.bin = i AND rt.size_bucket = z GROUP BY ALL")
_add("observation_sweep", lambda s, d: temporal.observation_sweep(src.raw_posts(s, d)), TIMES + f", combo AS (SELECT * FROM (VALUES {', '.join(f'({o}, {m})' for o, m in temporal.SWEEP)}) v(obs, min_retweets)), per AS (SELECT obs, min_retweets, r.cascade_idx, count(CASE WHEN rt.relative_time <= obs THEN 1 END) AS n, coalesce(max(CASE WHEN rt.relative_time <= obs THEN rt.relative_time END), 0) AS d FROM combo CROSS JOIN roots r LEFT JOIN rt USING (cascade_idx) GROUP BY ALL) SELECT CAST(obs AS BIGINT) AS obs_seconds, CAST(min_retweets AS BIGINT) AS min_retweets, count(CASE WHEN n >= min_retweets THEN 1 END) AS num_pass_cascades, round(count(CASE WHEN n >= min_retweets THEN 1 END) / count(*), 6) AS pass_ratio, round(avg(n), 6) AS avg_observed_retweets, round(quantile_cont(n, 0.5), 6) AS median_observed_retweets, round(avg(d), 6) AS avg_observed_duration, round(quantile_cont(d, 0.5), 6) AS median_observed_duration FROM per GROUP BY ALL")
_add("largest_cascade", lambda s, d: temporal.largest_cascade(src.raw_posts(s, d)), TIMES + " SELECT cascade_idx, total FROM ct ORDER BY total DESC, cascade_idx LIMIT 1")
_add("dev_lists", lambda s, d: temporal.dev_lists(src.raw_posts(s, d)), TIMES + " SELECT * FROM lists")
_add("dev_summary", lambda s, d: temporal.dev_summary(src.raw_posts(s, d)), TIMES + " SELECT list, count(*) AS cascades, round(avg(total), 6) AS mean_total, round(quantile_cont(total, 0.5), 6) AS median_total FROM lists GROUP BY ALL")
# graphs
_add("time_only_tree", lambda s, d: graph.time_only_tree(_posts(s, d)), TREE + " SELECT * FROM tr")
_add("tree_parents", lambda s, d: graph.tree_parents(graph.time_only_tree(_posts(s, d))), TREE + ", n AS (SELECT cascade_idx, parent_tweet_idx, count(*) AS c FROM tr GROUP BY ALL), x AS (SELECT *, c / sum(c) OVER (PARTITION BY cascade_idx) AS p FROM n) SELECT cascade_idx, CAST(sum(c) AS BIGINT) AS edges, count(*) AS parents, count(CASE WHEN c > 1 THEN 1 END) AS branching, round(max(p), 6) AS top_share, round(-sum(p * ln(p + 1e-12)), 6) AS entropy FROM x GROUP BY ALL")
_add("parent_similarity", lambda s, d: graph.parent_similarity(graph.time_only_tree(_posts(s, d)), _posts(s, d)), TREE + """, g AS (SELECT tweet_idx, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM posts),
gg AS (SELECT tweet_idx, CASE WHEN length(t) <= 2 THEN [t] ELSE list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) END AS b FROM g)
SELECT cascade_idx, child_tweet_idx, parent_tweet_idx, round(len(list_intersect(c.b, p.b)) / len(list_distinct(list_concat(c.b, p.b))), 6) AS text_similarity FROM tr JOIN gg c ON c.tweet_idx = child_tweet_idx JOIN gg p ON p.tweet_idx = parent_tweet_idx""")
_add("follow_subgraph", lambda s, d: graph.follow_subgraph(src.follows(s, d), _posts(s, d)), USERS + " SELECT * FROM sub")
_add("symmetric_pairs", lambda s, d: graph.symmetric_pairs(src.follows(s, d), _posts(s, d)), USERS + " SELECT src, dst FROM sub UNION SELECT dst, src FROM sub")
_add("candidate_edges", lambda s, d: graph.candidate_edges(src.follows(s, d), _posts(s, d)), ", v AS (SELECT *, row_number() OVER (PARTITION BY cascade_idx ORDER BY user_idx) - 1 AS i FROM (SELECT DISTINCT cascade_idx, user_idx FROM posts)) SELECT a.cascade_idx, src, dst, a.i AS src_local, b.i AS dst_local FROM follows JOIN v a ON a.user_idx = src JOIN v b ON b.user_idx = dst AND a.cascade_idx = b.cascade_idx")
_add("clustering", lambda s, d: graph.clustering(src.follows(s, d)), ", e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM follows WHERE src <> dst), b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), k AS (SELECT u, count(*) AS degree FROM b GROUP BY ALL), t AS (SELECT x.u, count(*) AS n FROM b x JOIN b y ON x.u = y.u AND x.v < y.v JOIN e ON e.u = x.v AND e.v = y.v GROUP BY ALL) SELECT k.u AS user_idx, degree, round(CASE WHEN degree > 1 THEN 2 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM k LEFT JOIN t ON t.u = k.u")
# labels
_add("hash_split", lambda s, d: _posts(s, d).where("is_root = 1").select("cascade_idx", labels.split_of(F.col("cascade_idx")).alias("split")), ", h AS (SELECT cascade_idx, CAST('0x' || substr(md5(CAST(cascade_idx AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS x FROM roots) SELECT cascade_idx, CASE WHEN x < 70 THEN 'train' WHEN x < 85 THEN 'valid' ELSE 'test' END AS split FROM h")


def _score_ranked(s, d):
    posts = written(_posts(s, d), "posts")
    edges = org.star_edges(posts)
    return labels.score_rank_labels(labels.components(windows.multiscale_windows(posts, edges), windows.node_windows(posts, edges), windows.text_stats(windows.text_windows(posts))))


_add("score_rank_labels", _score_ranked, MULTI + NODES.replace(GRID, "") + TEXTS.replace(GRID, "") + """,
w AS (SELECT cascade_idx, max(greatest(delta_heat, 0)) AS md, max(num_retweets_cur) AS mh, sum(num_retweets_cur) AS rt, count(CASE WHEN num_retweets_cur > 0 THEN 1 END) AS aw, count(*) AS ww FROM mw GROUP BY ALL),
vt AS (SELECT cascade_idx, window_idx, user_idx, count(*) AS texts FROM tw GROUP BY ALL),
n AS (SELECT cascade_idx, max(num_posts_cum) AS tp, sum(coalesce(texts, 0)) AS tx, count(*) AS nr, max(in_degree_cum + out_degree_cum) AS td, sum(in_degree_cum + out_degree_cum) AS sd FROM nw LEFT JOIN vt USING (cascade_idx, window_idx, user_idx) GROUP BY ALL),
c AS (SELECT cascade_idx, CAST(md + mh AS DOUBLE) AS c1, tp / greatest(rt, 1) AS c2, tx / greatest(nr, 1) AS c3, td / greatest(sd, 1) AS c4, aw / greatest(ww, 1) AS c5 FROM w JOIN n USING (cascade_idx)),
z AS (SELECT cascade_idx, round(""" + " + ".join(f"{k} * coalesce((c{i} - min(c{i}) OVER ()) / nullif(max(c{i}) OVER () - min(c{i}) OVER (), 0), 0)" for i, k in enumerate(labels.WEIGHTS.values(), 1)) + """, 8) AS weak_score FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY weak_score, cascade_idx) - 1 AS rank, floor(0.5 * count(*) OVER ()) AS low, floor(0.8 * count(*) OVER ()) AS high, count(*) OVER () AS total FROM z),
h AS (SELECT *, CAST('0x' || substr(md5(CAST(cascade_idx AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS x FROM r)
SELECT cascade_idx, weak_score, rank, CASE WHEN rank < low THEN 0 WHEN rank >= high THEN 1 ELSE -1 END AS weak_label, round(CASE WHEN rank < low THEN 1 - rank / greatest(low, 1) WHEN rank >= high THEN (rank - high + 1) / greatest(total - high, 1) ELSE 0 END, 8) AS label_confidence, CASE WHEN x < 70 THEN 'train' WHEN x < 85 THEN 'valid' ELSE 'test' END AS split FROM h""")
_add("bucket_percentiles", lambda s, d: labels.bucket_percentiles(org.cascade_table(src.raw_posts(s, d)).select("cascade_idx", F.col("observed_duration"), labels.event_size_bucket(F.col("observed_retweet_count")).alias("bucket")), "observed_duration", "bucket"), CASCADES + ", b AS (SELECT cascade_idx, observed_duration, CASE WHEN observed_retweet_count < 8 THEN '<8' WHEN observed_retweet_count < 20 THEN '8-20' WHEN observed_retweet_count < 50 THEN '20-50' WHEN observed_retweet_count < 100 THEN '50-100' WHEN observed_retweet_count < 300 THEN '100-300' ELSE '300+' END AS bucket FROM casc) SELECT cascade_idx, bucket, observed_duration, round(CASE WHEN count(*) OVER (PARTITION BY bucket) > 1 THEN (row_number() OVER (PARTITION BY bucket ORDER BY observed_duration, cascade_idx) - 1) / (count(*) OVER (PARTITION BY bucket) - 1) ELSE 1 END, 6) AS percentile FROM b")


def _scored(s, d, posts=None):
    posts = written(_posts(s, d), "posts") if posts is None else posts  # read by seven inputs, so duplicates go once
    edges = org.star_edges(posts)
    tree = graph.time_only_tree(posts)
    alike = graph.parent_similarity(tree, posts).join(tree, ["cascade_idx", "child_tweet_idx", "parent_tweet_idx"]).groupBy("cascade_idx", F.col("child_user_idx").alias("user_idx")).agg(F.round(F.avg("text_similarity") + labels.HALF_UP, 8).alias("text_score"))
    raw = labels.event_features(org.cascade_table(src.raw_posts(s, d)), windows.multiscale_windows(posts, edges), windows.node_windows(posts, edges, texts=True, users=alike), graph.candidate_edges(src.follows(s, d), posts))
    return labels.percentile_scores(raw, labels.RAW)


def _consensus(s, d):
    x = _scored(s, d)
    first = labels.stratified_labels(x)
    return labels.consensus_labels(first, labels.vote_labels(labels.votes(x), first), labels.network_labels(x))


def _voted(s, d):
    x = _scored(s, d)
    return labels.vote_labels(labels.votes(x), labels.stratified_labels(x))


def _place(k: str) -> str:
    return f"round(CASE WHEN count(*) OVER (PARTITION BY bucket) > 1 THEN (row_number() OVER (PARTITION BY bucket ORDER BY {k}, cascade_idx) - 1) / (count(*) OVER (PARTITION BY bucket) - 1) ELSE 1 END, 8)"


def _quantile(k: str, q: float) -> str:
    return f"round(quantile_cont({k}, {q}) OVER (PARTITION BY bucket), 8)"


RAWS = MULTI + NODES.replace(GRID, "") + TEXTS.replace(GRID, "") + CASCADES + TREE + """,
g AS (SELECT tweet_idx, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM posts),
gg AS (SELECT tweet_idx, CASE WHEN length(t) <= 2 THEN [t] ELSE list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) END AS b FROM g),
alike AS (SELECT cascade_idx, child_user_idx AS user_idx, round(avg(round(len(list_intersect(c.b, p.b)) / len(list_distinct(list_concat(c.b, p.b))), 6)) + 1e-11, 8) AS text_score
  FROM tr JOIN gg c ON c.tweet_idx = child_tweet_idx JOIN gg p ON p.tweet_idx = parent_tweet_idx GROUP BY ALL),
seen_texts AS (SELECT cascade_idx, window_idx, user_idx, count(*) AS texts FROM tw GROUP BY ALL),
vis AS (SELECT DISTINCT cascade_idx, user_idx FROM posts),
cand AS (SELECT a.cascade_idx, count(*) AS candidates FROM follows JOIN vis a ON a.user_idx = src JOIN vis b ON b.user_idx = dst AND a.cascade_idx = b.cascade_idx GROUP BY ALL),
ew AS (SELECT cascade_idx, sum(num_active_users_cur) AS au, max(num_retweets_cur) AS mh, max(greatest(delta_heat, 0)) AS md, count(CASE WHEN num_retweets_cur > 0 THEN 1 END) AS aw FROM mw GROUP BY ALL),
en AS (SELECT cascade_idx, count(*) AS nr, count(DISTINCT user_idx) AS us, max(num_posts_cum) AS tp, sum(coalesce(texts, 0)) AS tx, round(sum(coalesce(text_score, 0)) + 1e-11, 6) AS ts, max(in_degree_cum + out_degree_cum) AS td,
    sum(in_degree_cum + out_degree_cum) AS sd, sum(in_degree_ctx + out_degree_ctx) AS sx,
    stddev_pop(CASE WHEN num_posts_cum > 0 OR texts > 0 THEN first_seen_time END) AS fs, max(CASE WHEN num_posts_cum > 0 OR texts > 0 THEN first_seen_time END) - min(CASE WHEN num_posts_cum > 0 OR texts > 0 THEN first_seen_time END) AS sp
  FROM nw LEFT JOIN seen_texts USING (cascade_idx, window_idx, user_idx) LEFT JOIN alike USING (cascade_idx, user_idx) GROUP BY ALL),
ea AS (SELECT cascade_idx, observed_retweet_count AS o, greatest(observed_duration, 1) AS du, coalesce(au, 0) AS au, coalesce(mh, 0) AS mh, coalesce(md, 0) AS md, coalesce(aw, 0) AS aw, greatest(coalesce(nr, 0), 1) AS nr, coalesce(us, 0) AS us, greatest(coalesce(us, 0), 1) AS u,
    coalesce(tp, 0) AS tp, coalesce(tx, 0) AS tx, coalesce(ts, 0) AS ts, coalesce(td, 0) AS td, greatest(coalesce(sd, 0), 1) AS sd, coalesce(sx, 0) AS sx, coalesce(fs, 0) AS fs, coalesce(sp, 0) AS sp, coalesce(candidates, 0) AS ca
  FROM cascade_t LEFT JOIN ew USING (cascade_idx) LEFT JOIN en USING (cascade_idx) LEFT JOIN cand USING (cascade_idx)),
eb AS (SELECT *, au / (aw + 1) + u / ln(1 + du) AS co, td / sd + sx / nr + ca / (u * u) AS st FROM ea),
er AS (SELECT cascade_idx, CASE WHEN o < 8 THEN '<8' WHEN o < 20 THEN '8-20' WHEN o < 50 THEN '20-50' WHEN o < 100 THEN '50-100' WHEN o < 300 THEN '100-300' ELSE '300+' END AS bucket,
    round(md + mh + mh / (o + 1) + 1e-11, 8) AS burst, round(co + 1e-11, 8) AS coordination, round(st + 1e-11, 8) AS structure, round(ts / nr + tx / nr + tp / (o + 1) + 1e-11, 8) AS text, round(1 / (fs + 1) + mh / (o + 1) + 1e-11, 8) AS temporal_sync,
    round(ca / (u * greatest(u - 1, 1)) + 1e-11, 8) AS follow_density, round(ln(1 + o) + sp / 1800 - co - st + 1e-11, 8) AS natural_spread, us, ca, mh, ts, sx FROM eb),
es AS (SELECT *, """ + ", ".join(f"{_place(k)} AS {k}_score" for k in labels.RAW) + """ FROM er)"""
V2 = """,
s2 AS (SELECT *, round(burst_score * 0.25 + coordination_score * 0.3 + structure_score * 0.25 + text_score * 0.2, 8) AS weak_score,
    CAST(burst_score >= 0.8 AS INT) + CAST(coordination_score >= 0.8 AS INT) + CAST(structure_score >= 0.8 AS INT) + CAST(text_score >= 0.8 AS INT) AS hits FROM es),
q2 AS (SELECT *, """ + f"{_quantile('weak_score', 0.5)} AS w50, {_quantile('weak_score', 0.8)} AS w80" + """ FROM s2),
v2 AS (SELECT cascade_idx, bucket, weak_score, hits, CASE WHEN bucket = '<8' THEN -1 WHEN weak_score >= w80 AND hits >= 2 THEN 1 WHEN weak_score <= w50 AND hits <= 1 THEN 0 ELSE -1 END AS label,
    round(least(abs(weak_score - 0.5) * (1 + hits / 4), 1), 6) AS confidence FROM q2)"""
V3 = """,
f3 AS (SELECT *, """ + ", ".join(f"CASE WHEN {k}_score >= 0.8 THEN 1 ELSE -1 END AS lf_{k}" for k in ("burst", "temporal_sync", "structure", "text", "follow_density")) + """,
    CASE WHEN natural_spread_score >= 0.7 AND coordination_score <= 0.5 THEN 0 ELSE -1 END AS lf_natural, CASE WHEN coordination_score <= 0.3 AND burst_score <= 0.7 THEN 0 ELSE -1 END AS lf_low_coordination,
    CASE WHEN structure_score <= 0.3 AND follow_density_score <= 0.4 THEN 0 ELSE -1 END AS lf_low_structure FROM q2),
p3 AS (SELECT *, greatest(lf_burst, 0) + greatest(lf_temporal_sync, 0) + greatest(lf_structure, 0) + greatest(lf_text, 0) + greatest(lf_follow_density, 0) AS pos, lf_natural + lf_low_coordination + lf_low_structure + 3 AS neg FROM f3),
c3 AS (SELECT *, CASE WHEN pos + neg > 0 THEN greatest(pos, neg) / (pos + neg) ELSE 0 END AS conf FROM p3),
v3 AS (SELECT cascade_idx, pos, neg, CASE WHEN bucket <> '<8' AND pos >= 2 AND conf >= 0.6 AND weak_score >= w80 THEN 1 WHEN bucket <> '<8' AND neg >= 2 AND pos = 0 AND weak_score <= w50 THEN 0 ELSE -1 END AS label, round(conf, 6) AS confidence FROM c3)"""
V4 = """,
a4 AS (SELECT *, CAST(ca + greatest(mh - 1, 0) + floor(ts) + sx AS DOUBLE) AS ed FROM es),
b4 AS (SELECT cascade_idx, bucket, CAST(ed AS BIGINT) AS edges, round(ed / greatest(us * greatest(us - 1, 1), 1), 8) AS density, round(CASE WHEN us > 0 THEN least(1, (sqrt(ed) + 1) / us) ELSE 0 END, 8) AS largest,
    round(least(1, (sx + floor(ts)) / (ed + 1)), 8) AS clustering, round(ca / (ed + 1), 8) AS follow_ratio, 0 AS none FROM a4),
c4 AS (SELECT *, """ + ", ".join(f"{_place(k)} AS {k}_score" for k in ("density", "largest", "clustering", "follow_ratio", "none")) + """ FROM b4),
d4 AS (SELECT *, round(density_score * 0.25 + largest_score * 0.25 + clustering_score * 0.15 + none_score * 0.15 + none_score * 0.1 + follow_ratio_score * 0.1, 8) AS network FROM c4),
e4 AS (SELECT *, """ + ", ".join(f"{_quantile(k, q)} AS {n}" for k, q, n in (("network", 0.4, "n40"), ("network", 0.8, "n80"), ("largest_score", 0.4, "l40"), ("largest_score", 0.7, "l70"), ("density_score", 0.4, "d40"), ("density_score", 0.7, "d70"))) + """ FROM d4),
v4 AS (SELECT cascade_idx, edges, network, CASE WHEN bucket <> '<8' AND network >= n80 AND largest_score >= l70 AND density_score >= d70 THEN 1 WHEN bucket <> '<8' AND network <= n40 AND largest_score <= l40 AND density_score <= d40 THEN 0 ELSE -1 END AS label,
    round(least(1, 2 * abs(network - 0.5)) + 1e-11, 6) AS confidence FROM e4)"""
V5 = V2 + V3 + V4 + """,
x5 AS (SELECT cascade_idx, CAST(v2.label = 1 AS INT) + CAST(v3.label = 1 AS INT) + CAST(v4.label = 1 AS INT) AS pos, CAST(v2.label = 0 AS INT) + CAST(v3.label = 0 AS INT) + CAST(v4.label = 0 AS INT) AS neg FROM v2 JOIN v3 USING (cascade_idx) JOIN v4 USING (cascade_idx))"""
_add("event_scores", lambda s, d: _scored(s, d).select("cascade_idx", "bucket", *labels.RAW, *(f"{k}_score" for k in labels.RAW)), RAWS + " SELECT cascade_idx, bucket, " + ", ".join(f"{k}, {k}_score" for k in labels.RAW) + " FROM es")
_add("stratified_labels", lambda s, d: labels.stratified_labels(_scored(s, d)), RAWS + V2 + " SELECT * FROM v2")
RULES = ("lf_burst", "lf_temporal_sync", "lf_structure", "lf_text", "lf_follow_density", "lf_natural", "lf_low_coordination", "lf_low_structure")
_add("rule_votes", lambda s, d: labels.votes(_scored(s, d)).select("cascade_idx", *RULES, "pos", "neg"), RAWS + V2 + V3 + f" SELECT cascade_idx, {', '.join(RULES)}, pos, neg FROM p3")
_add("vote_labels", _voted, RAWS + V2 + V3 + " SELECT * FROM v3")
_add("network_labels", lambda s, d: labels.network_labels(_scored(s, d)), RAWS + V4 + " SELECT * FROM v4")
_add("consensus_labels", _consensus, RAWS + V5 + " SELECT cascade_idx, pos, neg, CASE WHEN pos >= 2 AND neg = 0 THEN 1 WHEN neg >= 2 AND pos = 0 THEN 0 ELSE -1 END AS label, round(greatest(pos, neg) / 3, 6) AS confidence, CAST(pos > 0 AND neg > 0 AS INT) AS conflict FROM x5")

# predictions
EDGES = " + ".join(f"CAST(y_prob >= CAST({i} AS DOUBLE) / 10 AS BIGINT)" for i in range(1, 10))
CONF = ", c AS (SELECT count(CASE WHEN y_prob >= 0.5 AND y_true = 1 THEN 1 END) AS tp, count(CASE WHEN y_prob >= 0.5 AND y_true = 0 THEN 1 END) AS fp, count(CASE WHEN y_prob < 0.5 AND y_true = 1 THEN 1 END) AS fn, count(CASE WHEN y_prob < 0.5 AND y_true = 0 THEN 1 END) AS tn FROM preds), d AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, tn / greatest(tn + fp, 1) AS s, tn / greatest(tn + fn, 1) AS v FROM c)"
_add("confusion", lambda s, d: metrics.confusion(src.predictions(s, d)), CONF + " SELECT tp, fp, fn, tn, round((tp + tn) / greatest(tp + tn + fp + fn, 1), 6) AS accuracy, round((r + s) / 2, 6) AS balanced_accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(s, 6) AS specificity, round(2 * p * r / greatest(p + r, 1e-12), 6) AS f1, round((2 * p * r / greatest(p + r, 1e-12) + 2 * v * s / greatest(v + s, 1e-12)) / 2, 6) AS macro_f1, round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(greatest(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn), 1)), 6) AS mcc FROM d")
_add("roc_auc", lambda s, d: metrics.roc_auc(src.predictions(s, d)), ", r AS (SELECT y_true, rank() OVER (ORDER BY y_prob) + (count(*) OVER (PARTITION BY y_prob) - 1) / 2 AS k FROM preds), t AS (SELECT sum(CASE WHEN y_true = 1 THEN k END) AS s, count(CASE WHEN y_true = 1 THEN 1 END) AS p, count(CASE WHEN y_true = 0 THEN 1 END) AS n FROM r) SELECT round(CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2) / p / n ELSE 0.5 END, 6) AS auc FROM t")
RANKED = ", rk AS (SELECT *, row_number() OVER w AS k, sum(y_true) OVER w AS h FROM preds WINDOW w AS (ORDER BY y_prob DESC, row_seq))"
_add("average_precision", lambda s, d: metrics.average_precision(src.predictions(s, d)), RANKED + " SELECT round(sum(CASE WHEN y_true = 1 THEN h / k END) / sum(y_true), 6) AS average_precision FROM rk")
_add("brier_nll", lambda s, d: metrics.brier_nll(src.predictions(s, d)), " SELECT round(avg((y_prob - y_true) * (y_prob - y_true)), 6) AS brier, round(avg(-(y_true * ln(greatest(least(y_prob, 1 - 1e-12), 1e-12)) + (1 - y_true) * ln(1 - greatest(least(y_prob, 1 - 1e-12), 1e-12)))), 6) AS nll FROM preds")
_add("calibration_bins", lambda s, d: metrics.calibration_bins(src.predictions(s, d)), f" SELECT {EDGES} AS bin, count(*) AS n, round(avg(y_prob), 6) AS confidence, round(avg(y_true), 6) AS accuracy FROM preds GROUP BY 1")
_add("calibration_error", lambda s, d: metrics.calibration_error(src.predictions(s, d)), f", b AS (SELECT {EDGES} AS bin, count(*) AS n, abs(avg(y_prob) - avg(y_true)) AS gap FROM preds GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM b")
_add("precision_at_k", lambda s, d: metrics.at_k(src.predictions(s, d)), RANKED + " SELECT CAST(kk AS BIGINT) AS k, round(sum(y_true) / count(*), 6) AS precision, round(sum(y_true) / (SELECT greatest(sum(y_true), 1) FROM preds), 6) AS recall FROM rk JOIN (VALUES (10), (100), (500)) v(kk) ON k <= kk GROUP BY kk")
_add("best_threshold", lambda s, d: metrics.best_threshold(src.predictions(s, d)), ", t AS (SELECT y_prob, sum(sum(y_true)) OVER w AS tp, sum(count(*)) OVER w AS n, (SELECT sum(y_true) FROM preds) AS p FROM preds GROUP BY y_prob WINDOW w AS (ORDER BY y_prob DESC)), f AS (SELECT y_prob, round(tp / greatest(n, 1), 9) AS pr, round(2 * (tp / greatest(n, 1)) * (tp / greatest(p, 1)) / greatest(tp / greatest(n, 1) + tp / greatest(p, 1), 1e-12), 9) AS f1 FROM t) SELECT round(y_prob, 6) AS threshold, round(f1, 6) AS f1, round(pr, 6) AS precision FROM f ORDER BY f.f1 DESC, pr DESC, y_prob LIMIT 1")


# features
WFEAT = MULTI + """,
wf AS (SELECT cascade_idx, window_idx, """ + ", ".join(f"{k}_{c}" for k in ("num_retweets", "num_active_users") for c in ("cur", "ctx", "cum")) + """, num_edges_cur, num_edges_ctx, CAST(num_retweets_cur AS DOUBLE) AS heat_cur, CAST(num_retweets_ctx AS DOUBLE) AS heat_ctx, CAST(num_retweets_cum AS DOUBLE) AS heat_cum, CAST(delta_heat AS DOUBLE) AS delta_heat_cur FROM mw)"""
_add("window_features", lambda s, d: features.window_features(windows.multiscale_windows(_posts(s, d), _edges(s, d))), WFEAT + " SELECT * FROM wf")
_add("window_features_v2", lambda s, d: features.window_features_v2(windows.multiscale_windows(_posts(s, d), _edges(s, d))), WFEAT + """, wl AS (SELECT *, CAST(num_active_users_cur AS DOUBLE) AS a, lag(heat_cur, 1, 0.0) OVER o AS h0, lag(delta_heat_cur, 1, 0.0) OVER o AS d0, lag(num_active_users_cur, 1, 0) OVER o AS a0, count(*) OVER (PARTITION BY cascade_idx) AS t,
  num_edges_cur / greatest(num_active_users_cur * greatest(num_active_users_cur - 1, 1), 1) AS dn, num_edges_ctx / greatest(num_active_users_ctx * greatest(num_active_users_ctx - 1, 1), 1) AS dx FROM wf WINDOW o AS (PARTITION BY cascade_idx ORDER BY window_idx))
SELECT * EXCLUDE (a, h0, d0, a0, t, dn, dx), round((window_idx - 1) / greatest(t - 1, 1), 8) AS window_position_norm, round(delta_heat_cur / greatest(h0, 1), 8) AS retweet_growth_rate, round(delta_heat_cur - d0, 8) AS retweet_acceleration, round((a - a0) / greatest(a0, 1), 8) AS active_user_growth_rate, round(a / greatest(num_active_users_cum, 1), 8) AS active_user_ratio,
  round(dn, 8) AS edge_density_cur, round(dx, 8) AS edge_density_ctx, round(dn - dx, 8) AS edge_density_gap, round(heat_cur / greatest(a, 1), 8) AS heat_per_user_cur, round(heat_cur / greatest(num_edges_cur, 1), 8) AS heat_per_edge_cur, round(delta_heat_cur / greatest(heat_cur, 1), 8) AS burstiness_ratio, round(a / greatest(num_retweets_cum, 1), 8) AS active_span_ratio FROM wl""")
_add("node_features", lambda s, d: features.node_features(windows.node_windows(_posts(s, d), _edges(s, d)), windows.text_windows(_posts(s, d))), NODES + TEXTS.replace(GRID, "") + ", ts AS (SELECT cascade_idx, window_idx, user_idx, count(CASE WHEN text_visible_type <> 'root_always_visible' THEN 1 END) AS tc, count(*) AS tv, round(avg(CASE WHEN text_visible_type <> 'root_always_visible' THEN text_length END), 8) AS lc, round(avg(text_length), 8) AS lv FROM tw GROUP BY ALL) SELECT nw.*, coalesce(tc, 0) AS num_texts_cur, coalesce(tv, 0) AS num_texts_visible, coalesce(lc, 0) AS avg_text_len_cur, coalesce(lv, 0) AS avg_text_len_visible FROM nw LEFT JOIN ts USING (cascade_idx, window_idx, user_idx)")
NFEAT = NODES + """, nl AS (SELECT *, CAST(in_degree_cur + out_degree_cur AS DOUBLE) AS gc, CAST(in_degree_ctx + out_degree_ctx AS DOUBLE) AS gx, CAST(in_degree_cum + out_degree_cum AS DOUBLE) AS gm, sum(num_posts_cur) OVER w AS pw, sum(in_degree_cur + out_degree_cur) OVER w AS dw, count(CASE WHEN num_posts_cur > 0 THEN 1 END) OVER w AS aw,
  sum(num_posts_cum) OVER c AS pc, sum(in_degree_cum + out_degree_cum) OVER c AS dc, max(window_idx) OVER c AS t, lag(num_posts_cur, 1, 0) OVER (PARTITION BY cascade_idx, user_idx ORDER BY window_idx) AS p0 FROM nw WINDOW w AS (PARTITION BY cascade_idx, window_idx), c AS (PARTITION BY cascade_idx)),
nf AS (SELECT cascade_idx, window_idx, user_idx, CAST(num_posts_cur - num_posts_ctx AS DOUBLE) AS num_posts_delta_cur, round((num_posts_cur - num_posts_ctx) / greatest(num_posts_ctx, 1), 8) AS num_posts_growth_rate, CAST(out_degree_cur - in_degree_cur AS DOUBLE) AS degree_balance_cur, CAST(out_degree_ctx - in_degree_ctx AS DOUBLE) AS degree_balance_ctx, CAST(out_degree_cum - in_degree_cum AS DOUBLE) AS degree_balance_cum,
  round((gc - gx) / greatest(gx, 1), 8) AS degree_growth_rate, round(active_window_count / greatest(t, 1), 8) AS active_window_ratio, round(num_posts_cur / greatest(time_since_first_seen + 1, 1), 8) AS activity_intensity, round(first_seen_time / greatest(first_seen_time + time_since_first_seen, 1), 8) AS first_seen_norm, round(time_since_first_seen / greatest(first_seen_time + time_since_first_seen, 1), 8) AS time_since_first_seen_norm,
  round((window_idx - 1) / greatest(t - 1, 1), 8) AS window_position_norm, round(CASE WHEN num_posts_cur > 0 THEN 1 / greatest(aw, 1) ELSE 0 END, 8) AS same_window_active_share, round(num_posts_cur / greatest(pw, 1), 8) AS same_window_post_share, round(num_posts_cur / greatest(pw, 1), 8) AS node_contribution_share_cur, round(num_posts_cum / greatest(pc, 1), 8) AS node_contribution_share_cum,
  round(gc / greatest(dw, 1), 8) AS node_degree_share_cur, round(gm / greatest(dc, 1), 8) AS node_degree_share_cum, CAST(num_posts_cur > 0 AND p0 <= 0 AND num_posts_cum > num_posts_cur AS INT) AS reactivation_flag FROM nl)"""
PROFILED = ["num_posts_growth_rate", "degree_growth_rate", "active_window_ratio", "node_contribution_share_cum", "node_degree_share_cum", "reactivation_flag"]


def _node_v2(s, d):
    return features.node_features_v2(windows.node_windows(_posts(s, d), _edges(s, d)))


_add("node_features_v2", _node_v2, NFEAT + " SELECT * FROM nf")
_add("feature_profile", lambda s, d: features.profile(_node_v2(s, d), PROFILED), NFEAT + ", u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, CAST({k} AS DOUBLE) AS v FROM nf" for k in PROFILED) + ") SELECT feature, count(*) AS rows, count(CASE WHEN v IS NULL THEN 1 END) AS missing, count(CASE WHEN isnan(v) THEN 1 END) AS nan, count(CASE WHEN isinf(v) THEN 1 END) AS inf, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, CAST(count(CASE WHEN v <> 0 THEN 1 END) = 0 AS INT) AS all_zero FROM u GROUP BY ALL")
EDGEW = GRID + ", ew AS (SELECT e.cascade_idx, src, dst, dst_tweet, window_idx, 'current' AS window_scope FROM edges e JOIN win ON relative_time >= end_time - 300 AND relative_time < end_time UNION ALL SELECT e.cascade_idx, src, dst, dst_tweet, window_idx, 'context' FROM edges e JOIN win ON relative_time >= greatest(0, end_time - 600) AND relative_time < end_time WHERE relative_time >= 0)"
_add("edge_scopes", lambda s, d: features.edge_scopes(windows.edge_windows(_edges(s, d))), EDGEW + " SELECT window_scope, count(*) AS edges FROM ew GROUP BY ALL")
_add("fixed_edge_window", lambda s, d: windows.edge_windows(_edges(s, d)).where("window_scope = 'current'").drop("window_scope"), EDGEW + " SELECT * EXCLUDE (window_scope) FROM ew WHERE window_scope = 'current'")
_add("fixed_node_window", lambda s, d: windows.fixed_node_windows(_posts(s, d), _edges(s, d)), NODES + " SELECT cascade_idx, window_idx, user_idx, is_root, first_seen_time, num_posts_cur AS num_posts_in_window, num_posts_cum AS cum_posts, in_degree_cur AS in_degree_window, out_degree_cur AS out_degree_window, in_degree_cum AS cum_in_degree, out_degree_cum AS cum_out_degree, time_since_first_seen FROM nw")
_add("tree_edges", lambda s, d: graph.tree_edges(graph.time_only_tree(_posts(s, d)), _posts(s, d)), TREE + " SELECT tr.cascade_idx, parent_user_idx AS src, child_user_idx AS dst, parent_tweet_idx AS src_tweet, child_tweet_idx AS dst_tweet, relative_time FROM tr JOIN posts ON tweet_idx = child_tweet_idx AND posts.cascade_idx = tr.cascade_idx")


# label reports
def _versions(s, d):
    x = _scored(s, d)
    first = labels.stratified_labels(x)
    return first, labels.vote_labels(labels.votes(x), first), labels.network_labels(x)


def _observed(s, d):
    return labels.stratified_labels(_scored(s, d)).join(org.cascade_table(src.raw_posts(s, d)).select("cascade_idx", F.col("observed_retweet_count").alias("observed")), "cascade_idx")


_add("label_counts", lambda s, d: labels.label_counts(labels.stratified_labels(_scored(s, d))), RAWS + V2 + " SELECT bucket, count(CASE WHEN label = 1 THEN 1 END) AS positive, count(CASE WHEN label = 0 THEN 1 END) AS negative, count(CASE WHEN label = -1 THEN 1 END) AS ignore FROM v2 GROUP BY ALL")
_add("label_describe", lambda s, d: labels.label_describe(_observed(s, d), "observed"), RAWS + V2 + ", lo AS (SELECT label, observed_retweet_count AS o, row_number() OVER (PARTITION BY label ORDER BY observed_retweet_count, cascade_idx) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM v2 JOIN casc USING (cascade_idx)) SELECT label, count(*) AS count, round(avg(o), 6) AS mean, min(o) AS min, max(CASE WHEN i = n // 2 THEN o END) AS p50, max(o) AS max FROM lo GROUP BY ALL")
_add("label_agreement", lambda s, d: labels.label_agreement(**dict(zip(("v2", "v3", "v4"), _versions(s, d), strict=True))), RAWS + V5.split(",\nx5 AS")[0] + ", j AS (SELECT v2.label AS a, v3.label AS b, v4.label AS c FROM v2 JOIN v3 USING (cascade_idx) JOIN v4 USING (cascade_idx)) SELECT 'v2' AS left, 'v3' AS right, a AS label_left, b AS label_right, count(*) AS cascades FROM j GROUP BY ALL UNION ALL SELECT 'v2', 'v4', a, c, count(*) FROM j GROUP BY ALL UNION ALL SELECT 'v3', 'v4', b, c, count(*) FROM j GROUP BY ALL")
_add("label_comparison", lambda s, d: labels.label_comparison(org.cascade_table(src.raw_posts(s, d)), **dict(zip(("v2", "v3", "v4"), _versions(s, d), strict=True))), RAWS + V5.split(",\nx5 AS")[0] + """, lv AS (SELECT 'v2' AS label_version, cascade_idx, label, confidence FROM v2 UNION ALL SELECT 'v3', cascade_idx, label, confidence FROM v3 UNION ALL SELECT 'v4', cascade_idx, label, confidence FROM v4),
lx AS (SELECT lv.*, CAST(observed_retweet_count AS DOUBLE) AS o, bucket FROM lv JOIN casc USING (cascade_idx) JOIN (SELECT cascade_idx, bucket FROM er) USING (cascade_idx)),
lb AS (SELECT label_version, bucket, least(count(CASE WHEN label = 1 THEN 1 END), count(CASE WHEN label = 0 THEN 1 END)) / count(*) AS b FROM lx WHERE label >= 0 GROUP BY ALL),
ln AS (SELECT label_version, count(CASE WHEN label = 1 THEN 1 END) AS positive, count(CASE WHEN label = 0 THEN 1 END) AS negative, count(CASE WHEN label = -1 THEN 1 END) AS ignore, count(*) AS n, CASE WHEN var_pop(o) > 0 AND var_pop(label) > 0 THEN corr(o, label) ELSE 0 END AS c, avg(confidence) AS m FROM lx GROUP BY ALL)
SELECT label_version, positive, negative, ignore, round(positive / n, 6) AS positive_ratio, round(negative / n, 6) AS negative_ratio, round(ignore / n, 6) AS ignore_ratio, round(c, 6) AS correlation, round(m, 6) AS mean_confidence, round(coalesce((SELECT avg(b) FROM lb WHERE lb.label_version = ln.label_version), 0), 6) AS balance FROM ln""")

# packs
LOCAL = ", lc AS (SELECT cascade_idx, user_idx, row_number() OVER (PARTITION BY cascade_idx ORDER BY user_idx) - 1 AS local_idx FROM (SELECT DISTINCT cascade_idx, user_idx FROM nw))"


def _nodes(s, d):
    return windows.node_windows(_posts(s, d), _edges(s, d))


_add("pack_mask", lambda s, d: packs.pack_mask(_nodes(s, d)), NODES + LOCAL + " SELECT lc.cascade_idx, i AS window_idx, local_idx, CAST(nw.user_idx IS NOT NULL AS INT) AS mask FROM lc CROSS JOIN range(1, 7) t(i) LEFT JOIN nw ON nw.cascade_idx = lc.cascade_idx AND nw.user_idx = lc.user_idx AND nw.window_idx = i")
_add("pack_edges", lambda s, d: packs.pack_edges(windows.edge_windows(_edges(s, d)), _nodes(s, d)), NODES + LOCAL + EDGEW.replace(GRID, "") + " SELECT ew.cascade_idx, window_idx, window_scope, a.local_idx AS src_local, b.local_idx AS dst_local FROM ew JOIN lc a ON a.cascade_idx = ew.cascade_idx AND a.user_idx = src JOIN lc b ON b.cascade_idx = ew.cascade_idx AND b.user_idx = dst")
CAND = ", v AS (SELECT *, row_number() OVER (PARTITION BY cascade_idx ORDER BY user_idx) - 1 AS i FROM (SELECT DISTINCT cascade_idx, user_idx FROM posts)), cd AS (SELECT a.cascade_idx, src, dst, a.i AS src_local, b.i AS dst_local FROM follows JOIN v a ON a.user_idx = src JOIN v b ON b.user_idx = dst AND a.cascade_idx = b.cascade_idx)"
_add("pack_candidates", lambda s, d: packs.pack_candidates(graph.candidate_edges(src.follows(s, d), _posts(s, d))), CAND + " SELECT DISTINCT cascade_idx, src_local, dst_local FROM cd WHERE src_local <> dst_local")
_add("edge_stats", lambda s, d: packs.edge_stats(graph.candidate_edges(src.follows(s, d), _posts(s, d))), CAND + ", ce AS (SELECT * FROM cd WHERE src <> dst), ends AS (SELECT cascade_idx, src AS user_idx, dst AS other, 1 AS o, 0 AS i FROM ce UNION ALL SELECT cascade_idx, dst, src, 0, 1 FROM ce), pr AS (SELECT cascade_idx, user_idx, other, sum(o) AS o, sum(i) AS i FROM ends GROUP BY ALL) SELECT cascade_idx, user_idx, CAST(sum(i) AS BIGINT) AS edges_in, CAST(sum(o) AS BIGINT) AS edges_out, count(*) AS neighbours, count(CASE WHEN o > 0 AND i > 0 THEN 1 END) AS reciprocal FROM pr GROUP BY ALL")
_add("pack_diagnostics", lambda s, d: packs.pack_diagnostics(_nodes(s, d), labels.stratified_labels(_scored(s, d)), labels.split_of(F.col("cascade_idx"))), RAWS + V2 + ", pn AS (SELECT cascade_idx, label, count(DISTINCT user_idx) AS n, CAST('0x' || substr(md5(CAST(cascade_idx AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS x FROM nw JOIN v2 USING (cascade_idx) WHERE label >= 0 GROUP BY cascade_idx, label) SELECT CASE WHEN x < 70 THEN 'train' WHEN x < 85 THEN 'valid' ELSE 'test' END AS split, label, count(*) AS samples, min(n) AS min_nodes, max(n) AS max_nodes FROM pn GROUP BY ALL")
_add("positive_weight", lambda s, d: packs.positive_weight(labels.stratified_labels(_scored(s, d))), RAWS + V2 + ", pw AS (SELECT count(CASE WHEN label = 1 THEN 1 END) AS positive, count(CASE WHEN label = 0 THEN 1 END) AS negative FROM v2) SELECT positive, negative, round(CASE WHEN positive > 0 THEN negative / positive ELSE 1 END, 6) AS weight, round(sqrt(CASE WHEN positive > 0 THEN negative / positive ELSE 1 END), 6) AS root_weight FROM pw")


# scored trees: folds, which SQL does not state; tests/test_trees.py has a plain version


def _tree(s, d, method="hybrid"):
    return trees.scored_tree(_posts(s, d), src.follows(s, d), method)


QUERIES["hybrid_tree"] = _tree
QUERIES["branching_tree"] = lambda s, d: _tree(s, d, "branching_time")
QUERIES["follow_time_tree"] = lambda s, d: _tree(s, d, "follow_time")
QUERIES["tree_features"] = lambda s, d: trees.tree_features(_tree(s, d))
QUERIES["tree_diagnostics"] = lambda s, d: trees.tree_diagnostics(_tree(s, d), _posts(s, d))

# node predictions
STEPS = ", st AS (SELECT *, lag(node_prob) OVER o AS p0, lag(node_strength) OVER o AS s0, lag(dominant_role) OVER o AS r0 FROM npred WINDOW o AS (PARTITION BY cascade_idx, node_idx ORDER BY window_idx)), sp AS (SELECT *, abs(node_prob - p0) AS j FROM st WHERE p0 IS NOT NULL)"
_add("temporal_stability", lambda s, d: stability.temporal_stability(src.node_predictions(s, d)), STEPS + " SELECT round(avg(j), 6) AS prob_jump_mean, round(stddev_pop(j), 6) AS prob_jump_std, round(avg(abs(node_strength - s0)), 6) AS strength_jump_mean, round(count(CASE WHEN r0 <> dominant_role THEN 1 END) / greatest(count(*), 1), 6) AS role_transition_rate, round(avg(j * exp(-greatest(shock, 0))), 6) AS shock_weighted_jump, round(count(CASE WHEN node_prob >= 0.5 AND p0 >= 0.5 THEN 1 END) / greatest(count(CASE WHEN node_prob >= 0.5 OR p0 >= 0.5 THEN 1 END), 1), 6) AS high_risk_persistence FROM sp")
_add("role_statistics", lambda s, d: stability.role_statistics(src.node_predictions(s, d)), " SELECT " + ", ".join(f"round(count(CASE WHEN dominant_role = '{r}' THEN 1 END) / count(*), 6) AS role_{r}_ratio" for r in stability.ROLES) + ", round(count(DISTINCT dominant_role) / 5, 6) AS dominant_role_diversity FROM npred")
_add("gate_statistics", lambda s, d: stability.gate_statistics(src.node_predictions(s, d)), ", g AS (SELECT gate_obs_weight AS o, gate_prior_weight AS p, least(greatest(gate_obs_weight / greatest(gate_obs_weight + gate_prior_weight, 1e-12), 1e-12), 1) AS a, least(greatest(gate_prior_weight / greatest(gate_obs_weight + gate_prior_weight, 1e-12), 1e-12), 1) AS b FROM npred) SELECT round(avg(o), 6) AS mean_gate_obs, round(avg(p), 6) AS mean_gate_prior, round(count(CASE WHEN o >= p THEN 1 END) / count(*), 6) AS obs_dominant_ratio, round(count(CASE WHEN p > o THEN 1 END) / count(*), 6) AS prior_dominant_ratio, round(avg(-(a * ln(a) + b * ln(b)) / ln(2)), 6) AS gate_entropy FROM g")


def _events(s, d):
    c = org.cascade_table(src.raw_posts(s, d))
    return c.select("cascade_idx", (F.col("observed_retweet_count") > 20).cast("int").alias("y_true"), (F.col("cascade_idx") % 2).cast("int").alias("y_pred"))


_add("uncertainty_statistics", lambda s, d: stability.uncertainty_statistics(src.node_predictions(s, d), _events(s, d)), CASCADES + ", pu AS (SELECT cascade_idx, avg(uncertainty) AS u FROM npred GROUP BY ALL), eu AS (SELECT u, (observed_retweet_count > 20) = (cascade_idx % 2 = 1) AS ok FROM casc JOIN pu USING (cascade_idx)) SELECT (SELECT round(avg(uncertainty), 6) FROM npred) AS mean_uncertainty, round(coalesce(avg(CASE WHEN ok THEN u END), 0), 6) AS uncertainty_correct_mean, round(coalesce(avg(CASE WHEN NOT ok THEN u END), 0), 6) AS uncertainty_wrong_mean FROM eu")
ATTENTION = ", at0 AS (SELECT *, sum(event_attention) OVER (PARTITION BY cascade_idx) AS total, row_number() OVER (PARTITION BY cascade_idx ORDER BY event_attention DESC, window_idx, node_idx) AS rn FROM npred), at1 AS (SELECT *, event_attention / total AS p FROM at0 WHERE total > 0)"
_add("attention_statistics", lambda s, d: stability.attention_statistics(src.node_predictions(s, d)), ATTENTION + ", ac AS (SELECT cascade_idx, -sum(p * ln(greatest(p, 1e-12))) / ln(greatest(count(*), 2)) AS e, max(p) AS t1, sum(CASE WHEN rn <= 5 THEN p END) AS t5 FROM at1 GROUP BY ALL) SELECT round(avg(e), 6) AS attention_entropy, round(avg(t1), 6) AS top1_attention_mean, round(avg(t5), 6) AS top5_attention_mass_mean FROM ac")
_add("key_windows", lambda s, d: stability.key_windows(src.node_predictions(s, d)), ATTENTION + " SELECT window_idx, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM at1 WHERE rn = 1 GROUP BY window_idx")
_add("window_inequality", lambda s, d: stability.inequality(_nodes(s, d), ["cascade_idx", "window_idx"], "num_posts_cur"), NODES + ", iq AS (SELECT cascade_idx, window_idx, num_posts_cur AS v, row_number() OVER (PARTITION BY cascade_idx, window_idx ORDER BY num_posts_cur) AS i, sum(num_posts_cur) OVER (PARTITION BY cascade_idx, window_idx) AS t FROM nw) SELECT cascade_idx, window_idx, round(CASE WHEN max(t) > 0 THEN 2 * sum(i * v) / (count(*) * max(t)) - (count(*) + 1) / count(*) ELSE 0 END, 6) AS gini, round(CASE WHEN max(t) > 0 THEN -sum(CASE WHEN v > 0 THEN v / t * ln(v / t + 1e-12) END) / ln(greatest(count(CASE WHEN v > 0 THEN 1 END), 2)) ELSE 0 END, 6) AS entropy FROM iq GROUP BY ALL")

# vectors
VEC = ", vc AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _vectors(s, d):
    return src.table(s, d, "embeddings").select("vec_id", "embedding")


def _text_vectors(s, d):
    t = windows.text_windows(_posts(s, d)).join(_vectors(s, d).withColumnRenamed("vec_id", "tweet_idx"), "tweet_idx")
    return stability.mean_vectors(t, ["cascade_idx", "window_idx"], "embedding").select("cascade_idx", "window_idx", F.posexplode("v").alias("dim", "x")).select("cascade_idx", "window_idx", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


_add("text_vectors", _text_vectors, TEXTS + VEC + ", tv AS (SELECT cascade_idx, window_idx, dim, avg(x) AS x FROM tw JOIN vc ON vec_id = tweet_idx GROUP BY ALL) SELECT cascade_idx, window_idx, dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY cascade_idx, window_idx)), 1e-12), 6) AS x FROM tv")
_add("neighbour_mean", lambda s, d: stability.neighbour_mean(src.follows(s, d, "dst"), _vectors(s, d).select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"))).select("node", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x")), VEC + " SELECT dst AS node, dim, round(avg(x), 6) AS x FROM follows JOIN vc ON vec_id = src GROUP BY ALL")

# histograms and samples
SAMPLE = 200
CUTS = "CASE " + " ".join(f"WHEN final_retweet_count <= {hi} THEN {i}" for i, (_, hi) in enumerate(sampling.INTERVALS[:-1], 1)) + " ELSE 7 END"
NAMES = "CASE bin " + " ".join(f"WHEN {i} THEN '{sampling.label(v)}'" for i, v in enumerate(sampling.INTERVALS, 1)) + " END"
STRATA = CASCADES + f""", binned AS (SELECT cascade_idx, final_retweet_count, {CUTS} AS bin FROM casc), bs AS (SELECT bin, count(*) AS available FROM binned GROUP BY bin),
bt AS (SELECT *, (SELECT sum(available) FROM bs) AS total, least({SAMPLE}, (SELECT sum(available) FROM bs)) AS wanted FROM bs), bf AS (SELECT *, CAST(floor(available / total * wanted) AS BIGINT) AS base FROM bt),
bg AS (SELECT *, available - base AS free, wanted - sum(base) OVER () AS rest FROM bf),
alloc AS (SELECT bin, available, CAST(base + greatest(0, least(free, rest - coalesce(sum(free) OVER (ORDER BY free DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS target FROM bg),
strat AS (SELECT cascade_idx, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(CAST(cascade_idx AS VARCHAR)), cascade_idx) AS place FROM binned) JOIN alloc USING (bin) WHERE place <= target)"""


def _cascades(s, d):
    return org.cascade_table(src.raw_posts(s, d))


def _strata(s, d):
    return sampling.stratified_sample(_cascades(s, d), "final_retweet_count", "cascade_idx", SAMPLE)


_add("interval_histogram", lambda s, d: sampling.interval_histogram(_cascades(s, d), "final_retweet_count"), STRATA + f" SELECT {NAMES} AS interval, coalesce(available, 0) AS count, round(coalesce(available, 0) * 100 / (SELECT count(*) FROM casc), 2) AS percent FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS bin) LEFT JOIN bs USING (bin)")
_add("interval_examples", lambda s, d: sampling.interval_examples(_cascades(s, d), "final_retweet_count", "cascade_idx"), STRATA + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY cascade_idx) AS place FROM binned) WHERE place <= 3")
_add("sample_allocation", lambda s, d: sampling.allocation(_cascades(s, d), "final_retweet_count", SAMPLE), STRATA + " SELECT * FROM alloc")
_add("stratified_sample", _strata, STRATA + " SELECT * FROM strat")
_add("simple_sample", lambda s, d: sampling.simple_sample(_cascades(s, d).select("cascade_idx"), "cascade_idx", SAMPLE), CASCADES + f" SELECT cascade_idx FROM casc ORDER BY md5(CAST(cascade_idx AS VARCHAR)), cascade_idx LIMIT {SAMPLE}")
_add("sample_ids", lambda s, d: sampling.with_ids(_strata(s, d), _cascades(s, d).where("valid_for_training = 1").select("cascade_idx", "root_tweet_idx"), "cascade_idx"), STRATA + " SELECT st.cascade_idx, bin, c.root_tweet_idx, CAST(c.cascade_idx IS NULL AS INT) AS missing FROM strat st LEFT JOIN (SELECT * FROM cascade_t WHERE drop_reason = '') c ON c.cascade_idx = st.cascade_idx")

# epochs of runs: every cascade stands for a run and every window for an epoch
EPOCHS = ", ep AS (SELECT cascade_idx AS run, window_idx AS epoch, max(node_prob) AS valid_f1, max(uncertainty) AS valid_auc, min(event_attention) AS valid_mcc FROM npred GROUP BY ALL), es AS (" + " UNION ALL ".join(f"SELECT run, '{n}' AS strategy, epoch, valid_f1, valid_auc, valid_mcc FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {o}) AS rn FROM ep) WHERE rn = 1" for n, o in zip(calibration.STRATEGIES, ("epoch DESC", "valid_f1 DESC, epoch", "valid_auc DESC, epoch", "valid_mcc DESC, epoch"), strict=True)) + ")"


def _selected(s, d):
    n = src.node_predictions(s, d).groupBy(F.col("cascade_idx").alias("run"), F.col("window_idx").alias("epoch"))
    return calibration.epoch_selection(n.agg(F.max("node_prob").alias("valid_f1"), F.max("uncertainty").alias("valid_auc"), F.min("event_attention").alias("valid_mcc")))


_add("epoch_selection", _selected, EPOCHS + " SELECT * FROM es")
_add("run_summary", lambda s, d: calibration.run_summary(_selected(s, d)), EPOCHS + " SELECT strategy, count(*) AS n, " + ", ".join(f"round(avg({f}), 6) AS {f}_mean, round(coalesce(stddev_samp({f}), 0), 6) AS {f}_std" for f in calibration.FIELDS) + " FROM es GROUP BY strategy")

# fits of calibration, which SQL does not state; tests/test_calibration.py has plain versions
QUERIES["calibrated_scores"] = lambda s, d: calibration.calibrated(src.predictions(s, d))
QUERIES["calibration_matrix"] = lambda s, d: calibration.method_matrix(calibration.calibrated(src.predictions(s, d)))

# key users
SEED_FEATURES = [f"{n}_{k}" for n in ("num_posts", "in_degree", "out_degree") for k in ("cur", "ctx", "cum")]
POOL = NODES + CAND.replace(", v AS", ", kv AS", 1).replace("JOIN v ", "JOIN kv ") + f""", ks0 AS (SELECT cascade_idx, window_idx, user_idx, ({" + ".join(SEED_FEATURES)}) / 9 AS m, greatest({", ".join(SEED_FEATURES)}) AS t FROM nw),
kb AS (SELECT cascade_idx, count(*) < 6 * count(DISTINCT user_idx) AS pad, min(m) AS m0, max(m) AS m1, min(t) AS t0, max(t) AS t1 FROM ks0 GROUP BY ALL),
kb1 AS (SELECT cascade_idx, m1, t1, CASE WHEN pad THEN 0 ELSE m0 END AS m0, CASE WHEN pad THEN 0 ELSE t0 END AS t0 FROM kb),
ks AS (SELECT cascade_idx, window_idx, user_idx, round(0.6::DOUBLE * CASE WHEN m1 - m0 < 1e-8 THEN 0 ELSE (m - m0) / (m1 - m0) END + 0.4::DOUBLE * CASE WHEN t1 - t0 < 1e-8 THEN 0 ELSE (t - t0) / (t1 - t0) END, 8) AS seed FROM ks0 JOIN kb1 USING (cascade_idx)),
kl AS (SELECT cascade_idx, src, dst, 1 AS weight FROM cd WHERE src <> dst UNION ALL SELECT cascade_idx, dst, src, 1 FROM cd WHERE src <> dst),
k0 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY cascade_idx, window_idx ORDER BY seed DESC, user_idx) <= 16 THEN 0 END AS hop FROM ks),
h0 AS (SELECT cascade_idx, window_idx, user_idx, seed, CASE WHEN hop = 0 THEN seed ELSE 0 END AS path, hop FROM k0)""" + "".join(f""",
a{h} AS (SELECT f.cascade_idx, f.window_idx, l.dst AS user_idx, sum(l.weight) AS add FROM h{h - 1} f JOIN kl l ON l.cascade_idx = f.cascade_idx AND l.src = f.user_idx WHERE f.hop = {h - 1} GROUP BY ALL),
h{h} AS (SELECT s.cascade_idx, s.window_idx, s.user_idx, seed, path + coalesce(pow(0.6, {h - 1}) * add, 0) AS path, coalesce(hop, CASE WHEN add IS NOT NULL THEN {h} END) AS hop FROM h{h - 1} s LEFT JOIN a{h} a ON a.cascade_idx = s.cascade_idx AND a.window_idx = s.window_idx AND a.user_idx = s.user_idx)""" for h in range(1, 5)) + """,
kd AS (SELECT cascade_idx, src AS user_idx, count(*) AS degree FROM kl GROUP BY ALL),
kf AS (SELECT s.cascade_idx, s.window_idx, s.user_idx, hop, round(0.45::DOUBLE * path + 0.3::DOUBLE * seed + 0.15::DOUBLE * least(1, coalesce(degree, 0) / 50) + 0.1::DOUBLE / (1 + hop), 8) AS score FROM h4 s LEFT JOIN kd d ON d.cascade_idx = s.cascade_idx AND d.user_idx = s.user_idx WHERE hop IS NOT NULL),
kr AS (SELECT *, row_number() OVER (PARTITION BY cascade_idx, window_idx ORDER BY score DESC, user_idx) AS rank FROM kf),
kp AS (SELECT cascade_idx, window_idx, rank, user_idx, round((score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-8), 5) AS weight, hop FROM kr WHERE rank <= 32 WINDOW w AS (PARTITION BY cascade_idx, window_idx))"""


def _seeds(s, d):
    return key_users.seed_scores(_nodes(s, d), SEED_FEATURES)


_add("seed_scores", _seeds, POOL + " SELECT * FROM ks")
_add("key_user_pool", lambda s, d: key_users.key_user_pool(_seeds(s, d), graph.candidate_edges(src.follows(s, d), _posts(s, d)).withColumn("weight", F.lit(1))), POOL + " SELECT * FROM kp")

# evidence, ancestry, calibration steps, samplers, raw files and coverage
from propagon import evidence_queries, more_queries, pack_queries, report_queries  # noqa: E402

for _queries in (evidence_queries, more_queries, pack_queries, report_queries):
    _queries.register(sys.modules[__name__])

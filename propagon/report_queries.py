"""Queries on time bins, node windows with bounds, dimensions, label reports and result tables with their SQL; ``register``
adds them to the catalogue it is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from propagon.operators import labels, org, results, temporal
from propagon.sources import cascades as src
from propagon.sources.shared import written

SHARE = "round(CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END, 6)"
BINS = """,
cb0 AS (SELECT r.cascade_idx, count(t.cascade_idx) AS total_retweets, coalesce(max(t.relative_time), 0) AS duration, """ + ", ".join(f"count(CASE WHEN t.bin = {i} THEN 1 END) AS bin_{k}" for i, k in enumerate(temporal.BIN_NAMES, 1)) + ", " + ", ".join(f"count(CASE WHEN t.relative_time <= {s} THEN 1 END) AS cum_{k}" for k, s in temporal.CUMULATIVE.items()) + """ FROM roots r LEFT JOIN rt t USING (cascade_idx) GROUP BY ALL),
cb AS (SELECT *, """ + ", ".join(f"{SHARE.format(f'cum_{k}', 'total_retweets')} AS ratio_{k}" for k in temporal.CUMULATIVE) + ", " + ", ".join(f"CAST(cum_{t} >= {m} AS INT) AS {k}" for k, (t, m) in temporal.PASSES.items()) + " FROM cb0)"
#: Runs of the predictions by a factor of the score, so that orders differ; one run has one class alone.
RUNS = {"run_full_1": 1, "cac_stat": 3, "ablation_no_tree": 7, "ablation_no_multiscale_star": 9, "other": 11}
PREDS = ", rp AS (SELECT run, row_seq, CASE WHEN run = 'other' THEN 1 ELSE y_true END AS y_true, CAST(round(y_prob * 100) AS BIGINT) * f % 101 / 100 AS y_prob FROM preds CROSS JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in RUNS.items()) + ") v(run, f))"


def _metrics(edges: str) -> str:
    tp, fp, fn, tn = (f"CAST({k} AS DOUBLE)" for k in ("tp", "fp", "fn", "tn"))
    one = lambda d: f"greatest({d}, 1)"
    p, r, s, v = f"({tp} / {one(f'{tp} + {fp}')})", f"({tp} / {one(f'{tp} + {fn}')})", f"({tn} / {one(f'{tn} + {fp}')})", f"({tn} / {one(f'{tn} + {fn}')})"
    f1 = lambda a, b: f"(2 * {a} * {b} / greatest({a} + {b}, 1e-12))"
    made = {"accuracy": f"({tp} + {tn}) / {one(f'{tp} + {fp} + {fn} + {tn}')}", "balanced_accuracy": f"({r} + {s}) / 2", "precision": p, "recall": r, "specificity": s, "f1": f1(p, r), "macro_f1": f"({f1(p, r)} + {f1(v, s)}) / 2", "mcc": f"({tp} * {tn} - {fp} * {fn}) / sqrt({one(f'({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn})')})"}
    made |= {"auc": "CASE WHEN pos > 0 AND n > pos THEN u / pos / (n - pos) ELSE 0.5 END", "ap": "coalesce(aps / nullif(pos, 0), 0)", "brier": "brier", "ece": "ece"}
    cuts = {"100": "100", "500": "500", "1pct": "greatest(1, ceil(n * 1 / 100))", "5pct": "greatest(1, ceil(n * 5 / 100))"}
    top = ", ".join(f"count(CASE WHEN k <= {c} THEN 1 END) AS m_{q}, count(CASE WHEN k <= {c} AND y_true = 1 THEN 1 END) AS h_{q}" for q, c in cuts.items())
    made |= {f"precision_at_{q}": f"h_{q} / greatest(m_{q}, 1)" for q in cuts} | {f"recall_at_{q}": f"h_{q} / greatest(pos, 1)" for q in cuts}
    return PREDS + f""",
k0 AS (SELECT *, row_number() OVER w AS k, sum(y_true) OVER w AS h, count(*) OVER (PARTITION BY run) AS n FROM rp WINDOW w AS (PARTITION BY run ORDER BY y_prob DESC, row_seq)),
k1 AS (SELECT run, n, sum(y_true) AS pos, sum(CASE WHEN y_true = 1 THEN h / k ELSE 0 END) AS aps, avg((y_prob - y_true) ** 2) AS brier, count(CASE WHEN y_prob >= 0.5 AND y_true = 1 THEN 1 END) AS tp, count(CASE WHEN y_prob >= 0.5 AND y_true = 0 THEN 1 END) AS fp, count(CASE WHEN y_prob < 0.5 AND y_true = 1 THEN 1 END) AS fn, count(CASE WHEN y_prob < 0.5 AND y_true = 0 THEN 1 END) AS tn, {top} FROM k0 GROUP BY run, n),
k2 AS (SELECT run, sum(b * g) / sum(b) AS ece FROM (SELECT run, {edges} AS bin, count(*) AS b, abs(avg(y_prob) - avg(y_true)) AS g FROM rp GROUP BY ALL) GROUP BY run),
k3 AS (SELECT run, sum(p1 * (below + q1 / 2)) AS u FROM (SELECT run, p1, q1, sum(q1) OVER (PARTITION BY run ORDER BY y_prob) - q1 AS below FROM (SELECT run, y_prob, count(CASE WHEN y_true = 1 THEN 1 END) AS p1, count(CASE WHEN y_true = 0 THEN 1 END) AS q1 FROM rp GROUP BY ALL)) GROUP BY run),
rm AS (SELECT run, """ + ", ".join(f"round({made[k]}, 6) AS {k}" for k in dict.fromkeys(results.MAIN + results.RISK)) + """ FROM k1 JOIN k2 USING (run) JOIN k3 USING (run)),
rn AS (SELECT CASE """ + " ".join(f"WHEN contains(run, '{k}') THEN '{v}'" for k, v in results.MODELS.items()) + """ ELSE run END AS model, CASE WHEN contains(run, 'no_tree') OR contains(run, 'star') THEN 'Fixed-5m-Star' WHEN contains(run, 'no_multiscale') THEN 'Fixed-5m-HybridTree' WHEN contains(run, 'full') OR contains(run, 'ablation') OR contains(run, 'hybrid_tree') THEN 'MultiScale-HybridTree' ELSE '' END AS input_variant, rm.* FROM rm)"""


def register(c) -> None:
    """``c``: the catalogue module."""

    def add(name, query, sql):
        c.QUERIES[name] = query
        c.SQL[name] = f"WITH {src.SQL}{sql}"

    # time bins
    def bins(s, d):
        return temporal.cascade_bins(src.raw_posts(s, d))

    add("cascade_bins", bins, c.TIMES + BINS + " SELECT * FROM cb")
    flat = ", bl AS (" + " UNION ALL ".join(f"SELECT '{k}' AS time_bin, cascade_idx, total_retweets, bin_{k} AS n FROM cb" for k in temporal.BIN_NAMES) + ")"
    shares = f"{SHARE.format('retweet_count', 'total_retweets')} AS retweet_ratio, {SHARE.format('cascade_count_with_retweet', 'num_cascades')} AS cascade_ratio_with_retweet"
    add("time_bin_report", lambda s, d: temporal.bin_report(bins(s, d)), c.TIMES + BINS + flat + f", g AS (SELECT time_bin, count(*) AS num_cascades, CAST(sum(total_retweets) AS BIGINT) AS total_retweets, CAST(sum(n) AS BIGINT) AS retweet_count, count(CASE WHEN n > 0 THEN 1 END) AS cascade_count_with_retweet FROM bl GROUP BY ALL) SELECT *, {shares} FROM g")
    size = "CASE " + " ".join(f"WHEN total_retweets <= {b} THEN '{n}'" for b, n in temporal.SIZES) + " ELSE '5001+' END"
    names = ", ".join(repr(n) for _, n in temporal.SIZES) + ", '5001+'"
    add("time_bin_by_size", lambda s, d: temporal.bin_report(bins(s, d), by_size=True), c.TIMES + BINS + flat + f", z AS (SELECT unnest([{names}]) AS size_bucket), t AS (SELECT DISTINCT time_bin FROM bl), g AS (SELECT z.size_bucket, t.time_bin, count(b.cascade_idx) AS num_cascades, CAST(coalesce(sum(total_retweets), 0) AS BIGINT) AS total_retweets, CAST(coalesce(sum(n), 0) AS BIGINT) AS retweet_count, count(CASE WHEN n > 0 THEN 1 END) AS cascade_count_with_retweet FROM z CROSS JOIN t LEFT JOIN (SELECT *, {size} AS size_bucket FROM bl) b ON b.size_bucket = z.size_bucket AND b.time_bin = t.time_bin GROUP BY ALL) SELECT *, {shares} FROM g")
    measures = ", ".join(f"round(coalesce(avg({k}), 0), 6) AS avg_{n}, round(coalesce(quantile_cont({k}, 0.5), 0), 6) AS median_{n}" for k, n in (("total_retweets", "total_retweets"), ("cum", "cum_obs"), ("ratio", "ratio_obs")))
    lists = " UNION ALL ".join(f"SELECT '{n}' AS list_name, {temporal.CUMULATIVE[k]} AS obs_seconds, {m} AS min_retweets, total_retweets, cum_{k} AS cum, ratio_{k} AS ratio FROM cb WHERE cum_{k} >= {m}" for n, (k, m) in temporal.DEV_LISTS.items())
    every = ", ".join(f"('{n}', {temporal.CUMULATIVE[k]}, {m})" for n, (k, m) in temporal.DEV_LISTS.items())
    add("dev_report", lambda s, d: temporal.dev_report(bins(s, d)), c.TIMES + BINS + f", dl AS ({lists}) SELECT list_name, obs_seconds, min_retweets, count(total_retweets) AS num_cascades, {measures} FROM (VALUES {every}) v(list_name, obs_seconds, min_retweets) LEFT JOIN dl USING (list_name, obs_seconds, min_retweets) GROUP BY ALL")

    # node windows, follow edges, dimensions
    add("full_node_window", lambda s, d: org.full_node_windows(c._posts(s, d)), """,
fa AS (SELECT cascade_idx, CASE WHEN is_root = 1 THEN 1 WHEN relative_time = 1800 THEN 6 ELSE relative_time // 300 + 1 END AS window_id, user_idx, is_root, CASE WHEN is_root = 1 THEN 0 ELSE relative_time END AS t, CAST(coalesce(text, '') <> '' AS INT) AS x FROM posts WHERE is_root = 1 OR relative_time BETWEEN 0 AND 1800),
fb AS (SELECT cascade_idx, window_id, user_idx, 1 AS a, 1 - is_root AS r, x, t, 1 - is_root AS i, 0 AS o, is_root FROM fa UNION ALL SELECT fa.cascade_idx, window_id, roots.user_idx, 0, 0, 0, NULL, 0, 1, 1 FROM fa JOIN roots USING (cascade_idx) WHERE fa.is_root = 0),
fc AS (SELECT cascade_idx, window_id, user_idx, CAST(sum(a) AS BIGINT) AS active_count, CAST(sum(r) AS BIGINT) AS retweet_count, CAST(sum(x) AS BIGINT) AS text_count, min(t) AS first_active_time, max(t) AS last_active_time, CAST(sum(i) AS BIGINT) AS in_degree_cur, CAST(sum(o) AS BIGINT) AS out_degree_cur, max(is_root) AS is_root, max(x) AS has_text FROM fb GROUP BY ALL)
SELECT *, CAST(sum(in_degree_cur) OVER w AS BIGINT) AS in_degree_cum, CAST(sum(out_degree_cur) OVER w AS BIGINT) AS out_degree_cum, (window_id - 1) * 300 AS window_start, least(window_id * 300, 1800) AS window_end FROM fc WINDOW w AS (PARTITION BY cascade_idx, user_idx ORDER BY window_id)""")

    def lines(s, d):
        f = src.follows(s, d)
        weight = F.when(F.col("dst") % 7 == 0, "x").when(F.col("dst") % 5 != 0, ((F.col("src") + F.col("dst")) % 4).cast("string"))
        return f.select(F.when(F.col("src") % 13 == 0, "none").otherwise(F.col("src").cast("string")).alias("src"), F.when(F.col("dst") % 11 == 0, "0").otherwise(F.col("dst").cast("string")).alias("dst"), weight.alias("weight"))

    add("weighted_follow_edges", lambda s, d: org.follow_edges(lines(s, d), c._posts(s, d)), c.USERS + ", fe AS (SELECT src, dst, CASE WHEN dst % 7 <> 0 AND dst % 5 <> 0 THEN (src + dst) % 4 ELSE 1 END AS weight, CAST(src IN (SELECT user_idx FROM users) AS INT) AS src_active, CAST(dst IN (SELECT user_idx FROM users) AS INT) AS dst_active FROM follows WHERE src % 13 <> 0 AND dst % 11 <> 0) SELECT *, src_active * dst_active AS both_active FROM fe WHERE src_active + dst_active > 0")

    def people(s, d):
        p = src.table(s, d, "customer").select(F.col("c_custkey").alias("user_idx"), F.col("c_name").alias("profile_text"), F.lit(2).alias("seq")).where("user_idx % 6 <> 0")
        more = p.where("user_idx % 4 = 0").select("user_idx", F.when(F.col("user_idx") % 8 == 0, "later").alias("profile_text"), F.lit(3).alias("seq"))
        return org.profiles_of(org.user_table(c._posts(s, d)), p.unionByName(more))

    profiled = ", pu AS (SELECT *, CASE WHEN c_custkey IS NULL THEN '' WHEN user_idx % 8 = 0 THEN 'later' WHEN user_idx % 4 = 0 THEN '' ELSE c_name END AS profile_text, CAST(c_custkey IS NOT NULL AS INT) AS has_profile FROM (SELECT user_idx, 1 AS is_active_in_events, max(is_root) AS is_root_user, 1 - min(is_root) AS is_retweet_user, count(CASE WHEN is_root = 1 THEN 1 END) AS num_root_posts, count(CASE WHEN is_root = 0 THEN 1 END) AS num_retweets FROM posts WHERE user_idx > 0 GROUP BY ALL) LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 6 <> 0) ON c_custkey = user_idx)"
    add("user_profiles", people, profiled + " SELECT * EXCLUDE (c_custkey, c_name) FROM pu")

    def counted(s, d):
        raw = src.raw_posts(s, d)
        roots = raw.where("is_root = 1 and cascade_idx > 2")
        return org.run_report(org.all_counters(raw, roots), people(s, d), roots, org.posts(roots.unionByName(org.valid_events(raw, roots))))

    head, tail = c.SQL["event_counters"].removeprefix(f"WITH {src.SQL}").rsplit(" SELECT count(CASE WHEN NOT known", 1)
    present = lambda m, n: f"round(1 - {m} / greatest({n}, 1), 6)"
    add("run_report", counted, head + profiled + f", ec AS (SELECT count(CASE WHEN NOT known{tail}), mu AS (SELECT count(CASE WHEN has_profile = 0 THEN 1 END) AS missing_user_profile, count(*) AS users FROM pu) SELECT ec.*, missing_user_profile, {present('missing_root_text', '(SELECT count(*) FROM rr)')} AS root_text_coverage, {present('missing_retweet_text', '(SELECT count(*) FROM k)')} AS retweet_text_coverage, {present('missing_user_profile', 'users')} AS user_profile_coverage FROM ec, mu")

    def records(s, d):
        r, k = src.raw_posts(s, d).where("is_root = 1"), F.col("cascade_idx")
        return r.select(k.cast("string").alias("cascade_idx"), F.when(k % 5 == 0, "?").otherwise(F.col("user_idx").cast("string")).alias("root_user_idx"), F.when(k % 2 == 1, F.col("tweet_idx").cast("string")).alias("root_tweet_idx"), (F.col("tweet_idx") + 7).cast("string").alias("tweet_idx"), F.when(k % 3 > 0, F.col("time_epoch")).alias("root_time_epoch"), (F.col("time_epoch") + 60).alias("root_time"))

    add("root_dimension", lambda s, d: org.root_dimension(records(s, d)), " SELECT cascade_idx, CASE WHEN cascade_idx % 5 = 0 THEN 0 ELSE user_idx END AS root_user_idx, CASE WHEN cascade_idx % 2 = 1 THEN tweet_idx ELSE tweet_idx + 7 END AS root_tweet_idx, 1704067200 + (cascade_idx - 1) * 86400 + relative_time + CASE WHEN cascade_idx % 3 > 0 THEN 0 ELSE 60 END AS root_time_epoch FROM roots")

    # labels
    add("rule_report", lambda s, d: labels.rule_report(labels.votes(c._scored(s, d))), c.RAWS + c.V2 + c.V3 + " " + " UNION ALL ".join(f"SELECT 'coverage_{k}' AS measure, round(count(CASE WHEN {k} <> -1 THEN 1 END) / count(*), 6) AS value FROM p3" for k in labels.RULES) + " UNION ALL SELECT 'conflict_rate', round(count(CASE WHEN pos > 0 AND neg > 0 THEN 1 END) / count(*), 6) FROM p3")

    def unified(s, d):
        return labels.unified_labels(c.QUERIES["score_rank_labels"](s, d), c.QUERIES["cascade_table"](s, d))

    ranked = c.SQL["score_rank_labels"].removeprefix(f"WITH {src.SQL}").rsplit("\nSELECT cascade_idx, weak_score, rank", 1)
    bucket = "CASE WHEN o < 8 THEN '<8' WHEN o < 20 THEN '8-20' WHEN o < 50 THEN '20-50' WHEN o < 100 THEN '50-100' WHEN o < 300 THEN '100-300' ELSE '300+' END"
    plain = ranked[0] + f", sl AS (SELECT cascade_idx, weak_score, rank{ranked[1]})" + c.CASCADES + f", ul AS (SELECT cascade_idx, weak_label AS label, split, label_confidence, weak_score, 'score_rank' AS label_method, {bucket} AS size_bucket, o AS observed_retweet_count, f AS final_retweet_count FROM (SELECT sl.*, observed_retweet_count AS o, final_retweet_count AS f FROM sl JOIN cascade_t USING (cascade_idx)))"
    add("unified_labels", unified, plain + " SELECT * FROM ul")
    corr = lambda k: f"(SELECT CASE WHEN var_pop({k}) > 0 AND var_pop(label) > 0 THEN corr({k}, label) ELSE 0 END FROM ul)"
    few = lambda kind, v: f"SELECT 'warning', 'few_{kind}_in_bucket:' || size_bucket, {v}, count(CASE WHEN label = {v} THEN 1 END) FROM ul GROUP BY size_bucket HAVING count(CASE WHEN label = {v} THEN 1 END) < 10"
    parts = [f"SELECT 'count' AS section, 'all' AS name, v AS label, CAST((SELECT count(*) FROM ul WHERE label = v) AS DOUBLE) AS value FROM (SELECT unnest([-1, 0, 1]) AS v)", "SELECT 'ratio', 'all', v, round((SELECT count(*) FROM ul WHERE label = v) / (SELECT count(*) FROM ul), 6) FROM (SELECT unnest([-1, 0, 1]) AS v)"]
    parts += [f"SELECT 'by_{k}', {k}, label, count(*) FROM ul GROUP BY {k}, label" for k in ("size_bucket", "split")]
    parts += [f"SELECT 'correlation', '{k}', NULL, round({corr(k)}, 6)" for k in ("observed_retweet_count", "weak_score")]
    parts += [f"SELECT 'warning', 'observed_retweet_count_label_correlation_high', NULL, round(x, 6) FROM (SELECT {corr('observed_retweet_count')} AS x) WHERE abs(x) >= 0.5", few("positive", 1), few("negative", 0)]
    add("label_diagnostics", lambda s, d: labels.label_diagnostics(unified(s, d)), plain + " " + " UNION ALL ".join(parts))

    # result tables
    def runs(s, d):
        p = src.predictions(s, d)
        each = F.inline(F.array(*(F.struct(F.lit(k).alias("run"), F.lit(v).alias("f")) for k, v in RUNS.items())))
        x = p.select("row_seq", "y_true", "y_prob", each)
        return x.select("run", "row_seq", F.when(F.col("run") == "other", 1).otherwise(F.col("y_true")).alias("y_true"), (F.round(F.col("y_prob") * 100).cast("long") * F.col("f") % 101 / 100).alias("y_prob"))

    def measured(s, d):
        return written(results.run_metrics(runs(s, d)), "runs")

    made = _metrics(c.EDGES)
    add("run_metrics", measured, made + " SELECT * FROM rm")
    add("main_results", lambda s, d: results.main_results(measured(s, d)), made + f" SELECT model, input_variant, {', '.join(results.MAIN)} FROM rn")
    add("risk_results", lambda s, d: results.risk_results(measured(s, d)), made + f" SELECT model, input_variant, {', '.join(results.RISK)} FROM rn")
    ahead = ", ".join(f"round((SELECT {k} FROM rn WHERE model = 'Full' ORDER BY run LIMIT 1) - {k}, 6) AS delta_{k}" for k in results.DELTAS)
    add("ablation_results", lambda s, d: results.ablation_results(measured(s, d)), made + f" SELECT model, input_variant, {', '.join(results.ABLATION)}, {ahead} FROM rn")

"""Result tables, dimensions, node windows and label reports against plain versions."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from propagon.operators import labels, org, results, temporal


def plain_metrics(y, p, rows):
    order = sorted(range(len(y)), key=lambda i: (-p[i], rows[i]))
    pos, neg = sum(y), len(y) - sum(y)
    wins = sum(1.0 if p[i] > p[j] else 0.5 if p[i] == p[j] else 0.0 for i in range(len(y)) for j in range(len(y)) if y[i] == 1 and y[j] == 0)
    hits, total = 0, 0.0
    for k, i in enumerate(order, 1):
        if y[i]:
            hits += 1
            total += hits / k
    first = max(1, -(-len(y) * 5 // 100))
    return {"auc": wins / pos / neg if pos and neg else 0.5, "ap": total / pos if pos else 0.0, "precision_at_5pct": sum(y[i] for i in order[:first]) / first, "recall_at_100": sum(y[i] for i in order[:100]) / max(1, pos), "accuracy": sum((a >= 0.5) == (b == 1) for a, b in zip(p, y)) / len(y)}


def test_metrics_of_each_run_are_its_own(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for name, n, only in (("run_full", 130, None), ("ablation_no_role", 75, None), ("all_one", 20, 1), ("all_zero", 9, 0), ("single", 1, 1)):
        p = [float(x) for x in np.round(rng.random(n), 1)]
        y = [int(x) if only is None else only for x in rng.random(n) < p]
        rows += [(name, i, a, b) for i, (a, b) in enumerate(zip(y, p))]
        want[name] = plain_metrics(y, p, list(range(n)))
    df = spark.createDataFrame(rows, "run string, row_seq long, y_true int, y_prob double").repartition(6)
    got = {r["run"]: r for r in results.run_metrics(df, ks=(100, 500)).collect()}
    assert set(got) == set(want)
    for name, values in want.items():
        for k in ("auc", "ap", "precision_at_5pct", "accuracy"):
            assert got[name][k] == pytest.approx(values[k], abs=1e-6), (name, k)


def test_tables_name_runs_and_deltas(spark):
    cols = "run string, " + ", ".join(f"{k} double" for k in dict.fromkeys(results.MAIN + results.RISK))
    width = len(dict.fromkeys(results.MAIN + results.RISK))
    df = spark.createDataFrame([("my_full_b", *([0.5] * width)), ("my_full_a", *([0.75] * width)), ("ablation_no_tree", *([0.25] * width)), ("strange", *([1.0] * width))], cols)
    got = {(r["model"], r["auc"]): (r["input_variant"], r["delta_auc"]) for r in results.ablation_results(df).collect()}
    assert got == {("Full", 0.5): ("MultiScale-HybridTree", 0.25), ("Full", 0.75): ("MultiScale-HybridTree", 0.0), ("w/o Tree", 0.25): ("Fixed-5m-Star", 0.5), ("strange", 1.0): ("", -0.25)}
    assert {r["delta_mcc"] for r in results.ablation_results(df.where("run = 'strange'")).collect()} == {0.0}
    assert results.main_results(df.limit(0)).count() == 0


def test_roots_take_their_spare_fields(spark):
    cols = "cascade_idx string, root_user_idx string, root_tweet_idx string, tweet_idx string, root_time_epoch string, root_time string"
    df = spark.createDataFrame([("1", "5", None, "9", "", "70"), ("2", "x", "3", "8", None, "71")], cols)
    # an empty time is there, and no number
    assert sorted(tuple(r) for r in org.root_dimension(df).collect()) == [(1, 5, 9, 0), (2, 0, 3, 71)]
    with pytest.raises(PySparkException, match="cascade twice"):
        org.root_dimension(df.union(df)).collect()


def test_numbers_of_texts(spark):
    df = spark.createDataFrame([("4",), ("nan",), ("inf",), ("",), (None,), ("2.5",)], "v string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(org.whole(F.col("v"))).collect()] == [4, 0, 0, 0, 0, 0]
    assert [r[0] for r in df.select(org.decimal(F.col("v"))).collect()] == [4.0, 0.0, 0.0, 0.0, 0.0, 2.5]


def test_roots_stand_in_every_window_with_reposts(spark):
    cols = "cascade_idx long, tweet_idx long, user_idx long, is_root int, relative_time long, text string"
    posts = spark.createDataFrame([(1, 10, 100, 1, 0, "r"), (1, 11, 101, 0, 120, "a"), (1, 12, 102, 0, 420, ""), (1, 13, 101, 0, 1800, None), (1, 14, 100, 0, 421, "self"), (2, 20, 7, 1, 0, None), (2, 21, 8, 0, -5, "late")], cols)
    got = {(r["cascade_idx"], r["window_id"], r["user_idx"]): r for r in org.full_node_windows(posts).collect()}
    assert set(got) == {(1, 1, 100), (1, 1, 101), (1, 2, 100), (1, 2, 102), (1, 6, 100), (1, 6, 101), (2, 1, 7)}
    root = got[1, 6, 100]
    assert (root["active_count"], root["first_active_time"], root["out_degree_cur"], root["out_degree_cum"], root["is_root"], root["window_start"], root["window_end"]) == (0, None, 1, 4, 1, 1500, 1800)
    own = got[1, 2, 100]
    assert (own["active_count"], own["retweet_count"], own["in_degree_cur"], own["out_degree_cur"], own["first_active_time"], own["is_root"]) == (1, 1, 1, 2, 421, 1)
    assert (got[1, 2, 102]["has_text"], got[2, 1, 7]["text_count"], got[2, 1, 7]["out_degree_cur"]) == (0, 0, 0)


def test_labels_report_few_and_even(spark):
    cols = "size_bucket string, split string, label int, observed_retweet_count long, weak_score double"
    rows = [("8-20", "train", i % 3 - 1, 10 + i, 0.25) for i in range(36)]
    got = {(r["section"], r["name"], r["label"]): r["value"] for r in labels.label_diagnostics(spark.createDataFrame(rows, cols)).collect()}
    y, o = [r[2] for r in rows], [r[3] for r in rows]
    assert got["count", "all", 1] == 12 and got["by_split", "train", -1] == 12
    assert got["correlation", "observed_retweet_count", None] == pytest.approx(np.corrcoef(o, y)[0, 1], abs=1e-6)
    assert got["correlation", "weak_score", None] == 0.0  # a constant has no correlation
    assert not [k for k in got if k[0] == "warning"]
    few = labels.label_diagnostics(spark.createDataFrame([("<8", "test", 1, 10, 1.0), ("<8", "test", -1, 0, 0.0)], cols)).where("section = 'warning'")
    assert sorted((r["name"], r["value"]) for r in few.collect()) == [("few_negative_in_bucket:<8", 0.0), ("few_positive_in_bucket:<8", 1.0), ("observed_retweet_count_label_correlation_high", 1.0)]
    none = labels.label_diagnostics(spark.createDataFrame([], cols)).collect()
    assert {r["value"] for r in none if r["section"] in ("count", "ratio")} == {0.0}


def test_bins_of_bounds_and_empty_cascades(spark):
    cols = "cascade_idx long, is_root int, relative_time long"
    raw = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (1, 0, 0), (1, 0, 300), (1, 0, 301), (1, 0, 86400), (1, 0, 2592001), (1, 0, -1)], cols)
    bins = temporal.cascade_bins(raw)
    got = {r["cascade_idx"]: r for r in bins.collect()}
    assert (got[1]["total_retweets"], got[1]["duration"], got[1]["bin_0_5m"], got[1]["bin_5_10m"], got[1]["bin_6_24h"], got[1]["bin_gt_30d"], got[1]["cum_24h"], got[1]["ratio_24h"]) == (5, 2592001, 2, 1, 1, 1, 4, 0.8)
    assert (got[2]["total_retweets"], got[2]["ratio_1h"], got[2]["pass_30m_min5"]) == (0, 0.0, 0)
    assert {r["num_cascades"] for r in temporal.dev_report(bins).collect()} == {0}
    assert temporal.bin_report(bins, by_size=True).count() == 7 * 13

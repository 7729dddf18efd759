"""Thresholds of valid rows and reports on test rows against plain counts."""

import numpy as np
import pytest

from propagon.operators import metrics, thresholds


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(17)
    p = np.round(rng.random(600), 3)
    y = (rng.random(600) < p).astype(int)
    rows = [(i, int(b), float(a)) for i, (a, b) in enumerate(zip(p, y))]
    schema = "row_seq long, y_true int, y_prob double"
    return p, y, spark.createDataFrame(rows[:300], schema), spark.createDataFrame(rows[300:], schema)


def plain_best(y, p, metric, steps):
    tried = sorted(set(p))
    if len(tried) > steps + 1:
        tried = [i / steps for i in range(steps + 1)]
    best = None
    for t in tried:
        tp, fp = int(((p >= t) & (y == 1)).sum()), int(((p >= t) & (y == 0)).sum())
        fn, tn = int((y == 1).sum()) - tp, int((y == 0).sum()) - fp
        pr, rc = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
        v = 2 * pr * rc / max(pr + rc, 1e-12) if metric == "f1" else (tp * tn - fp * fn) / max(1, (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5
        if best is None or (round(v, 9), round(pr, 9)) > best[:2]:
            best = (round(v, 9), round(pr, 9), t)
    return best[2]


@pytest.mark.parametrize("steps", [1000, 40])
def test_thresholds_come_from_valid_rows(parts, steps):
    p, y, valid, test = parts
    both = thresholds.calibrated_on(valid, test)
    rows = {r.row_seq: r for r in both.collect()}
    got = {(r.method, r.strategy): r for r in thresholds.threshold_report(both, ("none", "platt", "isotonic"), steps).collect()}
    assert len(got) == 9 and {r.part for r in rows.values()} == {"valid", "test"}
    for m in ("none", "platt", "isotonic"):
        q = np.array([rows[i][f"p_{m}"] for i in range(600)])
        for metric in ("f1", "mcc"):
            r = got[m, f"valid_best_{metric}"]
            t = plain_best(y[:300], q[:300], metric, steps)
            assert r.threshold == pytest.approx(t, abs=1e-6)
            hit = q[300:] >= t
            assert (r.tp, r.fp) == (int((hit & (y[300:] == 1)).sum()), int((hit & (y[300:] == 0)).sum()))
            assert r.brier == pytest.approx(np.mean((q[300:] - y[300:]) ** 2), abs=2e-6)


def test_parameters_do_not_see_test_rows(parts):
    _, _, valid, test = parts
    wrong = test.selectExpr("row_seq", "1 - y_true as y_true", "y_prob")
    one, two = ({r.row_seq: r.p_platt for r in thresholds.calibrated_on(valid, t).collect()} for t in (test, wrong))
    assert one == two


def test_empty_and_few_rows(parts):
    _, _, valid, test = parts
    none = thresholds.calibrated_on(valid, test).where("false")
    assert thresholds.threshold_report(none).count() == 0 and metrics.at_percent(valid.where("false")).count() == 0
    assert [(r.k, r.recall) for r in metrics.at_percent(valid.where("row_seq = 3"), (10.0,)).collect()] == [(1, float(valid.where("row_seq = 3").first().y_true))]


def test_scores_that_all_differ(spark):
    """Metrics by range partitions where every row has a score of its own."""
    rng = np.random.default_rng(4)
    p, y = rng.permutation(500) / 500, rng.integers(0, 2, 500)
    df = spark.createDataFrame([(i, int(b), float(a)) for i, (a, b) in enumerate(zip(p, y))], "row_seq long, y_true int, y_prob double")
    pos, neg = p[y == 1], p[y == 0]
    assert metrics.roc_auc(df).first()[0] == pytest.approx((pos[:, None] > neg[None, :]).mean(), abs=1e-6)
    o = np.argsort(-p)
    hits = np.cumsum(y[o])
    assert metrics.average_precision(df).first()[0] == pytest.approx((hits / np.arange(1, 501))[y[o] == 1].mean(), abs=1e-6)

"""Calibration of scores, and results across runs.

Fits see one row for each different score. Every pass is one aggregate; only its sums come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propagon.operators.metrics import per_score

#: Bounds of scores before the logit and of chances before the logarithm, range of log-temperatures, ridge.
CLIP, EPS, LOG_RANGE, RIDGE = 1e-6, 1e-12, 4.0, 1e-4
STRATEGIES = ("final_epoch", "best_valid_f1", "best_valid_auc", "best_valid_mcc")
FIELDS = ("valid_f1", "valid_auc", "valid_mcc")


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(c / (1 - c))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _loss(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return -F.sum(F.col("pos") * F.log(c) + F.col("neg") * F.log(1 - c))


def fit_temperature(preds: DataFrame, points: int = 33, passes: int = 7) -> float:
    """Temperature of least loss within exp(-4) to exp(4). The loss has one minimum, so each pass lays a grid over the two
    cells beside the best point of the last; 7 passes reach 1e-7. 1 without rows."""
    z = per_score(preds).select(logit(F.col("y_prob")).alias("z"), "pos", "neg").persist()
    low, high = -LOG_RANGE, LOG_RANGE
    for _ in range(passes):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        losses = z.agg(*(_loss(sigmoid(F.col("z") / math.exp(t))) for t in grid)).first()
        if losses[0] is None:
            low = high = 0.0
            break
        at = min(range(points), key=lambda i: losses[i])
        low, high = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    z.unpersist()
    return math.exp((low + high) / 2)


def fit_platt(preds: DataFrame, steps: int = 30) -> tuple[float, float, float, float]:
    """(a, b, mean, deviation): least ridge loss of sigmoid(a x + b) over standardised logits x, by Newton's steps, where
    descent would need thousands of passes. (1, 0, 0, 1) without rows."""
    z = per_score(preds).select(logit(F.col("y_prob")).alias("z"), "pos", (F.col("pos") + F.col("neg")).alias("n")).persist()
    n, total, square = z.agg(F.sum("n"), F.sum(F.col("n") * F.col("z")), F.sum(F.col("n") * F.col("z") * F.col("z"))).first()
    if not n:
        z.unpersist()
        return 1.0, 0.0, 0.0, 1.0
    mean = total / n
    deviation = math.sqrt(max(0.0, square / n - mean * mean))
    deviation = deviation if deviation > EPS else 1.0
    x = (F.col("z") - mean) / deviation
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * x + b)
        off, spread = F.col("n") * p - F.col("pos"), F.col("n") * p * (1 - p)
        ga, gb, aa, ab, bb = z.agg(F.sum(off * x), F.sum(off), F.sum(spread * x * x), F.sum(spread * x), F.sum(spread)).first()
        ga, gb, aa, ab, bb = ga / n + RIDGE * a, gb / n, aa / n + RIDGE, ab / n, bb / n + EPS
        det = aa * bb - ab * ab
        da, db = (bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det
        size = max(abs(da), abs(db))
        a, b = a - da / max(1.0, size), b - db / max(1.0, size)  # a step of at most 1 in either
        if size < 1e-10:
            break
    z.unpersist()
    return a, b, mean, deviation


def calibrated(preds: DataFrame) -> DataFrame:
    """Predictions with the scores of each method: p_none, p_temperature and p_platt."""
    t, (a, b, mean, deviation) = fit_temperature(preds), fit_platt(preds)
    p, z = F.col("y_prob"), logit(F.col("y_prob"))
    return preds.withColumns({"p_none": F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), "p_temperature": sigmoid(z / t), "p_platt": sigmoid(a * ((z - mean) / deviation) + b)})


def method_matrix(scored: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7), methods: tuple[str, ...] = ("none", "temperature", "platt")) -> DataFrame:
    """Confusion counts, F1, Brier score and loss of every method and threshold, in one pass."""
    long = scored.select("y_true", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"p_{m}").alias("p")) for m in methods))).alias("s")).select("y_true", "s.*")
    y, p = F.col("y_true"), F.col("p")
    c = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    hits = {f"{k}{i}": F.count_if(((p >= t) == hit) & (y == v)) for i, t in enumerate(thresholds) for k, hit, v in (("tp", True, 1), ("fp", True, 0), ("fn", False, 1), ("tn", False, 0))}
    sums = long.groupBy("method").agg(F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(-F.avg(F.when(y == 1, F.log(c)).otherwise(F.log(1 - c))), 6).alias("nll"), *(v.alias(k) for k, v in hits.items()))
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), *(F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn"))) for i, t in enumerate(thresholds)))
    rows = sums.select("method", "brier", "nll", F.inline(each))
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return rows.withColumn("f1", F.round(2 * precision * recall / F.greatest(precision + recall, F.lit(EPS)), 6))


def epoch_selection(epochs: DataFrame) -> DataFrame:
    """(run, strategy, epoch, metrics): the last epoch of each run and the first with the best value of each metric."""
    row = F.struct("epoch", *FIELDS)
    best = [F.max_by(row, F.col("epoch")), *(F.max_by(row, F.struct(F.col(f), -F.col("epoch"))) for f in FIELDS)]
    picked = epochs.groupBy("run").agg(*(b.alias(s) for s, b in zip(STRATEGIES, best, strict=True)))
    each = F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(s).alias("e")) for s in STRATEGIES))
    return picked.select("run", F.inline(each)).select("run", "strategy", "e.*")


def run_summary(rows: DataFrame, by: str = "strategy", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Mean and sample deviation of each metric across runs; one run has deviation 0."""
    stats = [s for f in fields for s in (F.round(F.avg(f), 6).alias(f"{f}_mean"), F.round(F.coalesce(F.stddev_samp(f), F.lit(0.0)), 6).alias(f"{f}_std"))]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *stats)

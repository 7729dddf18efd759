"""Thresholds chosen on valid rows and reported on test rows, for scores of several calibration methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propagon.operators.calibration import fit_platt, fit_temperature, logit, sigmoid
from propagon.operators.isotonic import isotonic

EPS = 1e-12
STRATEGIES = ("default_0.5", "valid_best_f1", "valid_best_mcc")
METRICS = ("accuracy", "precision", "recall", "specificity", "f1", "mcc")


def calibrated_on(valid: DataFrame, test: DataFrame) -> DataFrame:
    """Both sets of predictions with ``part`` (valid or test) and the scores of each method, fitted on ``valid`` alone:
    p_none, p_temperature, p_platt and p_isotonic."""
    t, (a, b, mean, deviation) = fit_temperature(valid), fit_platt(valid)
    both = valid.withColumn("part", F.lit("valid")).unionByName(test.withColumn("part", F.lit("test")))
    p, z = F.col("y_prob"), logit(F.col("y_prob"))
    both = both.withColumns({"p_none": F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), "p_temperature": sigmoid(z / t), "p_platt": sigmoid(a * ((z - mean) / deviation) + b)})
    return isotonic(valid, both)


def scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics of confusion counts; a denominator of zero counts as one."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    one = lambda d: F.greatest(d, F.lit(1.0))
    p, r = tp / one(tp + fp), tp / one(tp + fn)
    made = {"accuracy": (tp + tn) / one(tp + fp + fn + tn), "precision": p, "recall": r, "specificity": tn / one(tn + fp), "f1": 2 * p * r / F.greatest(p + r, F.lit(EPS))}
    return made | {"mcc": (tp * tn - fp * fn) / F.sqrt(one((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))}


def best_thresholds(long: DataFrame, steps: int = 1000) -> DataFrame:
    """(method, valid_best_f1, valid_best_mcc) of rows (method, y_true, p) with p in 0 .. 1.

    Candidates are the different scores of a method, or i / ``steps`` where a method has over ``steps`` + 1 of them; ties go
    to the higher precision, then to the lower threshold. Rows are first counted by candidate, so that what is ordered has at
    most ``steps`` + 1 rows a method.
    """
    grid = long.groupBy("method").agg((F.count_distinct("p") > steps + 1).alias("grid"))
    at = F.floor(F.col("p") * steps)
    at = at + ((at + 1) / steps <= F.col("p")).cast("long") - (at / steps > F.col("p")).cast("long")
    cells = long.join(F.broadcast(grid), "method").withColumn("cell", F.when(F.col("grid"), at / steps).otherwise(F.col("p")))  # a row a method
    cells = cells.groupBy("method", "grid", "cell").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg"))
    each = Window.partitionBy("method")
    down = each.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    c = cells.select("method", "grid", "cell", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(each).alias("p"), F.sum("neg").over(each).alias("n"), F.lag("cell").over(each.orderBy("cell")).alias("below"))
    # every step above the cell below counts the same rows; the first of them is the threshold
    t = F.when(F.col("grid"), F.coalesce(F.round(F.col("below") * steps) + 1, F.lit(0.0)) / steps).otherwise(F.col("cell"))
    m = scores(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp"), F.col("n") - F.col("fp"))
    best = lambda k: F.max(F.struct(F.round(m[k], 9).alias("v"), F.round(m["precision"], 9).alias("pr"), (-t).alias("t"))).alias(k)
    return c.groupBy("method").agg(best("f1"), best("mcc")).select("method", (-F.col("f1.t")).alias("valid_best_f1"), (-F.col("mcc.t")).alias("valid_best_mcc"))


def threshold_report(parts: DataFrame, methods: tuple[str, ...] = ("none",), steps: int = 1000, bins: int = 10) -> DataFrame:
    """(method, strategy, threshold, valid_f1, valid_mcc, and of the test rows tp, fp, fn, tn and METRICS; Brier score, loss
    and calibration error of both parts) for rows with ``part``, y_true and p_<method>.

    Without valid or without test rows there is no report. A null score leaves its row out.
    """
    long = parts.select("part", "y_true", F.inline(F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"p_{m}").cast("double").alias("p")) for m in methods)))).where("p is not null")
    chosen = best_thresholds(long.where("part = 'valid'"), steps).withColumn(STRATEGIES[0], F.lit(0.5))
    y, p = F.col("y_true"), F.col("p")
    held = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    bin_of = sum((p >= i / bins).cast("long") for i in range(1, bins))
    rows, names = long.join(F.broadcast(chosen), "method"), [f"`{s}`" for s in STRATEGIES]  # a row a method
    hits = [F.count_if((p >= F.col(f"`{s}`")) & (y == v)).alias(f"{k}{i}") for i, s in enumerate(STRATEGIES) for k, v in (("tp", 1), ("fp", 0))]
    binned = rows.groupBy("method", "part", *names, bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y_true").alias("sy"), F.sum((p - y) * (p - y)).alias("sq"), F.sum(-F.when(y == 1, F.log(held)).otherwise(F.log(1 - held))).alias("nl"), *hits)
    counts = [F.sum(f"{k}{i}").alias(f"{k}{i}") for i in range(len(STRATEGIES)) for k in ("tp", "fp")]
    n = F.sum("n")
    sums = binned.groupBy("method", "part", *names).agg(n.alias("n"), F.sum("sy").alias("pos"), (F.sum("sq") / n).alias("brier"), (F.sum("nl") / n).alias("nll"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"), *counts)
    each = F.inline(F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(f"`{s}`").alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, s in enumerate(STRATEGIES))))
    x = sums.select("method", "part", "n", "pos", "brier", "nll", "ece", each).withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("n") - F.col("pos") - F.col("fp"))
    made = scores(*(F.col(k) for k in ("tp", "fp", "fn", "tn")))
    loss = ("brier", "nll", "ece")
    valid = x.where("part = 'valid'").select("method", "strategy", *(F.round(made[k], 6).alias(f"valid_{k}") for k in ("f1", "mcc")), *(F.round(k, 6).alias(f"valid_{k}") for k in loss))
    tested = x.where("part = 'test'").select("method", "strategy", F.round("threshold", 6).alias("threshold"), *(F.col(k).cast("long").alias(k) for k in ("tp", "fp", "fn", "tn")), *(F.round(made[k], 6).alias(k) for k in METRICS), *(F.round(k, 6).alias(k) for k in loss))
    return valid.join(tested, ["method", "strategy"])

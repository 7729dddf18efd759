"""Metrics of binary predictions (row_seq, y_true, y_prob)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propagon.operators import ranking


def per_score(preds: DataFrame) -> DataFrame:
    """(y_prob, pos, neg): positives and negatives of every different score; metrics that ignore order need no more."""
    return preds.groupBy("y_prob").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))


def confusion(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts and eight metrics at a threshold; a denominator of zero counts as one."""
    hit, true = F.col("y_prob") >= threshold, F.col("y_true") == 1
    c = preds.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    one = lambda d: F.greatest(d, F.lit(1.0))
    p, r, spec, npv = tp / one(tp + fp), tp / one(tp + fn), tn / one(tn + fp), tn / one(tn + fn)
    f1 = lambda a, b: 2 * a * b / F.greatest(a + b, F.lit(1e-12))
    m = {"accuracy": (tp + tn) / one(tp + fp + fn + tn), "balanced_accuracy": (r + spec) / 2, "precision": p, "recall": r, "specificity": spec, "f1": f1(p, r), "macro_f1": (f1(p, r) + f1(npv, spec)) / 2, "mcc": (tp * tn - fp * fn) / F.sqrt(one((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))}
    return c.select("tp", "fp", "fn", "tn", *(F.round(v, 6).alias(k) for k, v in m.items()))


def roc_auc(preds: DataFrame) -> DataFrame:
    """Area under the curve, ties counting half; 0.5 with one class."""
    s = ranking.running(per_score(preds), ["y_prob"], ["neg"]).withColumnRenamed("neg_before", "below")
    x = s.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return x.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / F.col("p") / F.col("n")).otherwise(0.5), 6).alias("auc"))


def ranked(preds: DataFrame) -> DataFrame:
    """Rank by falling score, then by row, and positives up to it. Range partitions are numbered alone, so that no task orders
    all rows, however many scores there are or rows a score has."""
    r = ranking.running(preds.select("row_seq", "y_true", "y_prob", F.lit(1).cast("long").alias("one")), [F.col("y_prob").desc(), F.col("row_seq")], ["one", "y_true"])
    return r.select("row_seq", "y_true", "y_prob", (F.col("one_before") + 1).alias("rank"), (F.col("y_true_before") + F.col("y_true")).alias("hits"))


def average_precision(preds: DataFrame) -> DataFrame:
    x = ranked(preds).agg(F.sum(F.when(F.col("y_true") == 1, F.col("hits") / F.col("rank"))).alias("s"), F.sum("y_true").alias("p"))
    return x.select(F.round(F.coalesce(F.col("s") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0)), 6).alias("average_precision"))


def brier_nll(preds: DataFrame, eps: float = 1e-12) -> DataFrame:
    p = F.least(F.greatest(F.col("y_prob"), F.lit(eps)), F.lit(1 - eps))
    nll = -(F.col("y_true") * F.log(p) + (1 - F.col("y_true")) * F.log(1 - p))
    return preds.agg(F.round(F.avg((F.col("y_prob") - F.col("y_true")) ** 2), 6).alias("brier"), F.round(F.avg(nll), 6).alias("nll"))


def bin_of(bins: int) -> Column:
    """Bin whose lower edge, i / bins, is the last one not above the score; 1 belongs to the last bin."""
    return sum((F.col("y_prob") >= i / bins).cast("long") for i in range(1, bins))


def calibration_bins(preds: DataFrame, bins: int = 10) -> DataFrame:
    return preds.withColumn("bin", bin_of(bins)).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("y_prob"), 6).alias("confidence"), F.round(F.avg("y_true"), 6).alias("accuracy"))


def calibration_error(preds: DataFrame, bins: int = 10) -> DataFrame:
    x = preds.withColumn("bin", bin_of(bins)).groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("y_prob") - F.avg("y_true")).alias("gap"))
    return x.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def at_k(preds: DataFrame, ks: tuple[int, ...] = (10, 100, 500)) -> DataFrame:
    """Precision and recall of the first k."""
    r = ranked(preds)
    x = r.select("y_true", F.explode(F.filter(F.array(*(F.when(F.col("rank") <= k, F.lit(k).cast("long")) for k in ks)), lambda v: v.isNotNull())).alias("k"))
    return x.groupBy("k").agg(F.sum("y_true").alias("hits"), F.count("*").alias("n")).crossJoin(preds.agg(F.sum("y_true").alias("p"))).select("k", F.round(F.col("hits") / F.greatest("n", F.lit(1)), 6).alias("precision"), F.round(F.col("hits") / F.greatest("p", F.lit(1)), 6).alias("recall"))


def at_percent(preds: DataFrame, percents: tuple[float, ...] = (0.01, 0.05, 10.0)) -> DataFrame:
    """Precision and recall of the first max(1, ceil(n q)) rows for each share q; a q over 1 is in percent. No row for an empty
    table."""
    n = preds.agg(F.count("*").alias("n"), F.sum("y_true").alias("p"))
    share = F.when(F.col("percent") > 1, F.col("percent") / 100).otherwise(F.col("percent"))
    cut = n.where("n > 0").select("p", F.col("n").alias("all"), F.explode(F.array(*(F.lit(float(q)) for q in percents))).alias("percent")).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("all") * share)).cast("long"))
    first = ranked(preds).join(F.broadcast(cut), F.col("rank") == F.least("k", "all"))  # a row a share
    return first.select("percent", "k", F.round(F.col("hits") / F.col("rank"), 6).alias("precision"), F.round(F.col("hits") / F.greatest("p", F.lit(1)), 6).alias("recall"))


def best_threshold(preds: DataFrame) -> DataFrame:
    """The score that as a threshold has the best F1; ties go to the higher precision, then to the lower score."""
    s = ranking.running(per_score(preds), [F.col("y_prob").desc()], ["pos", "neg"])
    s = s.withColumn("tp", F.col("pos_before") + F.col("pos")).withColumn("n", F.col("tp") + F.col("neg_before") + F.col("neg")).crossJoin(preds.agg(F.sum("y_true").alias("p")))
    pr, rc = F.col("tp") / F.greatest("n", F.lit(1)), F.col("tp") / F.greatest("p", F.lit(1))
    f1 = F.round(2 * pr * rc / F.greatest(pr + rc, F.lit(1e-12)), 9)
    return s.agg(F.max(F.struct(f1.alias("f1"), F.round(pr, 9).alias("pr"), (-F.col("y_prob")).alias("t"))).alias("m")).select(F.round(-F.col("m.t"), 6).alias("threshold"), F.round("m.f1", 6).alias("f1"), F.round("m.pr", 6).alias("precision"))

"""Metrics of many runs at once and the tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propagon.operators import metrics, ranking

#: Parts of run names with the names of their models (the first that occurs counts), columns of the tables.
MODELS = {"full": "Full", "cac_stat": "CAC-Stat", "campaign_gnn": "Campaign-GNN", "temporal_gnn": "Temporal-GNN", "ablation_no_tree": "w/o Tree", "ablation_no_multiscale": "w/o MultiScale", "ablation_no_role": "w/o Role", "ablation_no_memory": "w/o Memory", "ablation_no_global_prior": "w/o Global Prior", "ablation_no_adaptive_sampling": "w/o Adaptive Sampling", "ablation_no_gate": "w/o Gate", "ablation_no_uncertainty": "w/o Uncertainty"}
MAIN = ("accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "macro_f1", "auc", "ap", "mcc", "brier", "ece")
RISK = ("precision_at_100", "precision_at_500", "recall_at_500", "precision_at_1pct", "recall_at_1pct", "precision_at_5pct", "recall_at_5pct")
ABLATION = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "auc", "ap", "mcc")
DELTAS = ("auc", "ap", "f1", "mcc")


def model_name(run: Column, names: dict[str, str] | None = None) -> Column:
    """Name of the model by the first key of ``names`` that occurs in the run's name, else that name."""
    out = None
    for key, value in (names or MODELS).items():
        hit = F.contains(run, F.lit(key))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(run)


def input_variant(run: Column, full: str = "full") -> Column:
    """What the run reads, by parts of its name; empty where none is known."""
    has = lambda *keys: F.greatest(F.lit(False), *(F.contains(run, F.lit(k)) for k in keys))
    return F.when(has("no_tree", "star"), "Fixed-5m-Star").when(has("no_multiscale"), "Fixed-5m-HybridTree").when(has("hybrid_tree", full, "ablation"), "MultiScale-HybridTree").otherwise("")


def run_metrics(preds: DataFrame, threshold: float = 0.5, bins: int = 10, ks: tuple[int, ...] = (100, 500), percents: tuple[int, ...] = (1, 5)) -> DataFrame:
    """A row of MAIN and RISK for each run of (run, row_seq, y_true, y_prob); row_seq tells the rows of a run apart.

    All runs go through the same jobs: counts by (run, score), sums over range partitions of (run, score) for the area under
    the curve and of (run, falling score, row) for ranks, so that neither runs nor rows make a task large.
    """
    p = preds.select("run", F.col("row_seq").cast("long").alias("row_seq"), F.col("y_true").cast("long").alias("y_true"), F.col("y_prob").cast("double").alias("y_prob"))
    hit, true = F.col("y_prob") >= threshold, F.col("y_true") == 1
    base = p.groupBy("run").agg(F.count("*").alias("n"), F.sum("y_true").alias("positives"), F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"), F.avg((F.col("y_prob") - F.col("y_true")) ** 2).alias("brier"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    one = lambda d: F.greatest(d, F.lit(1.0))
    pr, rc, spec, npv = tp / one(tp + fp), tp / one(tp + fn), tn / one(tn + fp), tn / one(tn + fn)
    f1 = lambda a, b: 2 * a * b / F.greatest(a + b, F.lit(1e-12))
    made = {"accuracy": (tp + tn) / one(tp + fp + fn + tn), "balanced_accuracy": (rc + spec) / 2, "precision": pr, "recall": rc, "specificity": spec, "f1": f1(pr, rc), "macro_f1": (f1(pr, rc) + f1(npv, spec)) / 2, "mcc": (tp * tn - fp * fn) / F.sqrt(one((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))}
    out = base.withColumns(made)

    gap = p.groupBy("run", metrics.bin_of(bins).alias("bin")).agg(F.count("*").alias("m"), F.abs(F.avg("y_prob") - F.avg("y_true")).alias("gap"))
    out = out.join(gap.groupBy("run").agg((F.sum(F.col("m") * F.col("gap")) / F.sum("m")).alias("ece")), "run")

    scores = p.groupBy("run", "y_prob").agg(F.count_if(true).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    s = ranking.running(scores, ["run", "y_prob"], ["neg"])
    # sums go on from run to run; what the first score of a run starts with is taken off
    u = s.groupBy("run").agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), F.min("neg_before").alias("start"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    auc = F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("u") - F.col("start") * F.col("p")) / F.col("p") / F.col("q")).otherwise(0.5)
    out = out.join(u.select("run", auc.alias("auc")), "run")

    r = ranking.running(p.withColumn("one", F.lit(1).cast("long")), [F.col("run"), F.col("y_prob").desc(), F.col("row_seq")], ["one", "y_true"])
    start = r.groupBy("run").agg(F.min("one_before").alias("o0"), F.min("y_true_before").alias("y0"))
    x = r.join(F.broadcast(start), "run").join(F.broadcast(base.select("run", "n")), "run")  # a row a run each
    rank, hits = F.col("one_before") - F.col("o0") + 1, F.col("y_true_before") - F.col("y0") + F.col("y_true")
    cut = {f"at_{k}": F.lit(k) for k in ks} | {f"at_{q}pct": F.greatest(F.lit(1), F.ceil(F.col("n") * q / 100)) for q in percents}
    x = x.select("run", "y_true", rank.alias("rank"), hits.alias("hits"), *(v.alias(k) for k, v in cut.items()))
    top = x.groupBy("run").agg(F.sum(F.when(true, F.col("hits") / F.col("rank"))).alias("s"), F.sum("y_true").alias("p"), *(f for k in cut for f in (F.sum(F.when(F.col("rank") <= F.col(k), F.col("y_true"))).alias(f"h_{k}"), F.count_if(F.col("rank") <= F.col(k)).alias(f"m_{k}"))))
    part = {"ap": F.coalesce(F.col("s") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0))} | {f"precision_{k}": F.col(f"h_{k}") / F.greatest(f"m_{k}", F.lit(1)) for k in cut} | {f"recall_{k}": F.col(f"h_{k}") / F.greatest("p", F.lit(1)) for k in cut}
    out = out.join(top.select("run", *(v.alias(k) for k, v in part.items())), "run")
    return out.select("run", *(F.round(k, 6).alias(k) for k in dict.fromkeys(MAIN + RISK)))


def _named(rows: DataFrame, names: dict[str, str] | None) -> DataFrame:
    return rows.withColumns({"model": model_name(F.col("run"), names), "input_variant": input_variant(F.col("run"))})


def main_results(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """MAIN of each run, with the model and what it reads."""
    return _named(rows, names).select("model", "input_variant", *MAIN)


def risk_results(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """RISK of each run, with the model and what it reads."""
    return _named(rows, names).select("model", "input_variant", *RISK)


def ablation_results(rows: DataFrame, names: dict[str, str] | None = None, full: str = "Full") -> DataFrame:
    """ABLATION of each run and how far the full model is ahead of it; 0 without a run of that model. Of several such runs
    the first by name counts."""
    x = _named(rows, names)
    ahead = x.where(F.col("model") == full).agg(*(F.min_by(k, "run").alias(f"full_{k}") for k in DELTAS))  # one row, nulls without a full run
    return x.crossJoin(ahead).select("model", "input_variant", *ABLATION, *(F.round(F.coalesce(F.col(f"full_{k}") - F.col(k), F.lit(0.0)), 6).alias(f"delta_{k}") for k in DELTAS))

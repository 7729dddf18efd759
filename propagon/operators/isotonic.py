"""Isotonic calibration: pooled blocks of rising means, and the step function they make."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propagon.sources.shared import written

#: Blocks that one task pools at most, about.
TASK_BLOCKS = 200_000
BLOCK = "y_prob double, y_true double, max_x double, total double, weight double"


def _pooled(batches):
    """Pools the neighbours of a sorted run while a mean falls; equal means pool too, which leaves the steps as they are."""
    blocks: list[list[float]] = []
    for b in batches:
        for p, y, x, total, weight in b[["y_prob", "y_true", "max_x", "total", "weight"]].itertuples(index=False):
            blocks.append([p, y, x, total, weight])
            while len(blocks) > 1 and blocks[-2][3] * blocks[-1][4] >= blocks[-1][3] * blocks[-2][4]:
                _, _, x2, t2, w2 = blocks.pop()
                blocks[-1][2] = x2
                blocks[-1][3] += t2
                blocks[-1][4] += w2
    yield pd.DataFrame(blocks, columns=["y_prob", "y_true", "max_x", "total", "weight"])


def fit_isotonic(preds: DataFrame) -> DataFrame:
    """(max_x, value): the steps of the least-squares rising fit of y_true over y_prob, where rows of one score are ordered by
    label.

    Range partitions pool their rows alone, then fewer partitions pool what is left; pooling in any order gives the same steps.
    Null scores and labels are left out; without rows there are no steps.
    """
    rows = preds.where("y_prob is not null and y_true is not null").groupBy(F.col("y_prob").cast("double").alias("y_prob"), F.col("y_true").cast("double").alias("y_true")).agg(F.count("*").cast("double").alias("weight"))
    blocks = written(rows.select("y_prob", "y_true", F.col("y_prob").alias("max_x"), (F.col("y_true") * F.col("weight")).alias("total"), "weight"), "blocks")
    left, before = blocks.count(), None
    while True:
        # a pass that pools nothing leaves the rest to one task: the steps themselves
        parts = 1 if left == before else left // TASK_BLOCKS + 1
        blocks = written(blocks.repartitionByRange(parts, "y_prob", "y_true").sortWithinPartitions("y_prob", "y_true").mapInPandas(_pooled, BLOCK), "blocks")
        if parts == 1:
            break
        before, left = left, blocks.count()
    return blocks.select("max_x", F.least(F.greatest(F.col("total") / F.col("weight"), F.lit(0.0)), F.lit(1.0)).alias("value"))


def step_values(scores: DataFrame, steps: DataFrame, column: str = "y_prob") -> DataFrame:
    """(column, value) of every different score: the value of the first step that reaches it, else of the last one.

    Scores and steps are cut into ranges together; a range without a later step takes the first step of the ranges after it.
    """
    s = scores.select(F.col(column).cast("double").alias("x")).where("x is not null").distinct()
    both = s.select("x", F.lit(None).cast("double").alias("value")).unionByName(steps.select(F.col("max_x").alias("x"), "value"))
    cut = written(both.repartitionByRange("x").withColumn("piece", F.spark_partition_id()), "steps")
    down = Window.partitionBy("piece").orderBy(F.desc("x"), F.col("value").isNull(), F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    # one row a range
    first = cut.groupBy("piece").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.struct("x", "value"))).alias("first"))
    first = first.withColumn("later", F.first("first", True).over(Window.partitionBy(F.lit(0)).orderBy("piece").rowsBetween(1, Window.unboundedFollowing))).drop("first")
    last = steps.agg(F.max_by("value", F.struct("max_x", "value")).alias("last"))
    x = cut.withColumn("own", F.last("value", True).over(down)).where("value is null").join(first, "piece").join(F.broadcast(last))  # one row
    return x.select(F.col("x").alias(column), F.coalesce("own", "later", "last").alias("value"))


def isotonic(valid: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with p_isotonic, fitted on ``valid``; without steps the score itself, held to 0 .. 1."""
    values = step_values(test, fit_isotonic(valid)).withColumnRenamed("value", "p_isotonic")
    x = test.join(values, "y_prob", "left")
    return x.withColumn("p_isotonic", F.coalesce("p_isotonic", F.least(F.greatest(F.col("y_prob"), F.lit(0.0)), F.lit(1.0)))).select(*test.columns, "p_isotonic")

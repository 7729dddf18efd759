"""Interval histograms and samples of cascades, ordered by a hash so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Closed intervals of repost counts; None is open.
INTERVALS = ((0, 10), (11, 50), (51, 100), (101, 500), (501, 1000), (1001, 5000), (5001, None))


def label(interval: tuple[int, int | None]) -> str:
    low, high = interval
    return f"{low}+" if high is None else str(low) if low == high else f"{low}-{high}"


def interval_of(value: Column, intervals=INTERVALS) -> Column:
    """1-based number of the interval that holds a value; null outside all."""
    return F.coalesce(*(F.when((value >= low) & (F.lit(True) if high is None else value <= high), i) for i, (low, high) in enumerate(intervals, 1)))


def hash_order(key: Column) -> Column:
    return F.md5(key.cast("string"))


def interval_histogram(rows: DataFrame, column: str, intervals=INTERVALS) -> DataFrame:
    """(interval, count, percent) for every interval; the percentage is of all rows, those outside the intervals too."""
    counts = rows.agg(F.count("*").alias("total"), *(F.count_if(interval_of(F.col(column), intervals) == i).alias(f"n{i}") for i in range(1, len(intervals) + 1)))
    each = F.array(*(F.struct(F.lit(label(v)).alias("interval"), F.col(f"n{i}").alias("count")) for i, v in enumerate(intervals, 1)))
    return counts.select("total", F.inline(each)).select("interval", "count", F.round(F.when(F.col("total") > 0, F.col("count") * 100 / F.col("total")).otherwise(0.0), 2).alias("percent"))


def interval_examples(rows: DataFrame, column: str, key: str, n: int = 3, intervals=INTERVALS) -> DataFrame:
    """The first ``n`` rows of each interval by key."""
    w = Window.partitionBy("bin").orderBy(key)
    return rows.select(key, column, interval_of(F.col(column), intervals).alias("bin")).where("bin is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def allocation(rows: DataFrame, column: str, n: int, intervals=INTERVALS) -> DataFrame:
    """(bin, available, target): whole parts of each interval's share of ``n``, then the rest to those with most rows left."""
    sizes = rows.select(interval_of(F.col(column), intervals).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("available"))
    whole = Window.partitionBy(F.lit(1))  # at most one row an interval
    total = F.sum("available").over(whole)
    wanted = F.least(F.lit(n), total)
    part = sizes.withColumn("base", F.floor(F.col("available") / total * wanted)).withColumn("free", F.col("available") - F.col("base")).withColumn("rest", wanted - F.sum("base").over(whole))
    before = F.coalesce(F.sum("free").over(whole.orderBy(F.desc("free"), "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.select("bin", "available", (F.col("base") + F.greatest(F.lit(0), F.least(F.col("free"), F.col("rest") - before))).cast("long").alias("target"))


def stratified_sample(rows: DataFrame, column: str, key: str, n: int, intervals=INTERVALS) -> DataFrame:
    """(key, bin): rows of each interval by ``allocation``, first in hash order. The limit on places runs before the shuffle."""
    w = Window.partitionBy("bin").orderBy(hash_order(F.col(key)), key)
    placed = rows.select(key, interval_of(F.col(column), intervals).alias("bin")).where("bin is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return placed.join(F.broadcast(allocation(rows, column, n, intervals)), "bin").where("place <= target").select(key, "bin")


def simple_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows, first in hash order."""
    return rows.orderBy(hash_order(F.col(key)), key).limit(n)


def with_ids(sample: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The sample's rows beside the ids of ``ids``; ``missing`` is 1 where it has none."""
    return sample.join(ids.withColumn("found", F.lit(1)), key, "left").withColumn("missing", F.when(F.col("found").isNull(), 1).otherwise(0)).drop("found")

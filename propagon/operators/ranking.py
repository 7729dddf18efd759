"""Exact places and nearest ranks without a task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propagon.sources.shared import written

CELLS = 512


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their 0-based place by ``order`` inside ``keys``; ``order`` should tell rows apart.

    Range partitions cut a large group into pieces; a piece is numbered alone and starts after the rows of the pieces before.
    """
    cut = written(rows.repartitionByRange(*keys, *order).withColumn("piece_", F.spark_partition_id()), "ranked")
    counts = cut.groupBy(*keys, "piece_").agg(F.count("*").alias("rows_"))
    # one row a partition and group at most
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("before_", F.coalesce(F.sum("rows_").over(before.orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows_")
    inside = Window.partitionBy(*keys, "piece_").orderBy(*order)
    same = F.col("c.piece_") == F.col("r.piece_")
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}"))
    numbered = cut.withColumn("inside_", F.row_number().over(inside) - 1)
    return numbered.alias("r").join(counts.alias("c"), same).select(*(F.col(f"r.{k}") for k in rows.columns), (F.col("before_") + F.col("inside_")).cast("long").alias(name))


def running(rows: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """``rows`` with <name>_before for each of ``sums``: its sum over the rows before, by ``order``, which tells rows apart.

    Range partitions are summed alone; a row adds what the partitions before its own hold.
    """
    cut = written(rows.repartitionByRange(*order).withColumn("piece_", F.spark_partition_id()), "running")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    pieces = earlier(Window.partitionBy(F.lit(0)).orderBy("piece_"))
    own = cut.groupBy("piece_").agg(*(F.sum(k).alias(f"{k}_all") for k in sums))
    own = own.select("piece_", *(F.coalesce(F.sum(f"{k}_all").over(pieces), F.lit(0)).alias(f"{k}_base") for k in sums))
    inside = earlier(Window.partitionBy("piece_").orderBy(*order))
    x = cut.join(F.broadcast(own), "piece_")  # a row a partition
    return x.select(*rows.columns, *((F.coalesce(F.sum(k).over(inside), F.lit(0)) + F.col(f"{k}_base")).alias(f"{k}_before") for k in sums))


def nearest_ranks(rows: DataFrame, value: str, shares: list[float]) -> list[float]:
    """The value at place round((n - 1) q), halves to even, for every q; 0 without values.

    Histograms are refined around each place until a cell holds one value, so at most ``CELLS`` counts a share and pass come to
    the driver. Nulls do not count.
    """
    v = F.col(value).cast("double")
    x = rows.select(v.alias("v")).where("v is not null")
    n, low, high = x.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [0.0] * len(shares)
    # (place inside the cell, least and largest value of the cell) of each share
    state = [(min(n - 1, max(0, round((n - 1) * q))), low, high) for q in shares]
    while any(a < b for _, a, b in state):
        cells = {(a, b) for _, a, b in state if a < b}
        per = {}
        for a, b in cells:
            cell = F.least(F.floor((F.col("v") - a) / (b - a) * CELLS), F.lit(CELLS - 1))
            got = x.where(F.col("v").between(a, b)).groupBy(cell.alias("k")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
            per[a, b] = sorted((r["k"], r["n"], r["a"], r["b"]) for r in got)
        after = []
        for place, a, b in state:
            if a < b:
                for _, m, a, b in per[a, b]:  # noqa: B020
                    if place < m:
                        break
                    place -= m
            after.append((place, a, b))
        state = after
    return [float(a) for _, a, _ in state]

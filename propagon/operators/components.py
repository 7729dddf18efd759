"""Connected components of many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propagon.sources.shared import written


def grouped_components(edges: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, node, root): the smallest node that each end of an edge reaches inside its keys; a root stands for itself.

    Every node hands its smallest neighbour to the larger ones, then to all, until nothing changes; each step is a shuffle
    and a written table. Self loops make their node a component. Nodes are longs, keys are not null.
    """
    given = edges.select(*keys, F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u is not null and v is not null")
    nodes = given.select(*keys, F.explode(F.array("u", "v")).alias("node")).distinct()
    e = written(given.where("u <> v").distinct(), "edges")
    before = (0, None)
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        both = e.union(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        e = written(large.join(low, [*keys, "u"]).select(*keys, pair).select(*keys, "e.*").where("u <> v").distinct(), "edges")
    roots = e.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))

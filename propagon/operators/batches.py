"""Batches of samples with like numbers of nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propagon.operators.ranking import ranked


def node_batches(samples: DataFrame, batch_size: int = 8, buckets: int = 50, most_nodes: int = 0) -> DataFrame:
    """(sample, nodes, bucket, batch): samples by nodes and id, cut into buckets of ``batch_size`` * ``buckets``, and those into
    batches.

    With ``most_nodes`` a batch closes before its size times its largest sample exceeds that, and a sample of that many nodes
    stands alone; a bucket is walked in one task, and is never larger than its bound. Places come from range partitions.
    """
    size = max(1, batch_size)
    bucket = size * max(1, buckets)
    p = ranked(samples.select("sample", "nodes"), [], ["nodes", "sample"]).withColumn("bucket", F.expr(f"place div {bucket}"))
    if most_nodes <= 0:
        return p.select("sample", "nodes", "bucket", F.expr(f"place % {bucket} div {size}").alias("batch"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        out, batch, many, widest = [], 0, 0, 0
        for n in rows["nodes"].tolist():
            if many and (n >= most_nodes or many + 1 > size or (many + 1) * max(widest, n) > most_nodes):
                batch, many, widest = batch + 1, 0, 0
            out.append(batch)
            many, widest = many + 1, max(widest, n)
            if n >= most_nodes or many >= size:
                batch, many, widest = batch + 1, 0, 0
        return pd.DataFrame({"sample": rows["sample"], "nodes": rows["nodes"], "bucket": rows["bucket"], "batch": out})

    return p.groupBy("bucket").applyInPandas(walk, "sample long, nodes long, bucket long, batch long")


def padding(batches: DataFrame) -> DataFrame:
    """Batches, their samples, and nodes with and without padding to the largest sample of each batch."""
    b = batches.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.max("nodes").alias("m"), F.sum("nodes").alias("s"))
    return b.agg(F.count("*").alias("batches"), F.sum("n").alias("samples"), F.sum("s").alias("nodes"), F.sum(F.col("n") * F.col("m")).alias("padded_nodes"), F.max(F.col("n") * F.col("m")).alias("largest_padded"))

"""Neighbour candidates of the nodes of a cascade, their scores and the sampled neighbourhoods."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propagon.sources import vector_files

#: Similar candidates of a node, size of the pool they come from, weights of the score, sampled neighbours.
SIMILAR, POOL, NEIGHBOURS = 20, 512, 8
FOLLOW, CONTEXT, SIM, DISTANCE = 0.2, 0.4, 0.4, 0.1
BLOCK = 1024
PAIR = ["cascade_idx", "i", "j"]


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (cascade_idx, src, dst, source, weight) as (cascade_idx, i, j, source, weight), each in both directions."""
    one = lambda i, j: edges.select("cascade_idx", F.col(i).alias("i"), F.col(j).alias("j"), "source", "weight")
    return one("src", "dst").unionByName(one("dst", "src")).where("i <> j")


def in_pool(place: Column, n: Column, pool: int) -> Column:
    """Whether a place of n is one of ``pool`` even steps from the first to the last, cut to integers."""
    gap, top = F.greatest(n - 1, F.lit(1)), max(pool - 1, 1)
    t = F.ceil(place * top / gap)
    return (n <= pool) | ((t <= top) & (F.floor(t * gap / top) == place))


def _key() -> Column:
    """The key of a vector; no vector has that of a null."""
    return F.coalesce(F.col("key").cast("long"), F.lit(-(1 << 63)))


def looked_up(held: vector_files.Vectors, keys: np.ndarray) -> np.ndarray:
    """A row for each key, its vector, or zeros where the files have none."""
    out = np.zeros((len(keys), held.width))
    at, found = held.take(keys)
    out[at] = found
    return out


def similar(nodes: DataFrame, k: int = SIMILAR, pool: int = POOL, files: list | None = None) -> DataFrame:
    """(cascade_idx, i, j, sim): the pool nodes most like each node, by cosine to six digits, of equal ones the first.

    ``nodes`` (cascade_idx, node, vector), nodes numbered from 0; with ``files`` of ``vector_files.save`` it has the ``key`` of a
    vector in its place, so that no vector is shuffled. A node that is in the pool takes one of its own places. Blocks
    of nodes meet their cascade's pool in one product, so no pair but the chosen ones is ever a row.
    """
    n = nodes.groupBy("cascade_idx").agg(F.count("*").alias("n"))
    x = (nodes.withColumn("vector", _key()) if files is not None else nodes).join(n, "cascade_idx")
    rows = x.select("cascade_idx", F.floor(F.col("node") / BLOCK).alias("block"), "node", "vector")
    members = x.where(in_pool(F.col("node"), F.col("n"), pool)).select("cascade_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("block"), "node", "vector")
    # both sides come from the same nodes; new names keep them apart
    members = members.toDF("pool_cascade", "pool_block", "node", "vector")

    def unit(frame: pd.DataFrame) -> np.ndarray:
        m = np.array(frame["vector"].tolist(), np.float64) if files is None else looked_up(vector_files.opened(files), frame["vector"].to_numpy(np.int64))
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def best(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in (*PAIR, "sim")})
        b = b.sort_values("node")
        s = np.round(unit(a) @ unit(b).T, 6)
        take = min(k, max(len(b) - 1, 1))
        order = np.argsort(-s, axis=1, kind="stable")[:, :take]
        i, j = np.repeat(a["node"].to_numpy(), take), b["node"].to_numpy()[order].ravel()
        keep = i != j
        return pd.DataFrame({"cascade_idx": key[0], "i": i[keep], "j": j[keep], "sim": np.take_along_axis(s, order, 1).ravel()[keep]})

    return rows.groupBy("cascade_idx", "block").cogroup(members.groupBy("pool_cascade", "pool_block")).applyInPandas(best, "cascade_idx long, i long, j long, sim double")


def candidates(nodes: DataFrame, edges: DataFrame, k: int = SIMILAR, pool: int = POOL, files: list | None = None) -> DataFrame:
    """(cascade_idx, i, j): neighbours along any edge in either direction, and the similar ones; both ends are nodes."""
    known = nodes.select("cascade_idx", F.col("node").alias("i"))
    near = both_ways(edges).select(*PAIR).join(known, ["cascade_idx", "i"], "left_semi").join(known.withColumnRenamed("i", "j"), ["cascade_idx", "j"], "left_semi").select(*PAIR)
    return near.union(similar(nodes, k, pool, files).select(*PAIR)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(cascade_idx, j, degree): ends of edges at each node, over all sources."""
    return edges.select("cascade_idx", F.explode(F.array("src", "dst")).alias("j")).groupBy("cascade_idx", "j").agg(F.count("*").alias("degree"))


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def cosines(pairs: DataFrame, nodes: DataFrame, files: list) -> DataFrame:
    """(cascade_idx, i, j, sim): cosines of pairs to six digits. Keys join the pairs, vectors come from the mapped files."""
    v = nodes.select("cascade_idx", "node", _key().alias("key"))
    x = pairs.select(*PAIR).join(v.withColumnsRenamed({"node": "i", "key": "ki"}), ["cascade_idx", "i"]).join(v.withColumnsRenamed({"node": "j", "key": "kj"}), ["cascade_idx", "j"])

    def run(batches):
        held = vector_files.opened(files)
        for b in batches:
            p, q = (looked_up(held, b.column(k).to_numpy()) for k in (3, 4))
            size = [np.maximum(np.sqrt((m * m).sum(1)), 1e-12) for m in (p, q)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((p * q).sum(1) / (size[0] * size[1]))], [*PAIR, "sim"])

    return x.select(*(F.col(c).cast("long").alias(c) for c in PAIR), "ki", "kj").mapInArrow(run, "cascade_idx long, i long, j long, sim double").withColumn("sim", F.round("sim", 6))


def sampled(nodes: DataFrame, edges: DataFrame, neighbours: int = NEIGHBOURS, k: int = SIMILAR, pool: int = POOL, files: list | None = None) -> DataFrame:
    """(cascade_idx, i, j, score, weight, sample_rank, source, degree): the best candidates of every node and their softmax.

    The score weighs the largest follow weight of a pair in either direction, a context edge, the cosine, and the distance of
    the numbers; the source is the first of current, context, follow, similarity that the pair has. ``files`` as in ``similar``.
    """
    e = both_ways(edges).groupBy(*PAIR).agg(F.coalesce(F.max(F.when(F.col("source") == "follow", F.col("weight"))), F.lit(0.0)).alias("follow"), *(F.max((F.col("source") == s).cast("int")).alias(s) for s in ("current", "context")), F.max((F.col("source") == "follow").cast("int")).alias("followed"))
    n = nodes.groupBy("cascade_idx").agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("span"))
    pairs = candidates(nodes, edges, k, pool, files)
    if files is None:
        v = nodes.select("cascade_idx", "node", "vector")
        x = pairs.join(v.withColumnsRenamed({"node": "i", "vector": "vi"}), ["cascade_idx", "i"]).join(v.withColumnsRenamed({"node": "j", "vector": "vj"}), ["cascade_idx", "j"])
        x = x.select(*PAIR, F.round(_cosine(F.col("vi"), F.col("vj")), 6).alias("sim"))
    else:
        x = cosines(pairs, nodes, files)
    x = x.join(e, PAIR, "left").na.fill(0).join(n, "cascade_idx").join(degrees(edges), ["cascade_idx", "j"], "left").na.fill(0, ["degree"])
    score = FOLLOW * F.col("follow") + CONTEXT * F.col("context") + SIM * F.col("sim") - DISTANCE * F.abs(F.col("j") - F.col("i")) / F.col("span")
    source = F.when(F.col("current") == 1, "current").when(F.col("context") == 1, "context").when(F.col("followed") == 1, "follow").otherwise("similarity")
    by = Window.partitionBy("cascade_idx", "i")
    top = x.withColumn("score", F.round(score, 8)).withColumn("sample_rank", F.row_number().over(by.orderBy(F.desc("score"), "j"))).where(F.col("sample_rank") <= neighbours)
    w = F.exp(F.col("score") - F.max("score").over(by))
    return top.withColumn("w", w).select(*PAIR, "score", F.round(F.col("w") / F.sum("w").over(by), 6).alias("weight"), "sample_rank", source.alias("source"), F.col("degree").cast("long").alias("degree"))

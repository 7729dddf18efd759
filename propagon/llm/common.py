"""Helpers shared by the corpus operators.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Texts travel to Python as UTF-8 bytes in
Arrow batches; a null text counts as empty everywhere.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 21
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share; a temporary one is set only where the session names none."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="propagon-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there and survives a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, since a text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def crc_mod(name: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % m


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, end row, bytes, offsets) for runs of rows of at most ``limit`` bytes, or one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 2 * len(_powers)), _STEP, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half the output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0xD6E8FEB86659FD93) + b)


def tokens(buf: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, 64-bit hash and row of every word of a block."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    word = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return start, end, np.zeros(0, np.uint64), start
    size = end - start
    at = np.cumsum(size) - size
    rel = np.arange(int(size.sum())) - np.repeat(at, size)
    chars = buf[word]
    value = _BYTE[LOWER[chars] if lower else chars] * powers(int(size.max()))[rel]
    h = mix(np.add.reduceat(value, at) ^ size.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    return start, end, h, np.searchsorted(off, start, "right") - 1


def nearest_rank(rows: DataFrame, value: str, share: float, by: str) -> DataFrame:
    """(by, n, q): for each group its rows and the value at place ceil(share * n) in order; a null group is one of its own.

    An estimate brackets the place widely; what lies under the bracket is counted, what lies in it is ordered, so the
    result is exact and no group is sorted whole.
    """
    wide = 0.002  # 20 times the error of the estimate
    near = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("n"), F.percentile_approx(value, [max(0.0, share - wide), min(1.0, share + wide)], 10_000).alias("b"))
    inside = rows.join(near, rows[by].eqNullSafe(near["__by"])).where(F.col(value) <= F.col("b")[1])
    inside = inside.groupBy("__by", "n", F.when(F.col(value) >= F.col("b")[0], F.col(value)).alias("q")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("__by").orderBy(F.col("q").asc_nulls_first()))
    reached = inside.withColumn("upto", upto).where(F.col("upto") >= F.ceil(F.round(F.col("n") * F.lit(share), 6)))
    return reached.groupBy(F.col("__by").alias(by), "n").agg(F.min("q").alias("q"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of longs: (node, root) for every node but the roots, the smallest nodes.

    Large-star and small-star steps alternate until the edges stop changing; each step is a shuffle and a written
    table, and no node or component is ever brought to the driver. Rows with a null end and self loops are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = saved(e, "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour of u points to the smallest node around u
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = saved(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = now


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs now; it does so once their plans are garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()

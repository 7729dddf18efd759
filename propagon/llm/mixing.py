"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has an exponential key, -ln(u) / quality, with u drawn from a hash of its id and text. A source whose
target holds whole epochs takes all its documents that often; the rest of its budget goes to the documents of least
keys, up to the one that fills the budget, which is cut to the words that remain. No source is sorted as a whole: a
histogram of key ranges per source finds the range where the budget ends, and only that range is refined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propagon.llm.common import WORD, fresh, saved

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SPLIT = 1024
RANGE_ROWS = 5_000
SALTS = 32
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: str = "text") -> Column:
    """Weight of a text in (0.1, 1]: the share of its characters that are letters, spaces or digits."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.length(F.regexp_replace(t, r"[^\p{L}\p{N} \n]+", ""))
    return F.lit(0.1) + 0.9 * F.coalesce(plain / F.nullif(F.length(t), F.lit(0)), F.lit(0.0))


def sample_key(weight: Column, id_col: str = "doc_id", text: str = "text", seed: int = 0) -> Column:
    """1 - exp(-key), which orders as the exponential key does and lies in [0, 1)."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit(""))), 11)
    u = (h + F.lit(1.0)) / F.lit(float(1 << 53))
    return F.least(-F.expm1(F.log(u) / weight), F.lit(1 - 2.0**-53))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) by water filling over (source, source_size).

    Sources get the budget by weight; one whose part exceeds ``most`` times its size stops there, and the rest is dealt
    out again by weight. A source is full at level size / weight, so sources sorted by that ratio fill in turn: the
    first ones whose ratio lies under the level stop, and the others share what is left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = w.withColumn("budget", share * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the level once the full ones are set apart, as the first source that stays under its cap has it
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    w = w.withColumn("final", level)
    return w.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("w") * F.col("final")).alias("target"))


def by_source(rows: DataFrame, small: DataFrame, bounded: bool) -> DataFrame:
    """``rows`` with the columns of their source; a source may hold most rows, so it is never gathered."""
    small = small.withColumnRenamed("source", "__source")
    if bounded:
        return rows.join(F.broadcast(small), rows["source"].eqNullSafe(small["__source"])).drop("__source")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("key"), SALTS))
    wide = small.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(wide, salted["source"].eqNullSafe(wide["__source"]) & (salted["__salt"] == wide["__salt2"])).drop("__source", "__salt", "__salt2")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """id, source, size, source_size, target, copies (whole epochs), taken (words in all) and key, for every row.

    Null is a source of its own and the last. A null text has size 0 and is taken 0 times. Rows that are equal in all
    columns share a key; which of them is cut does not show. A target that nothing fills (all sizes 0) is 0.
    """
    rows = saved(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), sample_key(quality(text), id_col, text, seed).alias("key")), "sizes")
    sizes = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    bounded = sizes.count() <= MAX_BROADCAST_SOURCES
    sizes = sizes.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    sizes = sizes.withColumn("rest", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))
    limit = _limits(rows, sizes, bounded)
    at = by_source(rows, sizes.join(limit.withColumnRenamed("source", "__s"), sizes["source"].eqNullSafe(F.col("__s"))).drop("__s"), bounded)
    whole = at.where("key < low or key >= high").withColumn("part", F.when(F.col("key") < F.col("low"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = at.where("key >= low and key < high").withColumn("before", F.col("done") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))).drop("before")
    both = whole.unionByName(edge)
    return both.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"), "key")


def _limits(rows: DataFrame, sizes: DataFrame, bounded: bool) -> DataFrame:
    """(source, low, high, done): keys below ``low`` are taken, ``done`` words; from ``high`` on none is.

    Each step splits the range that holds the end of the budget into SPLIT parts, until it has few rows.
    """
    at = sizes.select("source", "rest", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("long").alias("done"))
    for _ in range(4):
        inside = by_source(rows, at, bounded).where("key >= low and key < high")
        b = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * SPLIT), F.lit(SPLIT - 1)).cast("long")
        bins = inside.withColumn("b", b).groupBy("source", "rest", "low", "high", "done", "b").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.col("done") + F.sum("n").over(run))
        end = bins.groupBy("source", "rest", "low", "high", "done").agg(F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("b", (F.col("upto") - F.col("n")).alias("before"), "rows"))).alias("e"), F.max("upto").alias("all"))
        width = (F.col("high") - F.col("low")) / SPLIT
        step = end.select("source", "rest", F.when(F.col("e").isNull(), F.col("high")).otherwise(F.col("low") + F.col("e.b") * width).alias("low2"), F.when(F.col("e").isNull(), F.col("high")).otherwise(F.col("low") + (F.col("e.b") + 1) * width).alias("high2"), F.when(F.col("e").isNull(), F.col("all")).otherwise(F.col("e.before")).alias("done2"), F.coalesce(F.col("e.rows"), F.lit(0)).alias("rows"))
        step = saved(step, "limits")
        most = step.agg(F.max("rows")).first()[0] or 0
        at = step.select("source", "rest", F.col("low2").alias("low"), F.col("high2").alias("high"), F.col("done2").alias("done"))
        if most <= RANGE_ROWS:
            break
    return at.drop("rest")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The rows of ``docs`` in the mix: each as often as its whole epochs say, and once more if half of it or more falls
    into the fractional selection. Rows without words are not part of a mix."""
    mix = saved(mix_sources(docs, id_col, text, source, seed), "mix")
    more = F.when(2 * (F.col("taken") - F.col("copies") * F.col("size")) >= F.col("size"), 1).otherwise(0)
    wanted = mix.where("size > 0").groupBy(F.col(id_col).alias("id"), "key").agg(F.max(F.col("copies") + more).alias("n")).where("n > 0")
    key, times = fresh(docs, "key"), fresh(docs, "times")
    wanted = wanted.select(F.struct("id", "key", "n").alias(times))
    own = docs.withColumn(key, sample_key(quality(text), id_col, text, seed))
    out = own.join(wanted, own[id_col].eqNullSafe(wanted[times]["id"]) & (own[key] == wanted[times]["key"]))
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)["n"])).alias(key)).select(*docs.columns)

"""Text files whose lines have a place: raw cascades of two header lines and pairs of lines, and lists of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, across: bool = False, bundled: bool = False) -> DataFrame:
    """(file, line, value): 0-based line numbers of every file, or with ``across`` over all files by path, or with ``bundled`` of
    every file of the bundles that ``write_bundles`` wrote.

    A file may be read in many splits: lines are numbered inside each and start after the lines of the splits before, so no
    task reads a whole file. A carriage return at the end and a byte order mark at the start of a file go.
    """
    t = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    if bundled:
        # a file stands in one bundle, its lines side by side
        t = t.withColumns({"file": F.substring_index("value", "\t", 1), "value": F.expr("substr(value, instr(value, '\t') + 1)")})
    # one row a split, or a file and split of a bundle
    counts = t.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    by = Window.partitionBy(F.lit(0)).orderBy("file", "start") if across else Window.partitionBy("file").orderBy("start")
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    x = t.join(counts, ["file", "start"]).withColumn("line", F.col("before") + F.col("id") - F.col("first"))
    value = F.regexp_replace("value", "\r+$", "")
    begins = F.col("before") == 0 if bundled else F.col("start") == 0
    return x.select("file", "line", F.when(begins & (F.col("id") == F.col("first")), F.regexp_replace(value, "^﻿", "")).otherwise(value).alias("value"))


def line_pairs(lines: DataFrame) -> DataFrame:
    """(file, pair, event, text) of raw cascades: after two header lines every two lines are a pair; a last line alone is none."""
    x = lines.where("line >= 2").withColumn("pair", F.expr("(line - 2) div 2"))
    first = F.col("line") % 2 == 0
    return x.groupBy("file", "pair").agg(F.max(F.when(first, F.col("value"))).alias("event"), F.max(F.when(~first, F.col("value"))).alias("text")).where("event is not null and text is not null")


def distinct_pairs(pairs: DataFrame, by_text: bool = True) -> DataFrame:
    """The first pair of each event and text of a file, or of each event; pairs of a blank event all stay."""
    blank = F.trim(F.regexp_replace("event", r"\s", "")) == ""
    if by_text:
        first = pairs.where(~blank).groupBy("file", "event", "text").agg(F.min("pair").alias("pair"))
    else:
        first = pairs.where(~blank).groupBy("file", "event").agg(F.min_by("text", "pair").alias("text"), F.min("pair").alias("pair"))
    return first.select("file", "pair", "event", "text").unionByName(pairs.where(blank).select("file", "pair", "event", "text"))


def pair_counts(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Pairs of each file: kept, dropped and total."""
    k = kept.groupBy("file").agg(F.count("*").alias("kept"))
    x = pairs.groupBy("file").agg(F.count("*").alias("total")).join(k, "file", "left").na.fill(0)
    return x.select("file", "kept", (F.col("total") - F.col("kept")).alias("dropped"), "total")


def _lines(pairs: DataFrame) -> DataFrame:
    """(file, value) of raw cascades, those of a file in one partition and in order: two header lines (the file and its pairs),
    then the pairs."""
    n = pairs.groupBy("file").agg(F.count("*").alias("n"))
    lines = lambda at, value: F.struct(F.lit(at).alias("part"), value.cast("string").alias("value"))
    head = n.select("file", F.lit(-1).cast("long").alias("pair"), F.inline(F.array(lines(0, F.col("file")), lines(1, F.col("n")))))
    body = pairs.select("file", F.col("pair").cast("long").alias("pair"), F.inline(F.array(lines(0, F.col("event")), lines(1, F.col("text")))))
    return head.unionByName(body).repartition("file").sortWithinPartitions("file", "pair", "part").select("file", "value")


def write_cascades(pairs: DataFrame, path: str) -> None:
    """Raw cascades, one folder ``file=...`` each."""
    _lines(pairs).write.partitionBy("file").text(path)


def write_bundles(pairs: DataFrame, path: str) -> None:
    """Raw cascades, many to a text file: each line stands behind the name of its file, which holds no tab, and a tab. For
    cascades so many that a file each would take longer to open than to read."""
    _lines(pairs).select(F.concat(F.col("file").cast("string"), F.lit("\t"), F.col("value"))).write.text(path)


def first_mismatch(ids: DataFrame, mapped: DataFrame, start: int = 1) -> DataFrame:
    """One row: whether a map of ``number<tab>id`` lines agrees with a list of ids line by line.

    kind is null, or that of the first line that differs: length (one ends), bad line (no tab), bad number, mismatch. checked
    counts the lines before it. Both are (line, value) as from ``numbered_lines``.
    """
    x = ids.select("line", F.trim("value").alias("id"), F.lit(True).alias("l")).join(mapped.select("line", F.col("value").alias("m"), F.lit(True).alias("r")), "line", "full")
    parts = F.split("m", "\t")
    number = F.expr("try_cast(trim(split(m, '\t')[0]) as bigint)")
    kind = F.when(F.col("l").isNull() | F.col("r").isNull(), "length").when(F.size(parts) < 2, "bad line").when(number.isNull(), "bad number").when((number != F.col("line") + start) | (F.try_element_at(parts, F.lit(2)) != F.col("id")), "mismatch")
    x = x.withColumn("kind", kind)
    bad = x.where("kind is not null").agg(F.min("line").alias("line"), F.min_by("kind", "line").alias("kind"))
    sizes = x.agg(F.count("l").alias("ids"), F.count("r").alias("mapped"))
    return bad.join(F.broadcast(sizes)).select("ids", "mapped", "kind", (F.col("line") + 1).alias("first_line"), F.coalesce("line", "ids").alias("checked"))  # one row each

"""Removal of byte strings that occur elsewhere, by refining buckets of suffixes.

A string of LENGTH bytes that starts at p is repeated if it also starts anywhere else. Suffixes go into buckets by their
first bytes and buckets are split by later ones, as in bucket-pointer refinement: the identifier of a longer string is made
of the identifiers of its parts at later offsets, a bucket of one needs no more work, and what one bucket has found is
reused for all starts it covers. Identifiers are 64-bit hashes instead of ranks, so that any offset's identifier is known
without a lookup, and only starts that matter are sorted:

- The first buckets hold q-grams at sampled offsets: in every window of LENGTH bytes the q-gram of the least hash. Equal
  windows choose the same offset, so each repeated window has its q-gram in a bucket of two or more; other buckets go.
- A member of a bucket stands for the windows that chose it. If all bytes these windows cover (the hull) occur twice at the
  same offsets, all of them are repeated. Otherwise they are split into GRID-wide groups, whose common bytes (the core) are
  the next bucket; groups whose core is unique go, the others come down to single windows.

One member of every different hull goes on, copies never do, so a bucket of many copies costs one row a level. The counts
and joins are spread by hash; a bucket that most texts share is summed before the shuffle and its join is split by AQE.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propagon.llm.common import _BYTE, _STEP, blocks, mix, powers, saved, small_batches, text_bytes, tidy

LENGTH = 200
GRAM = 64
GRID = 12
_U = np.uint64
_INVERSE = pow(_STEP, -1, 1 << 64)
_inverses = np.ones(1, np.uint64)
NODES = "core long, hull long, t long, at long, low int, high int"


def inverses(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        out = np.full(max(n, 2 * len(_inverses)), _INVERSE, np.uint64)
        out[0] = 1
        _inverses = np.multiply.accumulate(out)
    return _inverses[:n]


class Strings:
    """Identifiers of any substring of a block."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * powers(len(buf)), out=self.sums[1:])
        self.back = inverses(len(buf) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] ^ (end - start).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` values in a row."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, ~_U(0))
    rows = np.concatenate([x, pad]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, position and window range (low, high bytes before the position) of every chosen q-gram of a block."""
    if len(buf) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    s = Strings(buf)
    i = np.arange(len(buf) - gram + 1)
    place = _U((1 << 28) - 1)
    # hash first, then the later position
    least = sliding_min((s.of(i, i + gram) & ~place) | (place - i.astype(np.uint64)), length - gram + 1)
    n = np.diff(off)
    starts = np.repeat(off[:-1], np.maximum(n - length + 1, 0))
    many = np.maximum(n - length + 1, 0)
    p = starts + np.arange(len(starts)) - np.repeat(np.cumsum(many) - many, many)
    text = np.repeat(np.arange(len(n)), many)
    a = (place - (least[p] & place)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (text[1:] != text[:-1]))) if len(a) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(a)) - 1 if len(a) else first
    return text[first], a[first], a[first] - p[last], a[first] - p[first]


def _nodes(s: Strings, begin, end, a, low, high, grid_low, grid_high, length, t) -> pa.RecordBatch:
    """Members whose windows start ``low`` to ``high`` bytes before ``a``; core and hull are those of the whole grid cell."""
    core = s.of(a - grid_low, a - grid_high + length)
    left, right = np.maximum(begin, a - grid_high), np.minimum(end, a - grid_low + length)
    hull = mix(s.of(left, right) ^ ((a - left) * 4096 + (right - a)).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(t), pa.array(a - begin), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["core", "hull", "t", "at", "low", "high"])


def first_nodes(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            t = b.column("t").to_numpy()
            for begin, end, buf, off in blocks(b.column("raw")):
                text, a, low, high = anchors(buf, off, length, gram)
                if len(a):
                    s = Strings(buf)
                    # the q-gram itself is the core of all its windows
                    yield _nodes(s, off[text], off[text + 1], a, low, high, np.zeros_like(a), np.full_like(a, length - gram), length, t[begin:end][text])

    return texts.mapInArrow(run, NODES)


def next_nodes(texts: DataFrame, members: DataFrame, length: int, grid: int) -> DataFrame:
    """Members split into groups of ``grid`` windows."""
    per = members.groupBy("t").agg(F.collect_set(F.struct("at", "low", "high")).alias("m"))

    def run(batches):
        before = None
        for b in batches:
            t = b.column("t").to_numpy()
            lists = b.column("m")
            bound, flat = lists.offsets.to_numpy(), lists.flatten()
            cols = [flat.field(k).to_numpy().astype(np.int64) for k in range(3)]
            bound = bound - bound[0]
            for begin, end, buf, off in blocks(b.column("raw")):
                s, rows = Strings(buf), []
                for i in range(begin, end):
                    if t[i] != before:  # copies stand in a row
                        rows.append(i)
                    before = t[i]
                at, low, high = (np.concatenate([np.zeros(0, np.int64), *(c[bound[i] : bound[i + 1]] for i in rows)]) for c in cols)
                text = np.repeat(np.array(rows, np.int64), [bound[i + 1] - bound[i] for i in rows]) - begin
                cell = low // grid
                n = high // grid - cell + 1
                k = np.repeat(np.arange(len(at)), n)
                cell = np.repeat(cell, n) + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                g_low, g_high = cell * grid, cell * grid + grid - 1
                if len(k):
                    yield _nodes(s, off[text[k]], off[text[k] + 1], at[k] + off[text[k]], np.maximum(low[k], g_low), np.minimum(high[k], g_high), g_low, g_high, length, t[begin:end][text[k]])

    return texts.join(per, "t").mapInArrow(run, NODES).distinct()


def settle(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(repeated members, members to split): by whether their hull and their core occur twice."""
    twice = nodes.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    kept = saved(nodes.join(twice, "core", "left_semi"), name)
    hulls = saved(kept.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(F.struct("t", "at", "low", "high")).alias("m")), name)
    found = kept.join(hulls.where("n > 1").select("core", "hull"), ["core", "hull"], "left_semi").select("t", "at", "low", "high")
    mixed = hulls.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    return found, hulls.join(mixed, "core", "left_semi").select("m.*")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, grid: int = GRID) -> DataFrame:
    """(t, spans): starts of the repeated windows of each text hash, as runs (first start, last start)."""
    spark = texts.sparkSession
    found, rest = settle(first_nodes(texts, length, gram), "grams")
    found, rest = saved(found.distinct(), "found"), saved(rest, "rest")
    tidy(spark)
    more, rest = settle(next_nodes(texts, rest, length, grid), "groups")
    more, rest = saved(more.distinct(), "found"), saved(rest, "rest")
    tidy(spark)
    last, _ = settle(next_nodes(texts, rest, length, 1), "windows")
    last = saved(last.distinct(), "found")
    tidy(spark)
    every = found.unionByName(more).unionByName(last).select("t", F.struct((F.col("at") - F.col("high")).alias("s"), (F.col("at") - F.col("low")).alias("e")).alias("x"))
    return every.groupBy("t").agg(F.collect_set("x").alias("spans"))


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, gram: int = GRAM, grid: int = GRID) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256, and kept: the bytes that stay, for every row.

    A null text is empty. Texts shorter than ``length`` lose nothing. Equal texts of that length lose everything, repeated
    rows included. Matches never cross texts. ``kept`` may cut a character that a repeated string cuts.
    """
    if not gram <= length or length > 4000:
        raise ValueError("gram <= length <= 4000")
    spark = docs.sparkSession
    small_batches(spark)
    # two different texts of one 64-bit hash would share their spans
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), text_bytes(text).alias("raw"))
    spans = saved(repeated_spans(texts, length, gram, grid), "spans")
    tidy(spark)
    source = docs.select(*keep, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), text_bytes(text).alias("raw")).join(spans, "t", "left")
    fields = source.select(*keep).withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.lit(""), "kept": F.lit(b"")}).schema

    def run(batches):
        for b in batches:
            out = []
            for raw, x in zip(b.column("raw"), b.column("spans"), strict=True):
                data = raw.as_py()
                if not x.is_valid:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data))
                    continue
                s, e = (x.values.field(k).to_numpy() for k in (0, 1))
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, s, 1)
                np.add.at(step, e + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), edges, hashlib.sha256(left).hexdigest(), left))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return source.mapInArrow(run, fields)

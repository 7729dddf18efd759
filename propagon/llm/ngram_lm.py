"""Interpolated modified Kneser-Ney bigram model of a corpus, scored from memory-mapped sorted hash arrays.

Counting: tasks turn texts into word hashes and send distinct (context, word) pairs with their counts, packed per shard;
a shard merges its pairs by sorting. Shards go by context; contexts with over HOT_SHARE of all words, of which there are
fewer than 1 / HOT_SHARE, go by pair, so no word fills a shard. Each shard is written to the shared folder as a sorted
array of 64-bit pair hashes with their counts, as wide as the shard's largest; words follow in the same way, with count,
continuation weight and backoff. Shuffle files of a step go before the next one starts.
Scoring: workers map the files and look up the sorted hashes of a block of texts; nothing is shuffled or broadcast, and
pages in use are shared by the workers of a machine. Two words of one 64-bit hash count as one: with v words that happens
with a chance of v * v / 2 ** 65.

The model needs no cap: it holds every pair of the training texts, seen once or more.
"""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propagon.llm.common import blocks, new_path, pair_hash, saved, small_batches, text_bytes, tidy, tokens

HOT_SHARE = 0.001
SHARD_TOKENS = 2_000_000
#: Words that a task holds before it counts them.
HELD_TOKENS = 2_000_000
#: Hashes of the start and the end of a text; no word has them but by chance.
START, END = np.uint64(0x1234567890ABCDEF), np.uint64(0xFEDCBA0987654321)
_U = np.uint64


def _shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _sequences(column, lower: bool):
    """Per block: (first row, rows, words with START before and END after each text, row of each entry)."""
    for begin, end, buf, off in blocks(column):
        _, _, h, row = tokens(buf, off, lower)
        n = np.bincount(row, minlength=end - begin)
        at = np.cumsum(n + 2) - (n + 2)
        seq = np.empty(len(h) + 2 * (end - begin), np.uint64)
        seq[at] = START
        seq[at + n + 1] = END
        seq[np.arange(len(h)) + 2 * row + 1] = h
        yield begin, end - begin, seq, np.repeat(np.arange(end - begin), n + 2)


def _local(uri: str) -> str:
    """Path of a shared folder that workers can map; it must be mounted on every machine."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"the model folder must be mounted on all machines; {uri} is not a file path")
    return u.path


def _write(path: str, *arrays: np.ndarray) -> None:
    """Arrays one after another; a task that runs twice leaves the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{os.getpid()}.{np.random.randint(1 << 30)}"
    with open(tmp, "wb") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    os.replace(tmp, path)


def _pairs_packed(train: DataFrame, hot: list[int], shards: int, lower: bool) -> DataFrame:
    """(shard, v, w, c): contexts, words and counts of distinct pairs of part of a task's texts, as packed arrays."""
    hot_set = np.sort(np.array(hot, np.int64).view(np.uint64))

    def run(batches):
        def flush():
            v, w = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            o = np.argsort(pair_hash(v, w), kind="stable")
            v, w = v[o], w[o]
            at = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
            c = np.diff(np.append(at, len(v))).astype(np.uint32)
            v, w = v[at], w[at]
            key = np.where(np.isin(v, hot_set), pair_hash(v, w), v)
            s = _shard_of(key, shards)
            o = np.lexsort((v, s))
            v, w, c, s = v[o], w[o], c[o], s[o]
            cut = np.searchsorted(s, np.arange(shards + 1))
            rows = [(i, *_pack(v[a:b], w[a:b], c[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3, 4))], names=["shard", "v", "vn", "w", "c"])

        held, size = [], 0
        for b in batches:
            for _, _, seq, row in _sequences(b.column("raw"), lower):
                same = row[1:] == row[:-1]
                held.append((seq[:-1][same], seq[1:][same]))
                size += len(seq)
                if size > HELD_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return train.mapInArrow(run, "shard int, v binary, vn binary, w binary, c binary")


def _pack(v, w, c):
    """Contexts in runs: distinct ones and run lengths; counts as bytes unless one is larger."""
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    n = np.diff(np.append(at, len(v))).astype(np.uint32)
    small = np.uint8 if c.max() < 256 else np.uint32
    return v[at].tobytes(), n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes(), w.tobytes(), c.astype(small).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.uint32).astype(np.int64)


def _merge(packed: DataFrame, folder: str, shards: int) -> DataFrame:
    """Writes each shard's pairs and returns what the words need: (h, n1, n2, n3, cont) and, under h null, the counts of counts."""

    def run(batches):
        # rows come sorted by shard
        held, shard = [], None

        def done():
            v, w, c = (np.concatenate([x[k] for x in held]) for k in range(3))
            key = pair_hash(v, w)
            o = np.argsort(key, kind="stable")
            key, v, w, c = key[o], v[o], w[o], c[o]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            c = np.add.reduceat(c, at)
            key, v, w = key[at], v[at], w[at]
            wide = np.min_scalar_type(int(c.max()))
            _write(f"{folder}/pairs-{shard:06d}", key, c.astype(wide), np.array([wide.itemsize], np.uint8))
            ctx, inv = np.unique(v, return_inverse=True)
            n = [np.bincount(inv, weights=hit, minlength=len(ctx)).astype(np.int64) for hit in (c == 1, c == 2, c > 2)]
            word, cont = np.unique(w, return_counts=True)
            yield from _word_rows(ctx, *n, np.zeros(len(ctx), np.int64))
            yield from _word_rows(word, *(np.zeros(len(word), np.int64),) * 3, cont)
            few = [int((c == k).sum()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([x], pa.int64()) for x in few), pa.array([len(c)], pa.int64())], names=["h", "n1", "n2", "n3", "cont", "n"])

        for b in batches:
            for s, *raw in zip(*(b.column(k).to_pylist() for k in ("shard", "v", "vn", "w", "c")), strict=True):
                if s != shard:
                    if held:
                        yield from done()
                    held, shard = [], s
                ctx, w = np.frombuffer(raw[0], np.uint64), np.frombuffer(raw[2], np.uint64)
                held.append((np.repeat(ctx, _wide(raw[1], len(ctx))), w, _wide(raw[3], len(w))))
        if held:
            yield from done()

    return packed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, "h long, n1 long, n2 long, n3 long, cont long, n long")


def _word_rows(h, n1, n2, n3, cont):
    for at in range(0, len(h), 50_000):
        s = slice(at, at + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), *(pa.array(x[s]) for x in (n1, n2, n3, cont)), pa.array(np.zeros(len(h[s]), np.int64))], names=["h", "n1", "n2", "n3", "cont", "n"])


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more; an absolute half where the counts of counts are degenerate."""
    if min(n1, n2, n3, n4) <= 0:
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def train_model(train: DataFrame, text: str = "text", lower: bool = True) -> str:
    """Counts ``train`` and writes the model, with A-Z in lower case if ``lower``; returns its folder."""
    spark = train.sparkSession
    small_batches(spark)
    uri = new_path(spark, "lm")
    folder = _local(uri)
    rows = train.select(text_bytes(text).alias("raw"))

    def words(batches):
        held, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 50_000].view(np.int64)), pa.array(c[at : at + 50_000].astype(np.int64))], names=["h", "c"])

        for b in batches:
            for _, _, seq, _ in _sequences(b.column("raw"), lower):
                held.append(seq[seq != START])
                size += len(seq)
                if size > HELD_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    counts = saved(rows.mapInArrow(words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    tidy(spark)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("h") == int(END.view(np.int64)), F.col("c"))), F.lit(0)).alias("texts")).first()
    hot = [r[0] for r in counts.where(F.col("c") > max(1, HOT_SHARE * total["n"])).select("h").collect()]  # fewer than 1 / HOT_SHARE
    hot.append(int(START.view(np.int64)))
    shards = max(1, -(-total["n"] // SHARD_TOKENS))
    stats = saved(_merge(_pairs_packed(rows, hot, shards, lower), folder, shards), "stats")
    tidy(spark)
    world = stats.where("h is null").agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n1", "n2", "n3", "cont", "n"))).first()
    per = stats.where("h is not null").groupBy("h").agg(*(F.sum(k).alias(k) for k in ("n1", "n2", "n3", "cont")))
    full = counts.join(per, "h", "full").select("h", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("c", "n1", "n2", "n3", "cont")))
    full = saved(full, "words")
    cc = full.agg(*(F.count_if(F.col("cont") == k).alias(f"k{k}") for k in (1, 2, 3, 4)), F.count_if(F.col("cont") > 2).alias("more")).first()
    d2, d1 = discounts(*world[:4]), discounts(cc["k1"], cc["k2"], cc["k3"], cc["k4"])
    types = max(1, world["n"])
    spread = d1[0] * cc["k1"] + d1[1] * cc["k2"] + d1[2] * cc["more"]
    meta = {"lower": lower, "tokens": total["n"], "words": total["v"], "texts": total["texts"], "hot": sorted(hot), "shards": shards, "d2": d2, "d1": d1, "types": types, "unseen": spread / types / (total["v"] + 1) if total["n"] else 1.0}

    def write(batches):
        held = {}
        for b in batches:
            cols = [b.column(k).to_numpy() for k in ("h", "c", "n1", "n2", "n3", "cont")]
            held.setdefault("x", []).append(cols)
        if not held:
            return
        h, c, n1, n2, n3, cont = (np.concatenate(x) for x in zip(*held["x"], strict=True))
        h = h.view(np.uint64)
        context = np.where(h == START, meta["texts"], np.where(h == END, 0, c))
        with np.errstate(divide="ignore", invalid="ignore"):
            backoff = np.where(context > 0, (d2[0] * n1 + d2[1] * n2 + d2[2] * n3) / np.maximum(context, 1), 1.0)
        low = np.maximum(cont - np.choose(np.minimum(cont, 3), [0.0, *d1]), 0) / types + meta["unseen"]
        s = _shard_of(h, shards)
        for i in np.unique(s):
            k = np.flatnonzero(s == i)
            k = k[np.argsort(h[k])]
            _write(f"{folder}/words-{i:06d}", h[k], c[k].astype(np.int64), context[k].astype(np.int64), backoff[k].astype(np.float32), low[k].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int64())], names=["shard"])

    # one task a shard: hashes are dealt by their range
    shard = F.floor(F.shiftrightunsigned("h", 32).cast("decimal(20,0)") * shards / F.lit(1 << 32).cast("decimal(20,0)")).cast("int")
    saved(full.repartitionById(shards, shard).mapInArrow(write, "shard long"), "written")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/meta.json", "w") as f:
        json.dump(meta, f)
    return folder


class Scorer:
    """A model opened by a worker."""

    def __init__(self, folder: str):
        self.meta = json.load(open(f"{folder}/meta.json"))
        self.folder, self.files = folder, {}
        self.hot = np.sort(np.array(self.meta["hot"], np.int64).view(np.uint64))

    def _file(self, name: str, width: int | None):
        """A file and its entries; without ``width``, the last byte says how wide the counts beside the hashes are."""
        if name not in self.files:
            path = f"{self.folder}/{name}"
            self.files[name] = np.memmap(path, np.uint8, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, np.uint8)
        raw = self.files[name]
        return raw, len(raw) // (width or 8 + int(raw[-1])) if len(raw) else 0

    def _find(self, kind: str, width: int | None, shard: np.ndarray, h: np.ndarray):
        """Yields (positions of the queries found, raw file, entries, positions in it); sorted queries read a shard in order."""
        o = np.lexsort((h, shard))
        cut = np.searchsorted(shard[o], np.arange(self.meta["shards"] + 1))
        for i in np.flatnonzero(np.diff(cut)):
            raw, n = self._file(f"{kind}-{i:06d}", width)
            if not n:
                continue
            q = o[cut[i] : cut[i + 1]]
            keys = raw[: 8 * n].view(np.uint64)
            at = np.searchsorted(keys, h[q])
            at[at == n] = n - 1
            ok = keys[at] == h[q]
            yield q[ok], raw, n, at[ok]

    def words(self, h: np.ndarray):
        """Count, count as context, backoff weight and continuation probability of word hashes."""
        c, x = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        g, low = np.ones(len(h)), np.full(len(h), self.meta["unseen"])
        for q, raw, n, at in self._find("words", 32, _shard_of(h, self.meta["shards"]), h):
            c[q] = raw[8 * n : 16 * n].view(np.int64)[at]
            x[q] = raw[16 * n : 24 * n].view(np.int64)[at]
            g[q] = raw[24 * n : 28 * n].view(np.float32)[at]
            low[q] = raw[28 * n : 32 * n].view(np.float32)[at]
        return c, x, g, low

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = pair_hash(v, w)
        shard = _shard_of(np.where(np.isin(v, self.hot), key, v), self.meta["shards"])
        c = np.zeros(len(key), np.int64)
        for q, raw, n, at in self._find("pairs", None, shard, key):
            c[q] = raw[8 * n : -1].view(f"u{raw[-1]}")[at]
        return c

    def score(self, column):
        """Per block: (texts, tokens, known tokens, base log10, model log10)."""
        n, v = self.meta["tokens"], self.meta["words"]
        d = np.array([0.0, *self.meta["d2"]])
        for _, rows, seq, row in _sequences(column, self.meta["lower"]):
            u, inv = np.unique(seq, return_inverse=True)
            c, x, g, low = (a[inv] for a in self.words(u))
            at = np.flatnonzero(row[1:] == row[:-1])
            prev, cur, r = at, at + 1, row[at + 1]
            pc = self.pairs(seq[prev], seq[cur])
            p = np.maximum(pc - d[np.minimum(pc, 3)], 0) / np.maximum(x[prev], 1) + g[prev] * low[cur]
            base = np.log10((c[cur] + 0.5) / (n + 0.5 * (v + 1)))
            yield rows, np.bincount(r, minlength=rows), np.bincount(r, weights=c[cur] > 0, minlength=rows).astype(np.int64), np.bincount(r, weights=base, minlength=rows), np.bincount(r, weights=np.log10(p), minlength=rows)


def score_texts(docs: DataFrame, folder: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score (log10) of each whole text, with its end.

    A null or empty text is its end alone. A model of no text gives every token the same chance.
    """
    small_batches(docs.sparkSession)
    source = docs.select(*keep, text_bytes(text).alias("__raw"))
    schema = source.drop("__raw").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def run(batches):
        m = Scorer(folder)
        for b in batches:
            parts = list(m.score(b.column("__raw")))
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (1, 2, 3, 4)]
            arrays = [pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(np.full(b.num_rows, m.meta["tokens"], np.int64)), pa.array(cols[2].astype(float)), pa.array(cols[3].astype(float))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *arrays], names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return source.mapInArrow(run, schema)


def lm_scores(docs: DataFrame, held_out: Column, keep: list[str], text: str = "text") -> DataFrame:
    """Scores of all ``docs`` by a model of those that ``held_out`` leaves in."""
    folder = train_model(docs.where(~held_out), text)
    return score_texts(docs.withColumn("held_out", held_out), folder, [*keep, "held_out"], text)

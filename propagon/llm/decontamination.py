"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words weighted by sqrt(tf) * idf over hashed words; idf comes from document frequencies over all
documents. Items stand in blocks of about RANK. A distributed randomised SVD of the passages of each block gives a latent
space that holds all items of the block, so what is found of an item does not depend on how many others there are.
Document passages are projected and compared with the benchmark by cosine, in blocks; a bound on the cosine, the sum of
the largest part that any item gives each word of a passage, spares most of them the projection and loses none. For each
pair found, the longest common subsequence of the words decides, with a closer look at the answer: the last sentence of
an item.

A window is wider or narrower than an item, and filler may hide it from the cosine. So every item is searched on shared
words too: a passage that the decision accepts lacks at most a known number of the item's words, hence holds some of its
rarest ones close together. No passage of an item's width that is accepted escapes this search.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propagon.llm.common import SPACE, blocks, fresh, saved, small_batches, text_bytes, tokens

FEATURES = 1 << 18
SLICES = 16
#: Items of a block on average; its latent space has as many directions as the block has items.
RANK = 256
OVERSAMPLE = 16
WINDOW, STRIDE = 64, 16
COSINE = 0.4
OVERLAP, PARTIAL, ANSWER = 0.75, 0.55, 0.8
MARKS = b".,;:!?\"'()[]"
#: Blocks of items that one pass over the documents holds in every task; more items take more passes.
PASS_BLOCKS = 8


def text_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Texts that hold each hashed word. Tasks send dense slices, which are summed slice by slice."""

    def count(batches):
        total = np.zeros(FEATURES, np.int64)
        for b in batches:
            for _, _, buf, off in blocks(b.column("raw")):
                _, _, h, row = plain_tokens(buf, off)
                total += np.bincount(np.unique(row * FEATURES + (h % FEATURES).astype(np.int64)) % FEATURES, minlength=FEATURES)
        if total.any():
            parts = total.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([x.astype(np.uint32 if x.max() < 1 << 32 else np.uint64).tobytes() for x in parts], pa.binary())], names=["slice", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, raw in zip(b.column("slice").to_pylist(), b.column("n").to_pylist(), strict=True):
                wide = FEATURES // SLICES
                x = np.frombuffer(raw, np.uint32 if len(raw) == 4 * wide else np.uint64).astype(np.int64)
                total[s] = total[s] + x if s in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "n"])

    raw = docs.select(text_bytes(text).alias("raw"))
    rows = raw.mapInArrow(count, "slice long, n binary").repartition(SLICES, "slice").mapInArrow(add, "slice long, n binary").collect()
    out = np.zeros((SLICES, FEATURES // SLICES), np.int64)
    for r in rows:  # FEATURES numbers, whatever the corpus
        out[r["slice"]] = np.frombuffer(r["n"], np.int64)
    return out.ravel()


def passage(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of length 1 of the words of one passage."""
    f, tf = np.unique((h % FEATURES).astype(np.int64), return_counts=True)
    x = np.sqrt(tf) * idf[f]
    return f, x / max(np.linalg.norm(x), 1e-12)


def randomised_svd(items: DataFrame, idf: np.ndarray, rank: int, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(features, basis): an orthonormal basis of the strongest ``rank`` directions of the items' passages.

    Each step multiplies the matrix, row block by row block in tasks, and its transpose with a thin block of directions;
    partial products are sums over features that occur in the benchmark.
    """
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    def used(batches):
        seen = [np.zeros(0, np.int64)]
        for b in batches:
            for _, _, buf, off in blocks(b.column("raw")):
                seen.append(np.unique((plain_tokens(buf, off)[2] % FEATURES).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(seen)))], names=["f"])

    feats = np.array(sorted(r[0] for r in items.mapInArrow(used, "f long").distinct().collect()), np.int64)  # FEATURES at most
    width = min(rank + OVERSAMPLE, max(1, len(feats)))
    rng = np.random.Generator(np.random.PCG64(11))
    q = rng.standard_normal((len(feats), width)).astype(np.float32)
    for _ in range(steps + 1):
        block = spark.sparkContext.broadcast(np.linalg.qr(q)[0].astype(np.float32) if len(feats) else q)

        def multiply(batches, block=block):
            y = np.zeros((len(feats), width), np.float32)
            for b in batches:
                for _, _, buf, off in blocks(b.column("raw")):
                    _, _, h, row = plain_tokens(buf, off)
                    for part in np.split(h, np.flatnonzero(np.diff(row)) + 1):
                        if len(part):
                            f, x = passage(part, shared.value)
                            i = np.searchsorted(feats, f)
                            y[i] += x[:, None] * (x @ block.value[i])[None, :]
            cut = np.linspace(0, len(feats), SLICES + 1).astype(int)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([y[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["slice", "y"])

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for s, raw in zip(b.column("slice").to_pylist(), b.column("y").to_pylist(), strict=True):
                    x = np.frombuffer(raw, np.float32)
                    total[s] = total[s] + x if s in total else x
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "y"])

        parts = items.mapInArrow(multiply, "slice long, y binary").repartition(SLICES, "slice").mapInArrow(add, "slice long, y binary").collect()
        q = np.concatenate([np.frombuffer(r["y"], np.float32) for r in sorted(parts, key=lambda r: r["slice"])]).reshape(len(feats), width) if parts else np.zeros((len(feats), width), np.float32)
        block.destroy()
    u, s, _ = np.linalg.svd(q, full_matrices=False) if len(feats) else (q, np.zeros(0), None)
    keep = min(rank, int((s > 1e-7 * s.max(initial=0)).sum()))
    return feats, u[:, :keep].astype(np.float32)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for x in b:
        m = row | where.get(x, 0)
        row = m & ~(m - (row << 1 | 1)) & full
    return row.bit_count()


class Item:
    """An item's words and those of its answer, the last sentence of three words or more."""

    def __init__(self, item_id, raw: bytes):
        self.id, self.words = item_id, plain_words(raw)
        parts = [plain_words(p) for p in re.split(rb"(?<=[.!?\n])[\x20\x09-\x0D]+", raw)]
        self.answer = next((p for p in reversed(parts) if len(p) >= 3), self.words)

    def judge(self, words: list[bytes]) -> tuple[float, float]:
        return lcs(self.words, words) / max(1, len(self.words)), lcs(self.answer, words) / max(1, len(self.answer))


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-case words without the punctuation around them."""
    out = (w.strip(MARKS) for w in raw.lower().split())
    return [w for w in out if w]


_MARK = np.isin(np.arange(256), list(MARKS))


def plain_tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of the words of ``plain_words``: punctuation around words is blanked."""
    buf = buf.copy()
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    at = np.flatnonzero(_MARK[buf])
    while len(at):
        outer = edge[at] | SPACE[buf[at - 1]] | edge[at + 1] | SPACE[buf[np.minimum(at + 1, len(buf) - 1)]]
        if not outer.any():
            break
        buf[at[outer]] = 32
        at = at[~outer]
    return tokens(buf, off, True)


def span(n: int) -> int:
    """Words that a passage of an item of ``n`` words spans at most, replaced and inserted ones included."""
    return n + min(n, 2 * STRIDE)


class Seeds:
    """For each word, the items that have it among their rarest.

    An accepted passage holds at least m of an item's n words. So of the item's n - m + j rarest words j at least are in
    it, whichever are lacking.
    """

    def __init__(self, items: list[Item], counts: np.ndarray):
        self.least, self.reach = np.ones(len(items), np.int64), np.ones(len(items), np.int64)
        self.bits: list[dict] = [{} for _ in items]
        self.need = np.ones(len(items), np.int64)
        words, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, item in enumerate(items):
            n = len(item.words)
            if not n:
                continue
            m = next(x for x in range(1, n + 1) if x / n >= min(OVERLAP, PARTIAL))
            j = max(1, m // 4)
            raw = np.frombuffer(b" ".join(item.words), np.uint8)
            h = tokens(raw, np.array([0, len(raw)]), True)[2]
            for i, x in enumerate(h.tolist()):
                self.bits[k][x] = self.bits[k].get(x, 0) | 1 << i
            self.need[k] = m
            h = np.unique(h[np.lexsort((h, counts[(h % FEATURES).astype(np.int64)]))][: n - m + j])
            self.least[k], self.reach[k] = j, span(n)
            words.append(h)
            owners.append(np.full(len(h), k))
        word, owner = np.concatenate(words), np.concatenate(owners)
        o = np.lexsort((owner, word))
        self.owner = owner[o]
        self.word, self.first, self.size = np.unique(word[o], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.word & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def possible(self, k: int, hashes: list[int]) -> bool:
        """Whether the words with these hashes hold enough of an item's, in order."""
        bits, need = self.bits[k], int(self.need[k])
        got = [bits[x] for x in hashes if x in bits]
        if len(got) < need:
            return False
        row, full = 0, (1 << sum(b.bit_count() for b in bits.values())) - 1
        for x in got:
            m = row | x
            row = m & ~(m - (row << 1 | 1)) & full
        return row.bit_count() >= need

    def regions(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, begin, end) of runs of words that hold every passage with enough of an item's rarest words."""
        t = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.word, h[t]), max(0, len(self.word) - 1))
        same = self.word[at] == h[t] if len(self.word) else np.zeros(len(t), bool)
        t, at = t[same], at[same]
        many = self.size[at]
        k = self.owner[np.repeat(self.first[at], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
        t = np.repeat(t, many)
        o = np.lexsort((t, k, row[t]))
        t, k = t[o], k[o]
        last = np.arange(len(t)) + self.least[k] - 1
        ok = last < len(t)
        i, last = np.flatnonzero(ok), last[ok]
        ok = (k[i] == k[last]) & (row[t[i]] == row[t[last]]) & (t[last] - t[i] < self.reach[k[i]])
        i, last = i[ok], last[ok]
        lo, hi = np.searchsorted(row, row[t[i]], "left"), np.searchsorted(row, row[t[i]], "right")
        wide = self.reach[k[i]]
        lo, hi = np.maximum(lo, t[last] - wide + 1), np.minimum(hi, t[i] + wide)
        # runs that begin close to each other become one
        near = t[i] // np.maximum(wide // 2, 1)
        one = np.flatnonzero(np.append(True, (k[i][1:] != k[i][:-1]) | (row[t[i]][1:] != row[t[i]][:-1]) | (near[1:] != near[:-1]))) if len(i) else i
        return row[t[i]][one], k[i][one], np.minimum.reduceat(lo, one) if len(one) else lo, np.maximum.reduceat(hi, one) if len(one) else hi


def closest(item: Item, words: list[bytes]) -> tuple[float, float, int] | None:
    """(share of the words, of the answer's, place) of the best accepted passage of ``words``, if there is one."""
    if not leaked(*item.judge(words)):  # a longer passage holds no less
        return None
    wide = span(len(item.words))
    best = None
    for s in range(max(1, len(words) - wide + 1)):
        x = (*item.judge(words[s : s + wide]), s)
        if leaked(*x[:2]) and (best is None or x[:2] > best[:2]):
            best = x
    return best


def leaked(whole: float, answer: float) -> bool:
    return whole >= OVERLAP or (whole >= PARTIAL and answer >= ANSWER)


def cosine_of(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    return float(one[1][i] @ two[1][j])


class Space:
    """Latent vectors of the items of one block; ``first`` is the place of the first of them."""

    def __init__(self, first: int, passages: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, feats: np.ndarray, basis: np.ndarray):
        self.first = first
        latent = np.zeros((len(passages), basis.shape[1]), np.float32)
        for k, (f, x) in enumerate(passages):
            if len(f):
                latent[k] = x.astype(np.float32) @ basis[np.searchsorted(feats, f)]
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.place = np.full(FEATURES, -1, np.int32)
        self.place[feats] = np.arange(len(feats))
        self.weighted = basis * idf[feats][:, None].astype(np.float32)
        # the most that one occurrence of a word adds to any item's product; sqrt(tf) counts occurrences no higher than tf
        self.most = np.zeros(FEATURES, np.float32)
        for at in range(0, len(feats), 4096):
            self.most[feats[at : at + 4096]] = (self.weighted[at : at + 4096] @ self.latent.T).max(axis=1, initial=0.0)


def _search(docs: DataFrame, parts: list[tuple], idf: np.ndarray, counts: np.ndarray, keep: list[str], text: str) -> DataFrame:
    """Leaks of the items of some blocks (items, features, basis)."""
    spark = docs.sparkSession
    made = [Item(i, raw) for items, _, _ in parts for i, raw in items]
    passages, spaces = [], []
    for items, feats, basis in parts:
        own = []
        for _, raw in items:
            buf = np.frombuffer(raw, np.uint8)
            own.append(passage(plain_tokens(buf, np.array([0, len(buf)]))[2], idf))
        spaces.append(Space(len(passages), own, idf, feats, basis))
        passages += own
    shared = spark.sparkContext.broadcast((idf.astype(np.float32), spaces, passages, made, Seeds(made, counts)))
    raw = fresh(docs, "raw")
    source = docs.select(*keep, text_bytes(text).alias(raw))
    schema = source.drop(raw).schema.add("item_id", "string").add("cosine", "double").add("overlap", "double").add("answer", "double")

    def run(batches):
        idf, spaces, passages, made, seeds = shared.value
        square = idf.astype(np.float64) ** 2
        for b in batches:
            found = []
            for begin, end, buf, off in blocks(b.column(raw)):
                near = []
                first, last, h, row = plain_tokens(buf, off)
                if not len(h) or not len(made):
                    continue
                f = (h % np.uint64(FEATURES)).astype(np.int64)
                mass = np.concatenate([[0.0], np.cumsum(square[f])])
                cut = np.searchsorted(row, np.arange(end - begin + 1))
                # chunks of STRIDE words from each text's start; a window is WINDOW words from a chunk's start, or up to the end
                chunks = -(-np.diff(cut) // STRIDE)
                before = np.cumsum(chunks) - chunks
                of = np.repeat(np.arange(end - begin), chunks)
                start = cut[of] + (np.arange(len(of)) - before[of]) * STRIDE
                stop = np.minimum(start + STRIDE, cut[of + 1])
                many = np.where(chunks > 0, np.maximum(0, chunks - WINDOW // STRIDE) + 1, 0)
                doc = np.repeat(np.arange(end - begin), many)
                c0 = before[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                c1 = np.minimum(c0 + WINDOW // STRIDE, before[doc] + chunks[doc])
                s, e = start[c0], stop[c1 - 1]
                norm = mass[e] - mass[s]
                for space in spaces:
                    latent, weighted, place = space.latent, space.weighted, space.place
                    at = place[f]
                    reach = np.concatenate([[0.0], np.cumsum(space.most[f], dtype=np.float64)])
                    live = np.flatnonzero(reach[e] - reach[s] >= 0.999 * COSINE * np.sqrt(norm))
                    for base in range(0, len(live), 2048):
                        ids = live[base : base + 2048]
                        span_of = np.minimum(c0[ids][:, None] + np.arange(WINDOW // STRIDE), c1[ids][:, None] - 1)
                        used = np.unique(span_of)
                        size = stop[used] - start[used]
                        w = np.repeat(np.arange(len(used)), size)
                        t = np.repeat(start[used], size) + np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
                        w, t = w[at[t] >= 0], t[at[t] >= 0]
                        # a chunk's sum of latent words, added up over the chunks of a window
                        z = np.zeros((len(used), weighted.shape[1]), np.float32)
                        edges = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
                        if len(edges):
                            z[w[edges]] = np.add.reduceat(weighted[at[t]], edges, axis=0)
                        by_item = z @ latent.T
                        place_of = np.searchsorted(used, span_of)
                        cosine = by_item[place_of[:, 0]]
                        for k in range(1, WINDOW // STRIDE):
                            more = c0[ids] + k < c1[ids]
                            cosine[more] += by_item[place_of[more, k]]
                        cosine /= np.sqrt(norm[ids])[:, None].astype(np.float32)
                        # words that repeat in a window count by the root of their number: only windows that may pass are looked at
                        ids = ids[(cosine >= COSINE).any(axis=1)]
                        size = e[ids] - s[ids]
                        w = np.repeat(np.arange(len(ids)), size)
                        t = np.repeat(s[ids], size) + np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
                        w, t = w[at[t] >= 0], t[at[t] >= 0]
                        key, tf = np.unique(w * np.int64(FEATURES) + f[t], return_counts=True)
                        w, x = key // FEATURES, np.sqrt(tf).astype(np.float32)
                        edges = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
                        z = np.zeros((len(ids), weighted.shape[1]), np.float32)
                        if len(edges):
                            z[w[edges]] = np.add.reduceat(weighted[place[key % FEATURES]] * x[:, None], edges, axis=0)
                        cosine = (z / np.sqrt(norm[ids])[:, None].astype(np.float32)) @ latent.T
                        for i, k in zip(*np.nonzero(cosine >= COSINE), strict=True):
                            near.append((int(doc[ids[i]]), space.first + int(k), float(cosine[i, k]), int(s[ids[i]]), int(e[ids[i]])))
                best: dict = {}
                for i, k, cos, ws, we in near:
                    lo, hi = max(int(cut[i]), ws - STRIDE), min(int(cut[i + 1]), max(we, ws + len(made[k].words)) + STRIDE)
                    o = best.setdefault((begin + i, k), [cos, 0.0, 0.0])
                    o[0] = max(o[0], cos)
                    whole, answer = made[k].judge(plain_words(buf[first[lo] : last[hi - 1]].tobytes()))
                    if (leaked(whole, answer), whole) > (leaked(o[1], o[2]), o[1]):
                        o[1:] = [whole, answer]
                for i, k, lo, hi in zip(*(x.tolist() for x in seeds.regions(h, row)), strict=True):
                    o = best.get((begin + i, k), [0.0, 0.0, 0.0])
                    if leaked(o[1], o[2]) or not seeds.possible(k, h[lo:hi].tolist()):
                        continue
                    words = [buf[s:e].tobytes().lower() for s, e in zip(first[lo:hi].tolist(), last[lo:hi].tolist(), strict=True)]
                    hit = closest(made[k], words)
                    if hit is not None:
                        best[begin + i, k] = o
                        o[1:] = hit[:2]
                        a, z = first[lo + hit[2]], last[min(hi, lo + hit[2] + span(len(made[k].words))) - 1]
                        o[0] = max(o[0], cosine_of(passage(plain_tokens(buf[a:z], np.array([0, z - a]))[2], idf), passages[k]))
                found += [(r, k, *o) for (r, k), o in best.items() if leaked(o[1], o[2])]
            if found:
                take = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in keep), pa.array([made[x[1]].id for x in found], pa.string()), *(pa.array([float(x[k]) for x in found]) for k in (2, 3, 4))], names=[*keep, "item_id", "cosine", "overlap", "answer"])

    return source.mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """``keep`` columns, item_id, cosine, overlap and answer (shares of an item's words and of its answer's, in order):
    one row for each document row and benchmark item found in it.

    Null, empty and wordless texts and items leak nothing. Repeated rows are found as often as they come; repeated items
    have a row each. An empty benchmark or table gives no rows.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    small_batches(spark)
    items = saved(benchmark.select(F.col(id_col).cast("string").alias("id"), text_bytes(text).alias("raw")).where(F.length("raw") > 0), "items")
    own = benchmark.schema[id_col].dataType
    number = items.count()
    if not number:
        return docs.select(*keep).withColumns({"item_id": F.lit(None).cast(own), "cosine": F.lit(0.0), "overlap": F.lit(0.0), "answer": F.lit(0.0)}).where("false")
    counts = text_counts(docs, text)
    idf = np.log((docs.count() + 1.0) / (counts + 0.5)).clip(0.1)
    blocks_of = -(-number // RANK)
    passes = -(-blocks_of // PASS_BLOCKS)
    block = F.pmod(F.xxhash64("id", "raw"), F.lit(blocks_of))
    out = None
    for first in range(passes):
        parts = []
        for at in range(first, blocks_of, passes):
            rows = items.where(block == at)
            held = [(r["id"], bytes(r["raw"])) for r in rows.collect()]  # about RANK items
            if held:
                parts.append((held, *randomised_svd(rows, idf, len(held))))
        if parts:
            found = _search(docs, parts, idf, counts, keep, text)
            out = found if out is None else out.unionByName(found)
    return out.withColumn("item_id", F.col("item_id").cast(own))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""
    k = fresh(docs, "k")
    keyed = docs.withColumn(k, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    bad = saved(leaks(keyed, benchmark, [k], id_col, text).select(k).distinct(), "leaks")
    return keyed.join(bad, k, "left_anti").select(*docs.columns)

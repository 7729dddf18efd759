"""Toxicity by maximum-scoring segments of words.

Words get log-odds between toxic and other labelled texts with an informative Dirichlet prior, shrunk by their
significance; so do the first 4, 5 and 6 bytes of words, which hold for inflections never seen. The feature of the largest
log-odds speaks for a word. A text is a sequence of such scores with a small cost for every other word; a linear scan finds all maximal
segments. The largest segment of a clean text of n words follows an extreme-value law, P(sum >= x) = 1 - exp(-K n e^-lx),
fitted to held-back clean labelled texts; it turns each passage into a p-value. Passages that remain significant for the length
of their text are combined, and one logistic curve on the held-back texts maps the evidence to a score.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propagon.llm.common import _BYTE, LOWER, WORD, blocks, crc_mod, fresh, mix, powers, saved, small_batches, text_bytes, tokens

#: Size of the model: words of the largest absolute z-score that are kept, and words of the prior.
MAX_WORDS = 20_000
PRIOR_WORDS = 1_000.0
MIN_COUNT = 2
SIGNIFICANT = 0.05
CLIP = 6.0
NOISE = 3.5


PREFIXES = (4, 5, 6)
_BEGINS = np.uint64(0x51ED270B9F3A6D4D)


def feature_hash(words: list[bytes], prefix: list[bool]) -> np.ndarray:
    """The hash that ``tokens`` gives each word, or that of words that begin so."""
    buf = np.frombuffer(b" ".join(words), np.uint8)
    h = tokens(buf, np.array([0, len(buf)]), False)[2]
    return np.where(np.array(prefix), mix(h ^ _BEGINS), h)


def prefix_hash(buf: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Hash of the first ``k`` bytes of words at least as long."""
    chars = LOWER[buf[start[:, None] + np.arange(k)]]
    value = (_BYTE[chars] * powers(k)).sum(axis=1)
    return mix(mix(value ^ np.uint64(k * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)) ^ _BEGINS)


def _beginnings(words: str, k: int) -> Column:
    """First ``k`` bytes of the words that have as many."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.substring(w, 1, k))


def log_odds(counts: DataFrame, max_words: int = MAX_WORDS) -> pd.DataFrame:
    """(word, prefix, weight) from (word, prefix, toxic, other): the features of the largest z-scores, at most ``max_words``."""
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    t, o = float(total["t"] or 0), float(total["o"] or 0)
    if not t or not o:
        return pd.DataFrame({"word": [], "prefix": [], "weight": []})
    prior = PRIOR_WORDS * (F.col("toxic") + F.col("other")) / (t + o)
    a, b = F.col("toxic") + prior, F.col("other") + prior
    delta = F.log(a / (t + PRIOR_WORDS - a)) - F.log(b / (o + PRIOR_WORDS - b))
    # signed root of the likelihood ratio against equal rates
    n = F.col("toxic") + F.col("other")
    part = lambda c, rate: F.when(c > 0, c * F.log(c / (n * rate))).otherwise(0.0)
    g = 2 * (part(F.col("toxic"), t / (t + o)) + part(F.col("other"), o / (t + o)))
    z = F.signum(delta) * F.sqrt(F.greatest(g, F.lit(0.0)))
    best = counts.where(F.col("toxic") + F.col("other") >= MIN_COUNT).select("word", "prefix", delta.alias("delta"), z.alias("z")).orderBy(F.abs("z").desc(), "prefix", "word").limit(max_words).toPandas()
    # a feature counts as far as its log-odds exceed their noise
    best["weight"] = (best.delta * np.maximum(0, 1 - NOISE / best.z.abs().clip(lower=1e-9))).clip(-CLIP, CLIP)
    return best[best.weight != 0][["word", "prefix", "weight"]]


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all maximal-scoring segments, by one pass with a stack of candidates.

    Each positive run joins the earlier candidates to its left as long as that raises the sum; the list is that of the
    recursive definition: the best segment, then the best ones on either side of it.
    """
    out: list[list] = []
    total = 0.0
    for i, s in enumerate(score.tolist()):
        left = total
        total += s
        if s <= 0:
            continue
        seg = [left, total, i, i + 1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= seg[0]:
                j = out[j][4]
            if j < 0 or out[j][1] >= seg[1]:
                out.append([*seg, j])
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(a, b, r - le) for le, r, a, b, _ in out]


def _merged(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal sign as single scores, and the first word of each: maximal segments keep whole runs."""
    sign = weight > 0
    at = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
    return np.add.reduceat(weight, at), at


class Model:
    """Sorted word hashes with their weights, the cost of other words, the extreme-value law and the logistic curve."""

    def __init__(self, words: pd.DataFrame, cost: float):
        h = feature_hash([bytes(w) for w in words.word], words.prefix.tolist()) if len(words) else np.zeros(0, np.uint64)
        o = np.argsort(h)
        self.keys, self.weights, self.cost = h[o], words.weight.to_numpy(float)[o] if len(words) else np.zeros(0), cost
        self.rate, self.log_k, self.slope, self.base = 1.0, 0.0, 0.0, math.log(0.02 / 0.98)

    def _of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], 0.0)

    def passages(self, column):
        """Per text: its number of words, the maximal segments (word, word, sum), the words' first and end bytes, and the
        scores of its words that the model knows."""
        for begin, end, buf, off in blocks(column):
            start, stop, h, row = tokens(buf, off, True)
            w = self._of(h)
            for k in PREFIXES:
                i = np.flatnonzero(stop - start >= k)
                p = self._of(prefix_hash(buf, start[i], k))
                w[i] = np.where(np.abs(p) > np.abs(w[i]), p, w[i])
            w -= self.cost
            cut = np.searchsorted(row, np.arange(end - begin + 1))
            for i in range(end - begin):
                s, e = cut[i], cut[i + 1]
                part = w[s:e]
                found = []
                if len(part) and part.max() > 0:
                    runs, first = _merged(part)
                    bound = np.append(first, e - s)
                    found = [(int(bound[a]), int(bound[b]), x) for a, b, x in segments(runs)]
                yield int(e - s), found, start[s:e] - off[i], stop[s:e] - off[i], part[part != -self.cost]

    def evidence(self, n: int, sums: list[float]) -> float:
        """-log10 of the p-values of significant passages, added up; of the best passage where none is."""
        if not sums:
            return 0.0
        p = [-math.expm1(-math.exp(min(50.0, math.log(n + 1) + self.log_k - self.rate * x))) for x in sums]
        lows = [-math.log10(max(x, 1e-12)) for x in p]
        strong = [y for x, y in zip(p, lows, strict=True) if x <= SIGNIFICANT]
        return sum(strong) if strong else max(lows)

    def calibrate(self, n: np.ndarray, sums: list[list[float]], known: list[list[float]], toxic: np.ndarray) -> None:
        """Extreme-value law from the clean texts, logistic curve from all by Newton steps.

        The rate l solves E[e^(l s)] = 1 over the scores s of clean words; K is its likeliest value given the rate.
        """
        clean = np.flatnonzero(toxic == 0)
        words = n[clean].sum()
        # one word of the largest weight stands for clean uses not seen
        hits = np.concatenate([[self.weights.max(initial=0.0) - self.cost], *(known[i] for i in clean)])
        if words and hits.max() > 0:
            low, high = 1e-6, 20.0
            for _ in range(60):
                mid = (low + high) / 2
                over = (words - len(hits)) * math.exp(-mid * self.cost) + np.exp(mid * hits).sum() > words
                low, high = (low, mid) if over else (mid, high)
            self.rate = max(low, 0.05)
            best = np.array([max(sums[i], default=0.0) for i in clean])
            self.log_k = math.log(len(clean) / ((n[clean] + 1) * np.exp(-self.rate * best)).sum())
        x = np.array([self.evidence(int(a), b) for a, b in zip(n, sums, strict=True)])
        if toxic.sum() < 3 or (toxic == 0).sum() < 3:
            return
        d = np.stack([x, np.ones_like(x)], axis=1)
        w = np.zeros(2)
        ridge = np.diag([0.05, 1e-3])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge, d.T @ (toxic - p) - ridge @ w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.base = float(max(w[0], 0)), float(w[1])

    def score(self, n: int, sums: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.base + self.slope * self.evidence(n, sums)))))


#: Labelled texts that train the model at most.
MAX_TEXTS = 12_000


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", id_col: str = "doc_id", max_words: int = MAX_WORDS, max_texts: int = MAX_TEXTS) -> Model:
    """A model from rows with a label of 0 or 1; others are left out.

    Of them the ``max_texts`` of the least hashes serve (ties at the bound go together, so that copies count as one). A
    quarter by hash of the texts is held back for the extreme-value law and the curve; the others give the counts.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("y"))
    h = F.xxhash64(F.lit("sample"), "t")
    cut = rows.select(h.alias("h")).orderBy("h").limit(max_texts).agg(F.max("h")).first()[0]
    rows = saved(rows.where(h <= F.lit(cut if cut is not None else 0)), "labelled")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "t"), F.lit(4)))
    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.regexp_extract_all(lower, F.lit(WORD), 0))
    # a text tells of a feature once, and equal texts count once: repeats are not independent
    each = rows.where("fold <> 0").dropDuplicates(["t", "y"]).select("y", F.transform(words, lambda w: w.cast("binary")).alias("w"))
    whole = each.select("y", F.explode("w").alias("word"), F.lit(False).alias("prefix"))
    begun = [_beginnings("w", k) for k in PREFIXES]
    starts = each.select("y", F.explode(F.array_distinct(F.concat(*begun))).alias("word"), F.lit(True).alias("prefix"))
    counts = saved(whole.union(starts).groupBy("word", "prefix").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("other")), "words")
    best = log_odds(counts, max_words)
    model = Model(best, cost=0.15)
    small_batches(labelled.sparkSession)
    back = rows.where("fold = 0").select(text_bytes("t").alias("raw"), "y")

    def run(batches):
        for b in batches:
            found = list(model.passages(b.column("raw")))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([[x[2] for x in f[1]] for f in found], pa.list_(pa.float64())), pa.array([f[4].tolist() for f in found], pa.list_(pa.float64())), b.column("y")], names=["n", "sums", "known", "y"])

    seen = back.mapInArrow(run, "n long, sums array<double>, known array<double>, y int").toPandas()
    model.calibrate(seen.n.to_numpy(float), [list(x) for x in seen.sums], [np.asarray(x) for x in seen.known], seen.y.to_numpy(float))
    return model


def toxicity(docs: DataFrame, model: Model, keep: list[str], text: str = "text", score_col: str = "score", passages_col: str = "passages") -> DataFrame:
    """``keep`` columns, score (0 to 1) and passages (under the names given), the significant ones: words from ``first`` before ``end``, bytes from
    ``at`` before ``to``, and the sum of log-odds. A null or empty text has no passage and gets the model's base score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most max_words words
    raw = fresh(docs, "raw")
    source = docs.select(*keep, text_bytes(text).alias(raw))
    schema = source.drop(raw).withColumns({score_col: F.lit(0.0), passages_col: F.expr("cast(null as array<struct<first:int,end:int,at:bigint,to:bigint,sum:double>>)")}).schema
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("at", pa.int64()), ("to", pa.int64()), ("sum", pa.float64())]))

    def run(batches):
        m = shared.value
        for b in batches:
            score, spans = [], []
            for n, segs, at, to, _ in m.passages(b.column(raw)):
                score.append(m.score(n, [x[2] for x in segs]))
                spans.append([{"first": s, "end": e, "at": int(at[s]), "to": int(to[e - 1]), "sum": x} for s, e, x in segs if m.evidence(n, [x]) >= -math.log10(SIGNIFICANT)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score, pa.float64()), pa.array(spans, kind)], names=[*keep, score_col, passages_col])

    return source.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """Documents with a label, apart from the fifth that is held out (crc32 of the id modulo 5 is 0): the ``max_texts`` ids
    of the least hashes at most. The sample is drawn from the labels, so that only its texts are looked at."""
    own = labels.select(F.col("doc_id").alias("__id"), "toxic").where("__id is not null and toxic is not null").where(crc_mod("__id", 5) != 0)
    # labels that disagree count as toxic, whatever their order
    own = own.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(max_texts)
    return docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("__id")).drop("__id")

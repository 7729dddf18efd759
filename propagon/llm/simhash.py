"""Near-duplicates by SimHash over a Gray-ordered hierarchical index.

Fingerprints that share a key are sorted by Gray rank, so that neighbours differ in few bits. Runs of 16 become nodes
that hold the bits all members share (mask and pattern); 16 nodes become an upper node, which factors out the bits its
children share. A search adds up differing bits on the way down and drops a whole group once the sum exceeds the radius.

An index holds the fingerprints that share a key. Keys come from the pigeonhole rule: of r + 1 blocks of a 64-bit
fingerprint, one at least agrees between fingerprints at r differing bits, so every link has a key in common and none is
lost. A key takes only as many bits of its block as leave an index GROUP fingerprints or so, and its search does the rest.
Keys with more than ``limit`` different fingerprints are not gathered: their fingerprints link through the 65 fingerprints
within one bit of each, two of which coincide exactly when two fingerprints differ in two bits or fewer.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from propagon.llm.common import components, fresh, mix, saved, small_batches, text_bytes, tidy

FAN = 16
#: Fingerprints that an index holds on average.
GROUP = 1024
_U = np.uint64


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included; of all words where there are fewer."""
    w = raw.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= width:
        runs = [b" ".join(w)]
    else:
        runs = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in runs), np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes; zero for none."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], width: int, count: int = 1, text: str = "text", distinct: bool = False, few: float | None = None) -> DataFrame:
    """``keep`` columns and f0, f1 ..: independent 64-bit fingerprints of each text, of its shingles or of their set; with
    ``few`` also p, the least shingle hashes of a text of FEW or less, one of which texts of that similarity share, and z, the
    number of distinct shingles."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, text_bytes(text).alias("__raw"))
    schema = source.drop("__raw").schema
    for i in range(count):
        schema = schema.add(f"f{i}", "long")
    if few is not None:
        schema = schema.add("p", ArrayType(LongType())).add("z", "integer")

    def run(batches):
        seeds = [_U(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(count)]
        for b in batches:
            out = np.zeros((count, b.num_rows), np.uint64)
            least, size = [], []
            for i, raw in enumerate(b.column("__raw")):
                h = shingle_hashes(raw.as_py(), width)
                h = np.unique(h) if distinct else h
                size.append(len(h))
                least.append(h[: len(h) - math.ceil(few * len(h)) + 1].view(np.int64).tolist() if few is not None and len(h) <= FEW else [])
                for j in range(count):
                    out[j, i] = fingerprint(mix(h ^ seeds[j]) if j else h)
            more = [] if few is None else [pa.array(least, pa.list_(pa.int64())), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x.view(np.int64)) for x in out), *more], names=schema.names)

    return source.mapInArrow(run, schema)


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Position of each bit pattern in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        f = f ^ (f >> _U(s))
    return f


class GrayIndex:
    """Hierarchical index over different 64-bit fingerprints."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        pattern, mask = fps[self.order], np.full(len(fps), ~_U(0))
        self.levels = [(pattern, mask)]
        while len(pattern) > FAN:
            at = np.arange(0, len(pattern), FAN)
            first = np.repeat(pattern[at], np.diff(np.append(at, len(pattern))))
            mask = np.bitwise_and.reduceat(mask & ~(pattern ^ first), at)
            pattern = pattern[at] & mask
            self.levels.append((pattern, mask))

    def within(self, queries: np.ndarray, radius: int):
        """(query, member) positions at ``radius`` bits or fewer, in pieces."""
        step = max(16, min(512, (1 << 22) // max(1, len(self.order))))
        for begin in range(0, len(queries), step):
            q = queries[begin : begin + step]
            top = len(self.levels) - 1
            who = np.repeat(np.arange(len(q)), len(self.levels[top][0]))
            node = np.tile(np.arange(len(self.levels[top][0])), len(q))
            far = np.zeros(len(who), np.uint8)
            above = np.zeros(len(who), np.uint64)
            for level in range(top, -1, -1):
                pattern, mask = self.levels[level]
                m = mask[node]
                far = far + np.bitwise_count((q[who] ^ pattern[node]) & m & ~above)
                near = far <= radius
                who, node, far, above = who[near], node[near], far[near], m[near]
                if level:
                    n = len(self.levels[level - 1][0])
                    child = node[:, None] * FAN + np.arange(FAN)
                    ok = child < n
                    count = ok.sum(axis=1)
                    who, far, above, node = np.repeat(who, count), np.repeat(far, count), np.repeat(above, count), child[ok]
            yield begin + who, self.order[node]


def join_parts(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lets positions that the pairs (a, b) connect share their least label, in place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def runs_of(batches, keys: list[str], limit: int):
    """Consecutive rows of equal keys as one table; longer runs come in pieces of ``limit`` rows, wherever batches end.
    (table, long)"""
    held: list[pa.Table] = []
    held_key, size, long = None, 0, False
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        t = pa.Table.from_batches([b])
        for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
            key = tuple(c[s] for c in cols)
            if key != held_key:
                if held:
                    yield pa.concat_tables(held), long
                held, held_key, size, long = [], key, 0, False
            while size + e - s > limit:
                held.append(t.slice(s, limit - size))
                s += limit - size
                long = True
                yield pa.concat_tables(held), True
                held, size = [], 0
            held.append(t.slice(s, e - s))
            size += e - s
    if held:
        yield pa.concat_tables(held), long


def _link_keys(keyed: DataFrame, radius: int, limit: int) -> DataFrame:
    """(a, b, long) edges inside each key k: each linked fingerprint and the first of its part; b null and long for the
    fingerprints of long keys."""

    def run(batches):
        for t, long in runs_of(batches, ["k"], limit):
            f = t.column("f").to_numpy().view(np.uint64)
            if long:
                yield _edges(f, np.full(len(f), -1), True)
                continue
            if len(f) < 2:
                continue
            label = np.arange(len(f))
            for a, b in GrayIndex(f).within(f, radius):
                join_parts(label, a[a < b], b[a < b])
            linked = np.flatnonzero(label != np.arange(len(f)))
            if len(linked):
                yield _edges(f[linked], f[label[linked]].view(np.int64), False)

    return keyed.repartition("k").sortWithinPartitions("k", "f").mapInArrow(run, "a long, b long, long boolean")


def _edges(a, b, long: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(b.astype(np.int64, copy=False)), pa.array(np.full(len(a), long))], names=["a", "b", "long"])


def hamming_components(fps: DataFrame, radius: int = 2, limit: int = 20_000) -> DataFrame:
    """(node, root) over different fingerprints ``f`` linked at ``radius`` bits or fewer; those without links are left out.

    Keys of over ``limit`` fingerprints link exactly through shared neighbours at one bit, which needs radius 2.
    """
    if radius != 2:
        raise ValueError("long keys need radius 2")
    spark = fps.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    edge = [64 * i // (radius + 1) for i in range(radius + 2)]
    bits = max(0, math.ceil(math.log2(max(fps.count(), 1) / GROUP)))
    keys = [F.xxhash64(F.lit(i), F.shiftrightunsigned("f", at).bitwiseAND((1 << min(bits, upto - at)) - 1)) for i, (at, upto) in enumerate(zip(edge, edge[1:], strict=False))]
    found = saved(_link_keys(fps.select(F.explode(F.array(*keys)).alias("k"), "f"), radius, limit), "links")
    hot = found.where("long").select(F.col("a").alias("f")).distinct()
    near = hot.select("f", F.explode(F.concat(F.array("f"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("f").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("c"))
    least = near.groupBy("c").agg(F.min("f").alias("b"), F.count("*").alias("n")).where("n > 1")
    linked = near.join(least, "c").select(F.col("f").alias("a"), "b").where("a <> b")
    return components(found.where("not long").select("a", "b").union(linked))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the least id reachable over links, for every row.

    A null or empty text has fingerprint zero and links like any other. Repeated rows and ids each keep a row. A null id
    never becomes a component id unless all ids of the component are null. An empty table gives an empty result.
    """
    fps = saved(fingerprints(docs, [id_col], width, 1, text).withColumnsRenamed({id_col: "id", "f0": "f"}), "fingerprints")
    each = saved(fps.groupBy("f").agg(F.min("id").alias("least")), "distinct")
    roots = hamming_components(each.select("f"), radius)
    named = each.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(best, "root").select("f", "component_id")
    return fps.join(label, "f").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


# --- similarity of shingle sets, for corpora -------------------------------------------------------------------------

WORDS64 = 4


def _flip(similarity: float) -> float:
    """Chance that a bit differs between sets of equal size at this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float, recall: float = 0.99) -> tuple[int, int]:
    """Bits of a key and number of keys: keys grow with log n, so that a key holds some 32 unrelated texts."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 5)
    p = (1 - _flip(similarity)) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


#: Distinct shingles up to which a text has keys of its shingles too, since fingerprints of few shingles differ by chance.
FEW = 50
#: Texts of a key that are compared at once.
WINDOW = 4096
NAMES = [f"f{i}" for i in range(WORDS64)]


def chosen_bits(n: int, similarity: float) -> list[list[int]]:
    """The fingerprint bits that make the key of each table."""
    bits, tables = plan(n, similarity)
    rng = np.random.Generator(np.random.PCG64(7))
    return [rng.choice(64 * WORDS64, bits, replace=False).tolist() for _ in range(tables)]


def met_before(x: np.ndarray, table: int, masks: np.ndarray) -> np.ndarray:
    """Whether texts that differ by ``x`` (words, pairs) share a key of an earlier table too."""
    before = np.zeros(x.shape[1], bool)
    for mask in masks[: max(table, 0)]:
        before |= ~np.any(x & mask[:, None], axis=0)
    return before


def keyed_texts(fps: DataFrame, similarity: float, n: int) -> DataFrame:
    """(k, t, most, r, id, label, z, f0 ..): a row for each key of each text of ``fps``; ``t`` is its table, -1 for shingles,
    ``most`` the distance at which two texts of the key are candidates, ``r`` a Gray rank that orders the key.

    Every table has a key of randomly chosen bits. A text of FEW shingles or less has its least shingles as keys too: two
    texts at ``similarity`` share one of them.
    """
    total = 64 * WORDS64
    mean = total * _flip(similarity)
    most = int(mean + 3 * math.sqrt(mean * (1 - mean / total)))
    chosen = chosen_bits(n, similarity)

    def key(t: int, at: list[int]):
        value = None
        for j, x in enumerate(at):
            bit = F.shiftleft(F.shiftrightunsigned(NAMES[x // 64], x % 64).bitwiseAND(1), j)
            value = bit if value is None else value.bitwiseOR(bit)
        return F.struct(F.lit(t).alias("t"), value.cast("long").alias("k"), F.lit(most).alias("most"))

    few = F.transform("p", lambda h: F.struct(F.lit(-1).alias("t"), h.alias("k"), F.lit(int(0.3 * total)).alias("most")))
    rows = fps.select("id", "label", "z", *NAMES, F.explode(F.concat(F.array(*(key(t, c) for t, c in enumerate(chosen))), few)).alias("x"))
    t = F.greatest(F.col("x.t"), F.lit(0))
    word, turn = F.element_at(F.array(*NAMES), t % WORDS64 + 1), F.floor(t / WORDS64).cast("int") % 4 * 16
    rows = rows.withColumn("r", F.call_function("shiftleft", word, turn).bitwiseOR(F.call_function("shiftrightunsigned", word, 64 - turn)))
    for b in (1, 2, 4, 8, 16, 32):
        rows = rows.withColumn("r", F.col("r").bitwiseXOR(F.shiftrightunsigned("r", b)))
    return rows.select(F.xxhash64("x.t", "x.k").alias("k"), F.col("x.t").alias("t"), F.col("x.most").alias("most"), "r", "id", "label", "z", *NAMES)


def _nearest(f, ids, label, most: int, each: int):
    """(a, b) batches: for each text the ``each`` nearest texts of another label at ``most`` bits or fewer, and b null for a
    text that has more."""
    for s in range(0, len(ids), 128):
        far = np.zeros((min(128, len(ids) - s), len(ids)), np.uint16)
        for v in f:
            far += np.bitwise_count(v[s : s + 128, None] ^ v[None, :])
        far[label[s : s + 128, None] == label[None, :]] = 999
        count = (far <= most).sum(axis=1)
        i = np.flatnonzero(count)
        if not len(i):
            continue
        more = ids[s + i[count[i] > each]]
        if each < len(ids):
            j = np.argpartition(far[i], each - 1, axis=1)[:, :each]
            i, j = np.repeat(i, each), j.ravel()
            ok = far[i, j] <= most
            i, j = i[ok], j[ok]
        else:
            i, j = np.nonzero(far <= most)
        a, b = ids[s + i], ids[j]
        yield _pairs(np.concatenate([np.minimum(a, b), more]), np.concatenate([np.maximum(a, b), more]), len(a))


def _pairs(a, b, n: int) -> pa.RecordBatch:
    """(a, b) rows; b is null from row ``n`` on."""
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(b)) >= n)], names=["a", "b"])


def _parts(t: pa.Table):
    return np.stack([t.column(f"f{i}").to_numpy() for i in range(WORDS64)]).view(np.uint64), t.column("id").to_numpy(), t.column("label").to_numpy()


def first_candidates(keyed: DataFrame, each: int, window: int) -> DataFrame:
    """(a, b): for every text and key the ``each`` nearest candidates of another label; b is null once for a text that has
    more of them in some key.

    A key of over ``window`` texts is taken in Gray order, in windows that overlap by half; all its texts count as having
    more candidates. Rows are ordered in full, so that reruns agree.
    """
    keyed.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")

    def run(batches):
        held = None
        for t, long in runs_of(batches, ["k"], window):
            k, most = t.column("k")[0].as_py(), t.column("most")[0].as_py()
            f, ids, label = _parts(t)
            if long:
                yield _pairs(ids, ids, 0)
            if held is not None and held[3] == k:
                f, ids, label = np.concatenate([held[0], f], axis=1), np.concatenate([held[1], ids]), np.concatenate([held[2], label])
            held = (f[:, -window // 2 :], ids[-window // 2 :], label[-window // 2 :], k) if long else None
            if len(ids) > 1:
                yield from _nearest(f, ids, label, most, each)

    return keyed.repartition("k").sortWithinPartitions("k", "r", *NAMES, "id").mapInArrow(run, "a long, b long").distinct()


def open_pairs(f, label, z, most: int, similarity: float, before, cut: int | None = None):
    """(i, j) positions, in pieces: texts of different labels at ``most`` bits or fewer whose numbers of shingles allow the
    similarity and for which ``before`` does not hold; i < j, or with ``cut`` i before and j from that position on."""
    end, z = len(label) if cut is None else cut, z + 0.0
    for s in range(0, end, 128):
        e, lo = min(s + 128, end), s if cut is None else cut
        far = np.zeros((e - s, len(label) - lo), np.uint16)
        for v in f:
            far += np.bitwise_count(v[s:e, None] ^ v[None, lo:])
        near = (far <= most) & (label[s:e, None] != label[None, lo:])
        near &= np.minimum(z[s:e, None], z[None, lo:]) + 1 >= similarity * np.maximum(z[s:e, None], z[None, lo:])
        i, j = np.nonzero(near)
        i, j = i + s, j + lo
        ok = ~before(f[:, i] ^ f[:, j])
        if cut is None:
            ok &= i < j
        if ok.any():
            yield i[ok], j[ok]


def _unit_pairs(t: pa.Table, similarity: float, masks: np.ndarray):
    """``open_pairs`` of one meeting: the texts of a key, or those of two of its blocks."""
    f, _, label = _parts(t)
    side = t.column("side").to_numpy()
    before = functools.partial(met_before, table=t.column("t")[0].as_py(), masks=masks)
    apart = t.column("x")[0].as_py() != t.column("y")[0].as_py()
    return open_pairs(f, label, t.column("z").to_numpy(), t.column("most")[0].as_py(), similarity, before, int((side == 0).sum()) if apart else None)


UNIT = ["k", "x", "y"]
ROW = ["t", "most", "id", "label", "z", *NAMES]


def key_masks(chosen: list[list[int]]) -> np.ndarray:
    masks = np.zeros((len(chosen), WORDS64), np.uint64)
    for at, bits in enumerate(chosen):
        for x in bits:
            masks[at, x // 64] |= _U(1 << x % 64)
    return masks


def meetings(keyed: DataFrame, similarity: float, window: int, masks: np.ndarray) -> DataFrame:
    """(k, x, y, side, t, most, id, label, z, f0 ..): the texts that have an open pair where they meet, so a text has one row
    a meeting however many pairs it has there.

    The texts of a key meet at once. A key of over ``window`` texts, or of as much more text, is cut into blocks in the
    order of labels, and every two blocks x and y that do not hold one label alone meet in a task of their own; ``side``
    tells which of them a text is in. Two texts that share keys of several tables are a pair in the first of them only.
    """
    spark = keyed.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    schema = "k long, x int, y int, side int, t int, most int, id long, label long, z int, " + ", ".join(f"{c} long" for c in NAMES)
    names = [*UNIT, "side", *ROW]

    def rows(t: pa.Table, x: int, y: int | None, side: int):
        n = t.num_rows
        head = [t.column("k").combine_chunks(), pa.array(np.full(n, x, np.int32)), pa.nulls(n, pa.int32()) if y is None else pa.array(np.full(n, y, np.int32)), pa.array(np.full(n, side, np.int32))]
        return pa.RecordBatch.from_arrays([*head, *(t.column(c).combine_chunks() for c in ROW)], names=names)

    def opened(t: pa.Table):
        """The rows of a meeting that are in open pairs."""
        used = np.zeros(t.num_rows, bool)
        for i, j in _unit_pairs(t, similarity, masks):
            used[i] = used[j] = True
        if used.any():
            yield from t.filter(pa.array(used)).combine_chunks().to_batches()

    def within(batches):
        at, key = 0, None
        for t, long in runs_of(batches, ["k"], window):
            k = t.column("k")[0].as_py()
            at, key = at if k == key else 0, k
            block = np.cumsum(np.maximum(1, t.column("z").to_numpy() >> 9)) // (window + 1)
            if not long and block[-1] == 0:
                if t.num_rows > 1:
                    yield from opened(pa.Table.from_batches([rows(t, -1, -1, 0)]))
                continue
            cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), t.num_rows]
            for s, e in zip(cut, cut[1:], strict=False):
                yield rows(t.slice(s, e - s), at, None, 0)
                at += 1

    def between(batches):
        for t, _ in runs_of(batches, UNIT, 2 * window):
            yield from opened(t)

    found = saved(keyed.repartition("k").sortWithinPartitions("k", "label", "r", *NAMES, "id").mapInArrow(within, schema), "meetings")
    blocks = found.where("y is null").select("k", F.col("x").alias("block"), *ROW)
    labels = blocks.groupBy("k", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = (labels.select("k", *(F.col(c).alias(f"{side}{end}") for c, end in (("block", ""), ("lo", "lo"), ("hi", "hi")))) for side in "xy")
    meet = x.join(y, "k").where("x <= y and least(xlo, ylo) < greatest(xhi, yhi)").select("k", "x", "y")
    ends = meet.select("k", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    both = blocks.join(ends, ["k", "block"]).withColumn("side", (F.col("block") > F.col("x")).cast("int")).repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "id")
    return found.where("y is not null").unionByName(both.select(*names).mapInArrow(between, schema))


def meeting_links(met: DataFrame, sets: DataFrame, similarity: float, window: int, masks: np.ndarray) -> DataFrame:
    """(a, b): links between texts of ``met`` that reach the Jaccard similarity, as many as it takes to join the groups of
    each meeting. Refuted pairs never leave the task, and texts that a link has joined are not compared again in it."""

    def run(batches):
        for t, _ in runs_of(batches, UNIT, 2 * window):
            ids, sets = t.column("id").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("s")]
            size = np.array([len(x) for x in sets])
            group = np.unique(t.column("label").to_numpy(), return_inverse=True)[1]
            a, b = [], []
            for i, j in _unit_pairs(t, similarity, masks):
                cut = [0, *(np.flatnonzero(np.diff(i)) + 1).tolist(), len(i)]
                for s, e in zip(cut, cut[1:], strict=False):
                    one, others = int(i[s]), j[s:e]
                    others = others[group[others] != group[one]]
                    if not len(others):
                        continue
                    theirs, mine = np.concatenate([sets[x] for x in others]), sets[one]
                    shared = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs if len(mine) else np.zeros(len(theirs), bool)
                    common = np.bincount(np.repeat(np.arange(len(others)), size[others]), weights=shared, minlength=len(others))
                    for x in others[common >= similarity * (size[one] + size[others] - common)].tolist():
                        if group[x] != group[one]:
                            group[group == group[x]] = group[one]
                            a.append(ids[one])
                            b.append(ids[x])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    small_batches(met.sparkSession)
    return met.join(sets, "id").repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "id").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, s): sorted 32-bit shingle hashes of each text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = [np.unique(shingle_hashes(x.as_py(), width).astype(np.uint32)).tobytes() for x in b.column("raw")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.binary())], names=["id", "s"])

    return docs.mapInArrow(run, "id long, s binary")


def _judge(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, alike): whether the shingle sets of each pair reach the Jaccard similarity."""
    left = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            alike = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                common = len(np.intersect1d(p, q, assume_unique=True))
                alike.append(common >= similarity * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(alike, pa.bool_())], names=["a", "b", "alike"])

    small_batches(pairs.sparkSession)
    return both.mapInArrow(run, "a long, b long, alike boolean")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, h, root): a text's hash and its group, for every row; groups join texts at ``similarity`` or more.

    Equal texts are one member. SimHash finds likely pairs (recall 0.99 at the similarity itself, more above it), the
    Jaccard similarity of the sets of shingles decides. A first round judges the nearest candidate of each text and key.
    Texts with further candidates go on with all of them, across the groups found so far, in the tasks where their keys
    meet: a text's set goes there once, and only links come back, so that pairs that fail cost no row. No link is dropped
    because a nearer one was tried, and none because its key is long. ``window`` texts of a key are compared at once; it
    changes no group. Texts without words (null, empty) form one group. An empty table gives an empty result.
    """
    hashed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("id"), F.col(text).alias("text"))
    fps = saved(fingerprints(hashed, ["doc", "id"], width, WORDS64, distinct=True, few=similarity), "fingerprints")
    texts = saved(fps.groupBy("id").agg(*(F.min(k).alias(k) for k in NAMES), F.min("z").alias("z"), F.first("p").alias("p")), "texts")
    n = texts.count()
    found = saved(first_candidates(keyed_texts(texts.withColumn("label", F.col("id")), similarity, n), 1, window), "candidates")
    pairs, more = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("id"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(more).distinct()
    sets = saved(_sets(hashed.select("id", text_bytes("text").alias("raw")).join(ends, "id", "left_semi").dropDuplicates(["id"]), width), "sets")
    links = saved(_judge(pairs, sets, similarity).where("alike").select("a", "b"), "links")
    roots = saved(components(links), "roots")
    tidy(docs.sparkSession)
    if not more.isEmpty():
        left = texts.join(more, "id", "left_semi").join(roots.withColumnsRenamed({"node": "id", "root": "label"}), "id", "left").withColumn("label", F.coalesce("label", "id"))
        masks = key_masks(chosen_bits(n, similarity))
        met = saved(meetings(keyed_texts(left, similarity, n), similarity, window, masks), "met")
        further = saved(meeting_links(met, sets, similarity, window, masks), "further")
        if not further.isEmpty():
            roots = saved(components(links.union(further)), "roots")
        tidy(docs.sparkSession)
    roots = roots.withColumnRenamed("node", "id")
    return fps.select(F.col("doc").alias(id_col), "id").join(roots, "id", "left").select(id_col, F.col("id").alias("h"), F.coalesce("root", "id").alias("root"))


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the least id stays (a null id last)."""
    groups = saved(near_duplicates(docs, width, similarity, id_col, text), "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("h"))).alias("m")).select(F.col("m.i").alias("i"), F.col("m.h").alias("h")).select(F.struct("i", "h").alias("best"))
    k = fresh(docs, "k")
    out = docs.withColumn(k, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    out = out.join(best, out[k].eqNullSafe(best["best.h"]) & out[id_col].eqNullSafe(best["best.i"]), "left_semi")
    repeats = groups.groupBy(id_col, "h").count().where("count > 1").limit(1).count()
    return (out.dropDuplicates([id_col, k]) if repeats else out).select(*docs.columns)

"""A prefix trie of conversations in shards of lexicographic order.

Sequences of turn labels are sorted over range partitions, so a partition holds a run of the whole trie. There numpy
builds a level-order trie: a LOUDS bitvector (a one for every child, a zero after them), labels in the same order, and
rollups that go up level by level. Only nodes on the paths of a partition's first and last sequence can stand in
other partitions as well; these heavy upper levels are merged by their digests, and their rollups by doubling distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propagon.llm.common import saved

LABEL = 16
NOTHING = hashlib.sha256(b"").hexdigest()
#: Bytes of labels a shard, and ids that a row of a split list holds.
SHARD_BYTES, LIST_IDS = 32 << 20, 8192
MOST_SHARDS = 100_000


def label_of(role: Column, text: Column) -> Column:
    """Sixteen bytes that stand for a turn."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, LABEL)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns: structs (label, points) of every conversation by turn, null first.

    Turns of one number are ordered by their label, so that reruns agree; repeated rows are turns of their own. A null role
    or text is empty. Rows without conv_id belong to no conversation. Texts do not travel: a turn is 28 bytes, and the
    turns of one conversation make one row.
    """
    role, text = (F.coalesce(F.col(k), F.lit("")) for k in ("role", "text"))
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn"), label_of(role, text).alias("label"), F.length(text).cast("int").alias("points")).alias("t"))
    return t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["label"].alias("label"), x["points"].alias("points"))).alias("turns"))


def rebuilt(seqs: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Conversation c with the first h turns of conversation c - c % span before its own turns after its first h, where h is
    crc32 of its decimal id modulo ``most``. A base that is absent gives none; sequences may become empty."""
    own = saved(seqs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")), "sequences")
    base = own.where(F.col("conv_id") % span == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    # a base meets ``span`` conversations at most
    x = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % span).join(base, "base", "left")
    none = F.array().cast(seqs.schema["turns"].dataType)
    return x.select("conv_id", F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


class Louds:
    """Level-order trie of sorted distinct sequences of labels, numpy arrays only.

    ``node[i]`` is the end of sequence i, ``level`` the first node of each level. Child and parent are found in the bits.
    """

    def __init__(self, keys: list[bytes], points: list[np.ndarray]):
        size = np.array([len(k) // LABEL for k in keys], np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(keys), f"V{LABEL}")
        pts = np.concatenate([np.asarray(p, np.int64) for p in points]) if keys else np.zeros(0, np.int64)
        self.node = np.zeros(len(keys), np.int64)
        at = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        labels, lasts, firsts, counts = [np.zeros(1, flat.dtype)], [np.zeros(1, np.int64)], [np.zeros(min(1, len(keys)), np.int64)], []
        self.level, total, depth = [0, 1], 1, 0
        while True:
            live = live[size[live] > depth]
            if not len(live):
                break
            here, where = flat[start[live] + depth], at[live]
            new = np.ones(len(live), bool)
            new[1:] = (where[1:] != where[:-1]) | (here[1:] != here[:-1])
            counts.append(np.bincount(where[new] - self.level[-2], minlength=self.level[-1] - self.level[-2]))
            at[live] = total + np.cumsum(new) - 1
            labels.append(here[new])
            lasts.append(pts[start[live][new] + depth])
            firsts.append(live[new])
            total += int(new.sum())
            self.level.append(total)
            depth += 1
        counts.append(np.zeros(self.level[-1] - self.level[-2], np.int64))
        self.node = at
        self.labels, self.points, self.first = np.concatenate(labels), np.concatenate(lasts), np.concatenate(firsts)
        self.children = np.concatenate(counts)
        self.bits = np.ones(int(self.children.sum()) + total, bool)
        self.bits[np.cumsum(self.children + 1) - 1] = False
        ones = np.flatnonzero(self.bits)
        # the parent of a node is the number of zeros before its one; the root has none
        self.parent = np.concatenate([[-1], ones - np.arange(len(ones))])
        self.zeros = np.flatnonzero(~self.bits)

    def __len__(self) -> int:
        return len(self.parent)

    def child(self, node: int, label: bytes) -> int | None:
        """The child with that label, by the bits of the node."""
        first = 1 + (int(self.zeros[node - 1]) + 1 - node if node else 0)
        last = 1 + int(self.zeros[node]) - node
        found = np.flatnonzero(self.labels[first:last] == np.void(label))
        return first + int(found[0]) if len(found) else None

    def up(self, values: np.ndarray, join=np.add) -> np.ndarray:
        """Each node's value joined with those of its subtree, from the deepest level up."""
        out = values.copy()
        for lo, hi in reversed(list(zip(self.level[1:], self.level[2:], strict=False))):
            join.at(out, self.parent[lo:hi], out[lo:hi])
        return out


def _runs(batches):
    """Distinct keys of a sorted partition with the points of each and its ids."""
    keys, points, ids = [], [], []
    for b in batches:
        for k, p, i in zip(b.column("key").to_pylist(), b.column("points"), b.column("conv_id").to_pylist(), strict=True):
            if not keys or keys[-1] != k:
                keys.append(k)
                points.append(p.values.to_numpy())
                ids.append([])
            ids[-1].append(i)
    return keys, points, ids


NODE = "shard int, kind string, digest binary, parent_digest binary, depth long, conv_id long, parent_conv_id long, parent_node long, node long, last_points long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, first_end long, louds binary, labels binary"
_NAMES = [c.split()[0] for c in NODE.split(", ")]
_TYPES = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in NODE.split(", ")])


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], f.type) if k in columns else pa.nulls(n, f.type) for k, f in zip(_NAMES, _SCHEMA, strict=True)], schema=_SCHEMA)


def _shard(batches):
    keys, points, ids = _runs(batches)
    if not keys:
        return
    shard = TaskContext.get().partitionId()
    t = Louds(keys, points)
    n = len(t)
    depth = np.repeat(np.arange(len(t.level) - 1), np.diff(t.level))
    own, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    own[t.node] = [len(i) for i in ids]
    least[t.node] = [min(i) for i in ids]
    members, least = t.up(own), t.up(least, np.minimum)
    edge = np.zeros(n, bool)
    for i in (0, len(keys) - 1):
        v = int(t.node[i])
        while v >= 0:
            edge[v] = True
            v = int(t.parent[v])
    inside = ~edge
    # an edge node's children inside count here, its children on an edge once they are merged
    kids = np.bincount(t.parent[1:][inside[1:]], minlength=n)
    leaves = t.up(((t.children == 0) & inside).astype(np.int64))
    saved_points = t.up(np.where(inside, (members - 1) * t.points, 0))
    # what hangs below another edge node is counted there
    lower = np.flatnonzero(edge)[1:]
    for x in (leaves, saved_points):
        whole = x[lower]
        np.subtract.at(x, t.parent[lower], whole)
    at_end = {int(v): i for i, v in enumerate(t.node)}
    for lo in range(0, n, 10_000):
        x = np.arange(lo, min(n, lo + 10_000))
        x = x[inside[x]]
        ends = [hashlib.sha256(",".join(map(str, sorted(ids[at_end[v]]))).encode()).hexdigest() if v in at_end else NOTHING for v in x.tolist()]
        up = t.parent[x]
        yield _rows(len(x), shard=np.full(len(x), shard), kind=["inside"] * len(x), depth=depth[x], conv_id=least[x], parent_conv_id=pa.array(least[up], mask=edge[up]), parent_node=up, n_convs=members[x], n_children=t.children[x], n_leaves=leaves[x], saved_tokens=saved_points[x], ends=ends)
    for v in np.flatnonzero(edge).tolist():
        d, key = int(depth[v]), keys[int(t.first[v])]
        digest, above = (hashlib.sha256(key[: LABEL * i]).digest() if i >= 0 else None for i in (d, d - 1))
        yield _rows(1, shard=[shard], kind=["edge"], digest=[digest], parent_digest=[above], depth=[d], conv_id=[least[v]], node=[v], last_points=[t.points[v]], n_convs=[members[v]], n_children=[kids[v]], n_leaves=[leaves[v]], saved_tokens=[saved_points[v]])
        if v in at_end:
            mine = sorted(ids[at_end[v]])
            for i in range(0, len(mine), LIST_IDS):
                yield _rows(1, shard=[shard], kind=["ends"], digest=[digest], first_end=[mine[i]], ends=[",".join(map(str, mine[i : i + LIST_IDS]))])
    yield _rows(1, shard=[shard], kind=["trie"], node=[n], louds=[np.packbits(t.bits).tobytes()], labels=[t.labels.tobytes()])


def trie(seqs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of all shards: nodes that are whole there (``inside``), parts of those on an ``edge``, ids that end on an edge
    node (``ends``), and each shard's ``trie`` with its packed LOUDS bits and labels."""
    flat = saved(seqs.select("conv_id", F.aggregate("turns", F.lit(b""), lambda a, x: F.concat(a, x["label"])).alias("key"), F.transform("turns", lambda x: x["points"]).alias("points")), "sequences")
    size = flat.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    # copies of one sequence are told apart by their id, so any number of them is dealt evenly
    dealt = flat.repartitionByRange(min(MOST_SHARDS, size // shard_bytes + 1), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return saved(dealt.mapInArrow(_shard, NODE), "trie")


def _digests(batches):
    digest, sha = None, None
    for b in batches:
        for d, ends in zip(b.column("digest").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if d != digest:
                if digest is not None:
                    yield pa.RecordBatch.from_pydict({"digest": [digest], "ends_sha256": [sha.hexdigest()]})
                digest, sha = d, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ends.encode())
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"digest": [digest], "ends_sha256": [sha.hexdigest()]})


def merged(parts: DataFrame) -> DataFrame:
    """The edge nodes of all shards, each once: digest, depth, conv_id, parent's digest and the whole rollups.

    A subtree's sum over distances below 2k is the node's own below k and those of its descendants at distance k; so the
    number of rounds is the logarithm of the depth.
    """
    e = parts.where("kind = 'edge'").groupBy("digest").agg(F.first("parent_digest").alias("parent_digest"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("last_points").alias("last_points"), *(F.sum(k).alias(k) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    e = saved(e, "edges")
    kids = e.groupBy(F.col("parent_digest").alias("digest")).agg(F.count("*").alias("k"))
    e = e.join(kids, "digest", "left").withColumn("n_children", F.col("n_children") + F.coalesce("k", F.lit(0))).drop("k")
    own = e.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("last_points"))
    own = saved(own.withColumn("above", F.col("parent_digest")), "edges")
    deepest, step = own.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        below = own.where("above is not null").groupBy(F.col("above").alias("digest")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        further = own.select(F.col("digest").alias("above"), F.col("above").alias("next"))
        own = own.join(below, "digest", "left").join(further, "above", "left")
        own = own.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("l", F.lit(0))).withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("s", F.lit(0))).withColumn("above", F.col("next")).drop("l", "s", "next")
        own = saved(own, "edges")
        step *= 2
    return own.drop("above", "last_points")


def rollups(seqs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every node of the trie of ``sequences``: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. No conversation gives no node, an empty one ends at the root."""
    parts = trie(seqs, shard_bytes)
    top = merged(parts)
    ends = parts.where("kind = 'ends'").select("digest", "first_end", "ends").repartition("digest").sortWithinPartitions("digest", "first_end").mapInArrow(_digests, "digest binary, ends_sha256 string")
    above = top.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = top.join(above, "parent_digest", "left").join(ends, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(out)
    # a node below an edge finds its parent by shard and place, so the root's children are no hot key
    known = parts.where("kind = 'edge'").select("shard", F.col("node").alias("parent_node"), "digest").join(top.select("digest", F.col("conv_id").alias("edge_conv_id")), "digest").drop("digest")
    lower = parts.where("kind = 'inside'").join(known, ["shard", "parent_node"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "edge_conv_id")).withColumnRenamed("ends", "ends_sha256").select(out)
    return lower.unionByName(upper)

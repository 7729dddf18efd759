"""Training-order materialisation of token ids in fixed-stride binary shards.

The tokens of the texts of an input partition, each text followed by an end id, form a stream that is cut into sequences of
``length`` ids; the last one is filled up. A keyed Feistel permutation, walked on from places outside, orders all sequences:
it permutes 0 .. bound - 1, where every partition owns as many numbers as its bytes can make sequences at most, so a
sequence knows its place once it is made, and texts are tokenised once. Ranges of places are shards: files of records of one
width. A sequence's global slot is its rank; the manifest has the first slot of every shard, so that slot s is record
s - first_slot of its shard and a reader starts or resumes anywhere.

The input must give the same rows in the same partitions twice (files, not a shuffle): once to count bytes, once to tokenise;
a checksum proves it. Sequences are dealt to ranges by the number of the range itself, so that no two ranges meet in a task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propagon.llm.common import mix, new_path, saved, small_batches, text_bytes

LENGTH = 1024
SHARD_SEQUENCES = 4096
END_ID = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are encoded at once.
PART = 1 << 20
#: Bytes of text that a token is taken to hold when ranges are laid out; shards have fewer sequences where it holds more.
TOKEN_BYTES = 2.5
#: Ranges of shards at most; beyond it a range holds several shards, one after another.
MAX_RANGES = 100_000
_U = np.uint64


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return f"/opt/tokenizers/{name}"


@cache
def id_bytes(path: str) -> int:
    """Bytes of one id. The driver needs no more of the vocabulary, so it never builds an encoder."""
    with open(path, "rb") as lines:
        return 2 if max(int(x.split()[1]) for x in lines) + 1 < 1 << 16 else 4


class Encoder:
    """Byte-level BPE ids of texts. A long text is encoded in parts, cut where a single space begins a word, since the
    pattern always begins a piece there."""

    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.bpe = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype(f"<u{id_bytes(path)}")

    def encode(self, text: str) -> bytes:
        return b"".join(np.array(self.bpe.encode_ordinary(part), self.dtype).tobytes() for part in parts(text))


_WORD_START = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str, size: int = PART):
    """The text in parts of about ``size`` characters."""
    at = 0
    while at < len(text):
        cut = _WORD_START.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of each index under a keyed permutation of 0 .. n - 1: four Feistel rounds over the next even power of two,
    walked on from places of n or more until one is below."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = _U((1 << half) - 1)
    rounds = mix(np.arange(1, 5, dtype=np.uint64) + _U(key & (1 << 63) - 1) * _U(8))

    def permuted(x):
        a, b = x >> _U(half), x & low
        for k in rounds:
            a, b = b, a ^ (mix(b ^ k) & low)
        return a << _U(half) | b

    x = permuted(index.astype(np.uint64))
    while (over := x >= n).any():
        x[over] = permuted(x[over])
    return x.astype(np.int64)


def _checks(column, check: int) -> int:
    for x in column:
        raw = x.as_buffer() if x.is_valid else b""
        check = zlib.crc32(raw, zlib.crc32(len(raw).to_bytes(8, "little"), check))
    return check


def write_shards(docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: int = 0, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Writes the shards and returns their manifest: shard, first_slot, sequences, tokens, record_bytes, sha256, path.

    A null or empty text is its end id alone. The last sequence of an input partition is filled up with end ids, which
    ``tokens`` leaves out. A shard has about ``shard_sequences`` sequences; no texts give no shards. Repeated rows are
    written as often as they come. A shard is written under a name of its own attempt and renamed, so a lost task leaves
    nothing half done.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(text_bytes(text).alias("text"))
    width = id_bytes(tokenizer)

    def count(batches):
        size, rows, check = 0, 0, 0
        for b in batches:
            rows += b.num_rows
            check = _checks(b.column("text"), check)
            size += sum(len(x.as_buffer()) for x in b.column("text"))
        if rows:
            # a token is a byte at least
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (TaskContext.get().partitionId(), -(-(size + rows) // length), check, size + rows)], names=["part", "most", "crc", "size"])

    seen = sorted(tuple(r) for r in texts.mapInArrow(count, "part long, most long, crc long, size long").collect())  # one row a partition
    most = np.array([r[1] for r in seen], np.int64)
    bound = int(most.sum())
    # three numbers a partition, fetched once by each worker
    owned = spark.sparkContext.broadcast((np.array([r[0] for r in seen], np.int64), np.cumsum(most) - most, np.array([r[2] for r in seen], np.int64)))
    # sequences are about a third of the bound, so a range of the bound is wider than its shard
    span = max(1, round(shard_sequences * TOKEN_BYTES))
    ranges = max(1, -(-bound // span))

    def cut(batches):
        part, first, checks = owned.value
        i = int(np.searchsorted(part, TaskContext.get().partitionId()))
        number, check = (int(first[i]) if i < len(part) else 0), 0
        end = np.array([end_id], f"<u{width}").tobytes()
        step = length * width
        held, size, any_rows = [], 0, False

        def rows(final: bool):
            nonlocal held, size, number
            data = b"".join(held)
            n = -(-len(data) // step) if final else len(data) // step
            if n:
                place = slots(np.arange(number, number + n), bound, key)
                real = np.minimum(step, len(data) - np.arange(n) * step) // width
                ids = [data[j * step : (j + 1) * step] for j in range(n)]
                ids[-1] += end * ((step - len(ids[-1])) // width)
                yield pa.RecordBatch.from_arrays([pa.array(place // span), pa.array(place), pa.array(real), pa.array(ids, pa.binary())], names=["shard", "place", "real", "ids"])
            held = [data[n * step :]]
            size, number = len(held[0]), number + n

        e = encoder(tokenizer)
        for b in batches:
            any_rows |= b.num_rows > 0
            check = _checks(b.column("text"), check)
            for x in b.column("text"):
                ids = e.encode(x.as_buffer().to_pybytes().decode()) + end
                held.append(ids)
                size += len(ids)
            if size >= 256 * step:
                yield from rows(False)
        if any_rows and (i >= len(part) or part[i] != TaskContext.get().partitionId() or check != checks[i]):
            raise RuntimeError("the input gave other rows the second time; write it to files first")
        if size:
            yield from rows(True)

    sequences = texts.mapInArrow(cut, "shard long, place long, real long, ids binary")

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, out, sha, n, real = None, None, None, 0, 0

        def done():
            out.close()
            fs.move(f"{base}/.{shard:08d}.{attempt}", f"{base}/{shard:08d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (shard, n, real, length * width, sha.hexdigest(), f"{base}/{shard:08d}.bin")], names=["shard", "sequences", "tokens", "record_bytes", "sha256", "path"])

        for b in batches:
            for s, many, ids in zip(b.column("shard").to_pylist(), b.column("real").to_pylist(), b.column("ids"), strict=True):
                if s != shard:
                    if out is not None:
                        yield done()
                    shard, sha, n, real = s, hashlib.sha256(), 0, 0
                    out = fs.open_output_stream(f"{base}/.{s:08d}.{attempt}")
                data = ids.as_buffer()
                out.write(data)
                sha.update(data)
                n += 1
                real += many
        if out is not None:
            yield done()

    each = -(-ranges // MAX_RANGES)
    dealt = sequences.repartitionById(-(-ranges // each), F.expr(f"cast(shard div {each} as int)")).sortWithinPartitions("shard", "place")
    made = saved(dealt.mapInArrow(write, "shard long, sequences long, tokens long, record_bytes long, sha256 string, path string"), "shards")
    # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.select("shard", F.coalesce(F.sum("sequences").over(before), F.lit(0)).cast("long").alias("first_slot"), "sequences", "tokens", "record_bytes", "sha256", "path")


def read_records(path: str, first_slot: int, slot: int, count: int, length: int = LENGTH, dtype: str = "<u2") -> np.ndarray:
    """``count`` sequences of a shard from ``slot`` on, by offset."""
    step = length * np.dtype(dtype).itemsize
    with open(path, "rb") as f:
        f.seek((slot - first_slot) * step)
        return np.frombuffer(f.read(count * step), dtype).reshape(-1, length)


def shards(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """``write_shards`` into a new folder beside the checkpoints."""
    return write_shards(docs, new_path(docs.sparkSession, "shards"), tokenizer or tokenizer_path(), **options)

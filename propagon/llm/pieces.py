"""Encoding and decoding with the merge-type vocabularies of sentencepiece.

A text becomes symbols of one character; an agenda of adjacent pairs, ordered by the score of the piece they make and
then by place, merges them until no pair makes a piece. No pair is merged across two characters that stand side by side
in no piece, so a text is cut there and words that come again are looked up. Every Arrow batch can be encoded by the
library too, which gives the column ``agrees``.
"""

from __future__ import annotations

import codecs
import heapq
import re
from bisect import bisect_right
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from propagon.llm.common import BLOCK_BYTES, blocks, fresh, text_bytes

SPACE = "▁"
UNKNOWN = " ⁇ ".encode()
#: Words of more characters have a heap each; bytes of known words; words that are looked up together.
LANE, KEPT_BYTES, BLOCK_WORDS = 32, 60_000_000, 200_000
NO_RANK = (1 << 31) - 1
SLOT_BITS = 21
#: A place in a lane; entries of its agenda are ranks above these bits.
PLACES = 63

# as the library: every byte that starts no character is one replacement character
codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


class Vocabulary:
    """A model of type BPE with byte fallback and without normalisation rules, user-defined or unused pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        norm, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type vocabularies with byte fallback and no normalisation are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        # symbols are pieces and single characters; equal scores have one rank
        self.symbols = {x: i for i, x in enumerate([*self.ids, *sorted({c for p in self.ids for c in p} - set(self.ids))])}
        self.strings = list(self.symbols)
        place = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for p, i in self.symbols.items():
            for k in range(1, len(p)):
                left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if left is not None and right is not None:
                    self.rank[left << 32 | right] = place[scores[p]]
                    self.made[left << 32 | right] = i
        self.byte_ids = [-1] * 256
        self.shown: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.shown.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.shown.append(b"" if p.type == kinds.CONTROL else UNKNOWN if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode())
        self.spaced = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.control_ids = np.array(sorted(self.controls), np.int32)
        self.shown_pieces = pa.array(self.shown, pa.large_binary())
        self.pairs = {x for p in self.ids for x in zip(p, p[1:], strict=False)}
        inner = any(b == SPACE != a for a, b in self.pairs)
        # here every word starts with a space, so that a key without one stands for its word after one space
        self.bare = self.prefix == SPACE and not inner
        self.words = re.compile(".+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
        # the same ranks as sorted arrays; symbols above the table stand for characters of no piece
        self.keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()] + [NO_RANK], np.int32)
        self.results = np.array([self.made[k] for k in self.keys.tolist()] + [0], np.int32)
        self.agenda_of = np.append(self.ranks[:-1] * (PLACES + 1), NO_RANK - PLACES).astype(np.int32)
        # slots by hash hold the place of one key; places of the few others in a slot are searched
        slot = self._slot(self.keys)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[slot[::-1]] = np.arange(len(self.keys), dtype=np.int32)[::-1]
        self.shared = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + len(self.strings)
        # ids of symbols that are pieces, -1 for others
        self.id_of = np.array([self.ids.get(x, -1) for x in self.strings] + [-1], "<i4")
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.coded: dict[int, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.kept = 0

    def _coded(self, symbols: list[int]) -> bytes:
        """Ids of symbols, bytes for those that are no pieces; the ids of a symbol are made once."""
        for s in set(symbols).difference(self.coded):
            x = self.strings[s] if s < len(self.strings) else chr(s - len(self.strings))
            k = self.ids.get(x)
            self.coded[s] = np.array([k] if k is not None else [self.byte_ids[b] for b in x.encode()], "<i4").tobytes()
        return b"".join(map(self.coded.__getitem__, symbols))

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table, the last one for pairs that make no piece."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        at = self.slots[slot]
        hit = self.keys[at] == key
        other = np.nonzero(self.shared[slot] & ~hit)
        at[~hit] = len(self.keys)
        if len(other[0]):
            k = key[other]
            i = np.searchsorted(self.keys, k)
            i[i == len(self.keys)] = 0
            at[other] = np.where(self.keys[i] == k, i, len(self.keys))
        return at

    def _lanes(self, words: list[str]) -> list[bytes]:
        """Short words side by side as columns, each with its agenda of rank and place: in every round the best pair of each
        column goes, of equal ones the leftmost. A symbol knows the places of its neighbours, the last row is none."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        n, last, none = len(words), int(size.max()), self.agenda_of[-1]
        symbols = np.full((last + 1, n), -1, np.int32)
        starts = np.cumsum(size) - size
        symbols[np.arange(len(chars)) - np.repeat(starts, size), np.repeat(np.arange(n), size)] = chars
        place = np.arange(last + 1)
        agenda = np.full(symbols.shape, none, np.int32)
        agenda[:-1] = self.agenda_of[self._found(symbols[:-1], symbols[1:])] | place[:-1, None].astype(np.int32)
        after, before = (np.repeat(x[:, None], n, axis=1) for x in (place + 1, np.append(last, place[:-1])))
        out, places = symbols.copy(), np.arange(n)
        while True:
            best = agenda.min(axis=0)
            k = np.flatnonzero(best < none)
            if len(k) < 0.7 * n:
                out[:, places] = symbols
                if not len(k):
                    break
                symbols, agenda, after, before = (np.take(x, k, axis=1) for x in (symbols, agenda, after, before))
                places, best, n = places[k], best[k], len(k)
                k = np.arange(n)
            # places in the flat arrays: the pair, what follows it and what stands before it
            at = (best[k] & PLACES).astype(np.int64)
            left = at * n + k
            right = after.ravel()[left] * n + k
            new = self.results[self._found(symbols.ravel()[left], symbols.ravel()[right])]
            following = after.ravel()[right]
            symbols.ravel()[left] = new
            symbols.ravel()[right] = -1
            agenda.ravel()[right] = none
            after.ravel()[left] = following
            end = following * n + k
            before.ravel()[end] = at
            earlier = before.ravel()[left]
            start = earlier * n + k
            agenda.ravel()[left] = self.agenda_of[self._found(new, symbols.ravel()[end])] | at.astype(np.int32)
            agenda.ravel()[start] = self.agenda_of[self._found(symbols.ravel()[start], new)] | earlier.astype(np.int32)
        out = np.ascontiguousarray(out.T)
        real = out >= 0
        flat = out[real]
        ids = self.id_of[np.minimum(flat, len(self.strings))]
        data, ends = ids.tobytes(), np.cumsum(real.sum(axis=1))
        made = [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        # words with characters that are written as bytes
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), "right")).tolist():
            made[i] = self._coded(out[i][real[i]].tolist())
        return made

    def _heap(self, symbols: list[int]) -> list[int]:
        """A long run has a heap of rank and place; an entry holds while the pair at its place has its rank."""
        rank, made, n = self.rank, self.made, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if symbols[left] < 0 or right >= n or rank.get(pair := symbols[left] << 32 | symbols[right]) != entry >> 32:
                continue
            symbols[left], symbols[right] = made[pair], -1
            end = after[left] = after[right]
            if end < n:
                before[end] = left
            for a, b in ((before[left], left), (left, end)):
                if a >= 0 and b < n and (r := rank.get(symbols[a] << 32 | symbols[b])) is not None:
                    heapq.heappush(agenda, r << 32 | a)
        return [s for s in symbols if s >= 0]

    def _learn(self, words: set[str], before: str = "") -> None:
        """Ids of words that are not known yet, each with ``before``; long ones are cut where no piece has both characters side by side."""
        ordered = sorted(words, key=len)
        self.kept += sum(map(len, ordered)) + 100 * len(ordered)
        ends = [bisect_right(ordered, x, key=len) for x in range(-len(before), LANE + 4 - len(before), 4)]
        for key in ordered[ends[-1] :]:
            w = before + key
            cuts = [0, *(i for i in range(1, len(w)) if (w[i - 1], w[i]) not in self.pairs), len(w)]
            symbols = self.symbol_of[np.frombuffer(w.encode("utf-32-le"), "<u4")].tolist()
            self.known[key] = b"".join(self._coded(self._heap(symbols[i:j])) for i, j in zip(cuts, cuts[1:], strict=False))
        for group in filter(None, (ordered[i:j] for i, j in zip(ends, ends[1:], strict=False))):
            self.known.update(zip(group, self._lanes([before + w for w in group] if before else group), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text without begin and end ids; an empty text has none."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            nonlocal held, size
            known, wanted = self.known, set().union(*(words for _, words in held))
            new = wanted.difference(known)
            if self.kept > KEPT_BYTES:
                # words of this block stay
                kept = {w: known[w] for w in wanted - new}
                self.kept = sum(map(len, kept)) + 100 * len(kept)
                known.clear()
                known.update(kept)
            bare = {w for w in new if w[0] != SPACE} if self.bare else set()
            self._learn(bare, SPACE)
            self._learn(new - bare)
            for i, words in held:
                out[i].append(b"".join(map(known.__getitem__, words)))
            held, size = [], 0

        for i, text in enumerate(texts):
            if text:
                plain = text.decode("utf-8", "one_by_one")
                if self.bare and len(text) < BLOCK_BYTES and "  " not in plain and SPACE not in plain and " " not in (plain[0], plain[-1]):
                    found = iter(plain.split(" "))
                else:
                    marked = self.prefix + plain.replace(" ", SPACE)
                    found = iter(self.words.findall(marked)) if len(text) < BLOCK_BYTES else (m.group() for m in self.words.finditer(marked))
                while words := list(islice(found, BLOCK_WORDS)):
                    held.append((i, words))
                    size += len(words)
                    if size >= BLOCK_WORDS:
                        flush()
        flush()
        return [np.frombuffer(b"".join(x), "<i4") for x in out]

    def decode_all(self, texts: list[np.ndarray]) -> list[bytes]:
        """``decode`` of each; what the pieces show is put together for all texts at once."""
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        if not len(flat) or np.isin(flat, self.control_ids).any():
            return [self.decode(i.tolist()) for i in texts]
        shown = self.shown_pieces.take(pa.array(flat))
        data, starts = shown.buffers()[2].to_pybytes(), np.frombuffer(shown.buffers()[1], np.int64)
        ends = np.cumsum([0, *map(len, texts)])
        out = []
        for ids, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
            if a == b:
                out.append(b"")
                continue
            begin, end = int(starts[a]), int(starts[b])
            if self.prefix:
                # the first piece with an outcome loses its space
                first = int(np.searchsorted(starts[a + 1 : b + 1], begin, "right"))
                if first < len(ids) and int(ids[first]) in self.spaced:
                    begin += 1
            raw = data[begin:end]
            out.append(raw if _whole(raw) else raw.decode("utf-8", "one_by_one").encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, in UTF-8; bytes that make no character are replacement characters, the prefix goes."""
        shown = [self.shown[i] for i in ids]
        if self.prefix:
            # the first piece with an outcome loses its space; control pieces before it have none
            first = next((k for k, i in enumerate(ids) if self.shown[i]), None)
            if first is not None and ids[first] in self.spaced:
                shown[first] = shown[first][1:]
        if self.controls.isdisjoint(ids):
            return b"".join(shown).decode("utf-8", "one_by_one").encode()
        # bytes on both sides of a control piece make no character together
        cuts = [-1, *(k for k, i in enumerate(ids) if i in self.controls), len(ids)]
        return b"".join(b"".join(shown[i + 1 : j]).decode("utf-8", "one_by_one").encode() for i, j in zip(cuts, cuts[1:], strict=False))


def _whole(raw: bytes) -> bool:
    """Whether these bytes are characters."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mapped(docs: DataFrame, keys: list[str], read, names: list[str], value, schema: str) -> DataFrame:
    """``docs[keys]`` with the columns that ``value`` makes of blocks of the binary column that ``read`` gives."""
    if any(n.lower() in {k.lower() for k in keys} for n in names):
        raise ValueError(f"a kept column is named like one of {names}")
    data = fresh(docs, "data")
    rows = docs.select(*keys, read.alias(data))

    def run(batches):
        for b in batches:
            for at, end, buf, off in blocks(b.column(data)):
                raw = buf.tobytes()
                made = value([raw[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([b.column(k).slice(at, end - at) for k in keys] + made, names=keys + names)

    kept = docs.select(*keys).schema
    out = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [schema])
    return rows.mapInArrow(run, out)


def encode(docs: DataFrame, model: str, keys: list[str], text: str = "text", check: bool = True) -> DataFrame:
    """``docs[keys]`` with ``ids`` and ``decoded`` of every whole text and, with ``check``, ``agrees``: whether the
    library gives the same ids and text.

    A null text is empty and has no ids; equal texts have equal ids; repeated rows stay; an empty table gives no rows.
    Texts are cut nowhere: a text longer than a block is a block of its own. Rows do not depend on each other.
    """

    def value(texts):
        v = vocabulary(model)
        flat = v.encode(texts)
        shown = v.decode_all(flat)
        ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
        made = [pa.ListArray.from_arrays(ends, np.concatenate(flat)), pa.array(shown, pa.binary()).cast(pa.string())]
        if check:
            theirs = v.library.encode(texts, num_threads=1)
            back = v.library.decode(theirs, num_threads=1)
            made.append(pa.array([a.tolist() == b and s.decode() == t for a, b, s, t in zip(flat, theirs, shown, back, strict=True)], pa.bool_()))
        return made

    names = ["ids", "decoded"] + ["agrees"] * check
    return _mapped(docs, keys, text_bytes(text), names, value, "ids array<int>, decoded string" + ", agrees boolean" * check)


def decode(rows: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids; null ids and null elements count as none."""
    if decoded.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"a column is named {decoded}")
    names = rows.columns

    def run(batches):
        for b in batches:
            texts = [vocabulary(model).decode([i for i in r or [] if i is not None]).decode() for r in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, decoded])

    out = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{decoded}` string"])
    return rows.mapInArrow(run, out)

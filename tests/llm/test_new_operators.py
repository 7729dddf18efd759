"""Pieces, prefix tries and the filter audit against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F

from propagon.llm import filter_audit, pieces, prefix_trie, queries

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, name, size):
    assert differences(spark, queries.QUERIES[name], queries.SQL[name], f"/root/testdata/{size}") == ""


def made_up(rng, n):
    alphabet = ["a", "b", "th", "▁", " ", "  ", "\n", "\t", "é", "漢", "🙂", "\0", "<0x0A>", "<s>", "<unk>", "�", "ﬁ", "１", "the ", "ing", "한", "x" * 40, " " * 50]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_pieces_equal_the_library():
    v, rng = pieces.Vocabulary(MODEL), random.Random(1)
    texts = [t.encode() for t in made_up(rng, 4000)]
    for i in range(0, len(texts), 3):  # bytes that are no characters
        broken = bytearray(texts[i])
        for _ in range(rng.randrange(3)):
            broken.insert(rng.randrange(len(broken) + 1), rng.randrange(256))
        texts[i] = bytes(broken)
    ids = [x.tolist() for x in v.encode(texts)]
    assert ids == v.library.encode(texts)
    assert [v.decode(i).decode() for i in ids] == v.library.decode(ids)
    drawn = [[rng.choice([0, 1, 2, 3, 13, rng.randrange(259), rng.randrange(32000)]) for _ in range(rng.randrange(7))] for _ in range(4000)]
    assert [v.decode(i).decode() for i in drawn] == v.library.decode(drawn)


def test_heaps_and_lanes_agree():
    v, rng = pieces.Vocabulary(MODEL), random.Random(2)
    for w in ["▁" + "".join(rng.choice("etaoin shr".replace(" ", "")) for _ in range(rng.randrange(1, pieces.LANE))) for _ in range(500)]:
        symbols = v.symbol_of[np.frombuffer(w.encode("utf-32-le"), "<u4")].tolist()
        assert v._lanes([w]) == [v._coded(v._heap(symbols))]


def test_long_texts_and_a_full_memory(monkeypatch):
    v, rng = pieces.Vocabulary(MODEL), random.Random(3)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 2000)
    monkeypatch.setattr(pieces, "BLOCK_WORDS", 64)
    texts = ["abcdefg" * 20_000, " " * 70_000, "漢字" * 9_000, " ".join(made_up(rng, 3000)), "word " * 600_000]
    assert [x.tolist() for x in v.encode([t.encode() for t in texts])] == v.library.encode(texts)


def test_pieces_of_a_table(spark):
    texts = [*made_up(random.Random(4), 40), "same text", "same text", "", None]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, data string")
    got = pieces.encode(rows, MODEL, ["doc_id", "data"]).collect()
    v = pieces.vocabulary(MODEL)
    assert all(r.agrees and r.data == "x" for r in got) and len(got) == len(texts)
    assert {r.doc_id: (r.ids, r.decoded) for r in got} == {i: (v.library.encode(t or ""), v.library.decode(v.library.encode(t or ""))) for i, t in enumerate(texts)}
    back = pieces.decode(pieces.encode(rows, MODEL, ["doc_id"], check=False).drop("decoded"), MODEL)
    assert {r.doc_id: r.decoded for r in back.collect()} == {r.doc_id: r.decoded for r in got}
    assert pieces.encode(rows.limit(0), MODEL, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(rows.withColumnRenamed("data", "ids"), MODEL, ["doc_id", "ids"])


def trie_by_hand(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            label = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0), label, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def sums(p):
        below = [sums(k) for k in kids[p]]
        return sum(x[0] for x in below) + (not below), sum(x[1] for x in below) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)

    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids[p]), *sums(p), hashlib.sha256(",".join(map(str, sorted(c for c in m if made[c] == p))).encode()).hexdigest())
        for p, m in nodes.items()
    )


def conversations(rng, n, hot):
    """Few words, so that prefixes are shared; a third are copies of one."""
    rows = []
    for c in rng.sample(range(-150, 5 * n), n):
        if hot and rng.random() < 0.4:
            rows += [(c, t, "user", "hello") for t in range(7)]
            continue
        for t in range(rng.randrange(1, 12)):
            rows.append((c, rng.choice([None, t, t, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "cää", "", None, "x" * 50])))
    rows += [(None, 1, "user", "of none"), (7, 0, "user", "again"), (7, 0, "user", "again")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_bytes", [200, 3000, 1 << 25])
@pytest.mark.parametrize("hot", [False, True])
def test_tries_equal_a_walk(spark, shard_bytes, hot, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_IDS", 3)
    turns = conversations(random.Random(shard_bytes), 150, hot)
    df = spark.createDataFrame([(*t, "clash", i) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string, label string, depth long").repartition(5)
    got = prefix_trie.rollups(prefix_trie.rebuilt(prefix_trie.sequences(df)), shard_bytes).collect()
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == trie_by_hand(turns)


def test_a_deep_conversation_over_shards(spark):
    turns = [(c, t, "user", "abc"[: 1 + (t == c * 37)]) for c in range(1, 8) for t in range(300)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = prefix_trie.rollups(prefix_trie.rebuilt(prefix_trie.sequences(df)), 5000).collect()
    want = trie_by_hand_flat(turns)
    assert sorted((r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got) == want


def trie_by_hand_flat(turns):
    """As ``trie_by_hand`` without recursion."""
    own = defaultdict(list)
    for c, _, role, text in turns:
        own[c].append((role, text))
    made = {c: tuple(s[zlib.crc32(str(c).encode()) % 6 :]) for c, s in own.items()}
    nodes = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] += kids[p] == 0
        saved[p] += (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted((min(m), len(p), len(m), kids[p], leaves[p], saved[p]) for p, m in nodes.items())


def test_louds_bits_lead_to_children():
    words = sorted({bytes(random.Random(i).choice(b"abc") for _ in range(i % 5)) for i in range(60)})
    keys = [b"".join(bytes([c]) * prefix_trie.LABEL for c in w) for w in words]
    t = prefix_trie.Louds(keys, [np.arange(len(w)) for w in words])
    assert int((~t.bits).sum()) == len(t) == int(t.bits.sum()) + 1
    for w, end in zip(words, t.node.tolist(), strict=True):
        v = 0
        for c in w:
            v = t.child(v, bytes([c]) * prefix_trie.LABEL)
        assert v == end and t.child(v, b"z" * prefix_trie.LABEL) is None


def test_tries_of_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.rollups(prefix_trie.rebuilt(prefix_trie.sequences(empty))).count() == 0
    # conversation 3 has fewer turns than it takes from its absent base
    one = spark.createDataFrame([(3, 0, "user", "x")], empty.schema)
    h = zlib.crc32(b"3") % 6
    got = prefix_trie.rollups(prefix_trie.rebuilt(prefix_trie.sequences(one))).collect()
    assert [(r.conv_id, r.depth) for r in sorted(got, key=lambda r: r.depth)] == [(3, 0)] + [(3, 1)] * (h == 0)


def audit_by_hand(docs, labels):
    def fails(i, t):
        w = (t or "").encode().split()
        bad = {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t or "") > 2 * len(t or "") else set()
        bad |= {"D"} if set(t or "") & set("#$%&*|") else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in docs) else set()
        return bad

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = [(s or "", i, fails(i, t)) for i, t, s in docs]
    out, shapley = [], defaultdict(int)
    for part in {r[0] for r in rows}:
        mine = [(i, f) for s, i, f in rows if s == part]
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(alive), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
    return sorted((*x[:-1], shapley[x[0], x[-1]]) for x in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_every_order_walked(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", 64)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)] + ["Word", "UPPER", "a#b", "é"]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice([20, 150, 404])], k=rng.choice([3, 190, 260, 500]))) for _ in range(25)] + ["", None, " \n", "same", "w" * 900]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(140)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, source string, E string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.failures(d, lab)).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == audit_by_hand(docs, labels)


def test_audit_of_no_documents_and_of_states(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(filter_audit.failures(empty)).count() == 0
    rows = spark.createDataFrame([("p", True, False, True, False, False)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    seen = []
    filter_audit.walk(rows, "ABC", lambda state, left, survivors: seen.append((state, left, survivors.count())))
    assert sorted(x[0] for x in seen) == ["", "A", "AB", "AC", "B", "BC", "C"] and all(n == (x in ("", "B")) for x, _, n in seen)
    assert filter_audit.audit(rows, "ABC").where(F.col("removed") > 0).count() == 6


def test_texts_decoded_at_once_and_pairs_by_slot():
    """All texts of a block together as each alone and as the library, broken and missing characters included."""
    v, rng = pieces.Vocabulary(MODEL), random.Random(9)
    texts = ["", " ", "  a", "a  b \n", "▁x", "日本 \U0001f600 é\x00", *("".join(rng.choice("abc é日\U0001f600 \n▁") for _ in range(rng.randrange(60))) for _ in range(300))]
    made = v.encode([t.encode() for t in texts])
    cut = [i[: rng.randrange(len(i) + 1)] for i in made]  # may end inside a character
    broken = [i[rng.randrange(len(i) + 1) :] for i in made]
    for ids in (made, cut, broken, [*made, np.array([1, 5, 400, 2, 401], np.int32)], []):
        assert v.decode_all(ids) == [v.decode(i.tolist()) for i in ids] == [v.library.decode(i.tolist()).encode() for i in ids]
    left, right = (np.array([rng.randrange(len(v.strings)) for _ in range(20_000)], np.int32) for _ in range(2))
    left, right = np.append(left, (v.keys >> 32).astype(np.int32)), np.append(right, (v.keys & 0xFFFFFFFF).astype(np.int32))
    key = left.astype(np.int64) << 32 | right
    at = v._found(left, right)
    assert [v.rank.get(k, pieces.NO_RANK) for k in key.tolist()] == v.ranks[at].tolist() and v.shared.any()


def test_texts_split_at_spaces_and_words_that_stay(monkeypatch):
    """Plain texts are split at spaces, others by the expression; both give the library's ids. A full memory keeps the words of the block."""
    v, rng = pieces.Vocabulary(MODEL), random.Random(11)
    letters = "etaoinshr" * 4 + "éß漢😀▁-.\n\t"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 7, 12, 30, 31, 32, 33, 40]))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(150)]
    texts += ["  ".join(texts[:3]), " a", "a ", "a", " ", "  ", "▁a a", "a ▁a", "", "\na b\n", "x" * 31, "x" * 32, "x" * 33, "😀" * 31 + " " + "😀" * 32]
    rng.shuffle(texts)
    raw = [t.encode() for t in texts] + [b"\xff a\xfe b"]
    assert [x.tolist() for x in v.encode(raw)] == v.library.encode(raw, num_threads=1)
    assert v.bare and {w[0] == pieces.SPACE for w in v.known} == {True, False}
    learned, learn = [], v._learn
    monkeypatch.setattr(v, "_learn", lambda words, *before: learned.extend(words) or learn(words, *before))
    monkeypatch.setattr(pieces, "KEPT_BYTES", 0)
    v.encode([b"some words stay", b"Texts"])
    v.encode([b"some words stay", b"Others"])
    assert learned.count("stay") <= 1 and learned.count("Others") == 1 and "Texts" not in v.known

"""Corpus operators against brute force on small fixtures, with nulls, empty and repeated texts and empty tables."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from propagon.llm import decontamination, licences, mixing, ngram_lm, quality_lm, quality_rules, simhash, suffix_dedup, token_output, toxicity
from propagon.llm.common import components, nearest_rank

WORDS = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdeéß"), rng.integers(2, 6))) for _ in range(60)]
    made = [" ".join(rng.choice(vocabulary, rng.integers(1, 130))) for _ in range(60)]
    made += [made[0], made[0], made[1] + " end", made[2].replace(" ", "\n", 4), "A | b | c\nA | b | c", "", "  \t\n", None, None, "x" * 900, "word " * 200]
    return made


def test_fingerprints_and_components(spark, texts):
    got = simhash.simhash_groups(frame(spark, texts)).collect()

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fingerprint(t) for t in texts]
    label = list(range(len(f)))
    for _ in f:
        for i in range(len(f)):
            for j in range(len(f)):
                if (f[i] ^ f[j]).bit_count() <= 2:
                    label[i] = min(label[i], label[j])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f[i]:016x}", label[i]) for i in range(len(f))}


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    x = np.unique(base[rng.integers(0, 20, 800)] ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64)))
    got = {p for a, b in simhash.GrayIndex(x).within(x, 2) for p in zip(a.tolist(), b.tolist(), strict=True)}
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_long_keys_link_exactly(spark):
    rng = np.random.default_rng(2)
    x = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "f long")
    a, b = ({r.node: r.root for r in simhash.hamming_components(df, limit=n).collect()} for n in (10**6, 5))
    assert a == b


def test_one_of_each_group(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(30)]
    near = [b.rsplit(" ", 3)[0] + " other end here" for b in base[:10]]
    left = simhash.one_of_each(frame(spark, base + near + base[:5] + [None, ""]))
    assert sorted(r.doc_id for r in left.collect()) == [*range(30), 45]
    assert left.columns == frame(spark, base).columns


def test_long_keys_of_near_duplicates_lose_no_pair(spark):
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(4):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(60):
            t = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 4))):
                t[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(t))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    for window in (8, simhash.WINDOW):
        groups = {}
        for r in simhash.near_duplicates(frame(spark, texts), window=window).collect():
            groups.setdefault(r.root, []).append(r.doc_id)
        assert sorted(map(sorted, groups.values())) == sorted([i for i, x in enumerate(label) if x == y] for y in set(label))


def test_blocks_of_a_long_key_meet_once(spark):
    rng = np.random.default_rng(22)
    f = rng.integers(0, 1 << 62, 4) ^ (1 << rng.integers(0, 60, (50, 4)))
    rows = [(1 if i < 45 else 2, 0, 20, i, i, i % 7 if i < 30 else 3, 10, *map(int, f[i])) for i in range(50)]
    keyed = spark.createDataFrame(rows, "k long, t int, most int, r long, id long, label long, z int, f0 long, f1 long, f2 long, f3 long")
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if rows[i][0] == rows[j][0] and rows[i][5] != rows[j][5] and sum((int(x) ^ int(y)).bit_count() for x, y in zip(f[i], f[j])) <= 20}
    masks = simhash.key_masks([[0]])
    for window in (4, 8, 100):
        met, got = simhash.meetings(keyed, 0.8, window, masks).toArrow(), []
        units = met.group_by(simhash.UNIT).aggregate([]).to_pylist()
        for u in units:
            t = met.filter((pc.field("k") == u["k"]) & (pc.field("x") == u["x"]) & (pc.field("y") == u["y"])).sort_by([("side", "ascending"), ("id", "ascending")])
            ids = t.column("id").to_numpy()
            got += [tuple(sorted(p)) for i, j in simhash._unit_pairs(t, 0.8, masks) for p in zip(ids[i].tolist(), ids[j].tolist())]
        assert set(got) == want and want and len(got) == len(want)


def test_pairs_that_fail_leave_no_rows(spark):
    """A template whose texts are about 0.6 alike: rows grow with the texts, not with their pairs."""
    rng = np.random.default_rng(23)
    base, texts = [f"w{x}" for x in rng.integers(0, 5000, 200)], []
    for _ in range(400):
        t = list(base)
        for at in range(10, 200, 20):
            t[at] = f"e{rng.integers(0, 10**9)}"
        texts.append(" ".join(t))
    texts += [texts[0] + " end", texts[1] + " end"]
    docs = frame(spark, texts)
    groups = {}
    for r in simhash.near_duplicates(docs).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    assert sorted(x for x in map(sorted, groups.values()) if len(x) > 1) == [[0, 400], [1, 401]]
    fps = simhash.fingerprints(docs.selectExpr("doc_id as id", "text"), ["id"], 5, simhash.WORDS64, distinct=True, few=0.8)
    keyed = simhash.keyed_texts(fps.withColumn("label", F.col("id")), 0.8, len(texts))
    masks = simhash.key_masks(simhash.chosen_bits(len(texts), 0.8))
    met = simhash.meetings(keyed, 0.8, simhash.WINDOW, masks)
    assert met.count() <= len(masks) * len(texts)


def test_a_repeated_line_hides_no_near_copy(spark):
    rng = np.random.default_rng(14)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(20)]
    near = [b + (" " + " ".join(b.split()[50:60])) * 20 for b in base]
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, base + near)).collect()) == [*range(20)]


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10] + [(5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41) if i % 10 != 1}


def test_quality_measures(spark, texts):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = WORDS.findall(t)
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        c = Counter(tri)
        covered = {k for j, x in enumerate(tri) if c[x] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def brute_spans(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        yield len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,gram,grid", [(200, 64, 12), (50, 16, 5)])
def test_repeated_bytes(spark, texts, length, gram, grid):
    got = suffix_dedup.remove_repeats(frame(spark, texts), ["doc_id"], length=length, gram=gram, grid=grid).drop("kept").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == list(brute_spans([(t or "").encode() for t in texts], length))


def test_mixing(spark, texts):
    rows = mixing.mix_sources(frame(spark, texts)).collect()
    size = defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORDS.findall(texts[r.doc_id] or ""))
        size[r.source] += r["size"]
    names = sorted((k for k in size if k is not None)) + [None] * (None in size)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    want, free, budget = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = (budget - sum(want.values())) / sum(weight[k] for k in free)
        full = {k for k in free if weight[k] * level > 2 * size[k]}
        if not full:
            break
        want |= {k: 2.0 * size[k] for k in full}
        free -= full
    want |= {k: weight[k] * level for k in free}
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[k] - want[k]) <= 1 for k in names)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_sources(frame(spark, texts).repartition(3)).collect()), key=repr)


def test_token_shards_round_trip(spark, texts, tmp_path):
    e = token_output.Encoder(token_output.tokenizer_path())
    odd = ["a  b", "a   b", " \n  x", "\n \n x", " ", "it's ok \n\n\n z", "\t b ", "x \u3000 y"]
    whole = [np.array(e.bpe.encode_ordinary(t), "<u2").tobytes() for t in [x for x in texts if x] + odd]
    assert whole == [e.encode(t) for t in [x for x in texts if x] + odd]
    assert whole == [b"".join(e.encode(p) for p in token_output.parts(t, 7)) for t in [x for x in texts if x] + odd]
    docs = frame(spark, texts).repartition(3, "doc_id")
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    m = token_output.write_shards(docs, f"file://{tmp_path}/out", token_output.tokenizer_path(), length=16, shard_sequences=10).orderBy("shard").collect()
    each = docs.select(F.spark_partition_id().alias("p"), F.coalesce("text", F.lit("")).alias("t")).collect()
    want, bounds, tokens = [], [], 0
    for p in sorted({r.p for r in each}):
        mine = [r.t for r in each if r.p == p]
        stream = np.concatenate([np.append(np.frombuffer(e.encode(t), "<u2"), token_output.END_ID) for t in mine])
        tokens += len(stream)
        bounds.append(-(-sum(len(t.encode()) + 1 for t in mine) // 16))
        want.append(np.append(stream, np.full(-len(stream) % 16, token_output.END_ID)).reshape(-1, 16))
    first = np.cumsum(bounds) - bounds
    place = np.concatenate([token_output.slots(np.arange(f, f + len(w)), sum(bounds), 0) for f, w in zip(first, want, strict=True)])
    got = np.concatenate([token_output.read_records(r.path, r.first_slot, r.first_slot, r.sequences, 16) for r in m])
    assert (got == np.concatenate(want)[np.argsort(place)]).all() and len(got) == len(place) and sum(r.tokens for r in m) == tokens
    assert sorted(token_output.slots(np.arange(100), 100, 3)) == list(range(100))
    assert [r.first_slot for r in m] == [sum(x.sequences for x in m[:i]) for i in range(len(m))]
    assert all(hashlib.sha256(open(r.path, "rb").read()).hexdigest() == r.sha256 for r in m)


def test_language_model_is_a_distribution_and_counts(spark, texts):
    docs = frame(spark, texts)
    out = F.col("doc_id") % 5 == 1
    rows = ngram_lm.lm_scores(docs, out, ["doc_id"]).collect()
    words = {i: (t or "").lower().encode().split() + [b"<end>"] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in words.items() if i % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6
    scorer = ngram_lm.Scorer(ngram_lm.train_model(docs.where(~out)))
    every = np.append(toxicity.feature_hash(sorted(w for w in c if w != b"<end>"), [False] * (v - 1)), ngram_lm.END)
    _, _, _, low = scorer.words(every)
    for w in every[:5]:
        context = np.full(len(every), w)
        pc, d = scorer.pairs(context, every), np.array([0.0, *scorer.meta["d2"]])
        _, x, g, _ = scorer.words(context[:1])
        p = np.maximum(pc - d[np.minimum(pc, 3)], 0) / x[0] + g[0] * low
        assert abs(p.sum() + g[0] * scorer.meta["unseen"] - 1) < 1e-5


def test_maximal_segments_match_their_definition():
    def best(s, a, b):
        top = max(((sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        return [] if top[0] <= 1e-12 else best(s, a, top[1]) + [top[1:]] + best(s, top[2], b)

    rng = np.random.default_rng(0)
    for _ in range(100):
        s = rng.normal(size=rng.integers(1, 20))
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == best(s.tolist(), 0, len(s))


def test_toxic_passages(spark):
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(600):
        w = list(rng.choice(plain, 60))
        if i % 4 == 0:
            w[20:24] = rng.choice(["vileone", "viletwo", "nasty"], 4)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.where("doc_id < 480"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs.drop("toxic").union(spark.createDataFrame([(1000, None)], "doc_id long, text string")), model, ["doc_id"]).collect()}
    held = [(got[i].score >= 0.5) == bool(t) for i, _, t in rows[480:]]
    assert np.mean(held) > 0.95 and 0 <= got[1000].score < 0.5 and got[480].passages[0].first >= 15


def test_leaks(spark):
    rng = np.random.default_rng(6)
    item = [" ".join(f"q{x}" for x in rng.integers(0, 3000, 40)) + ". The answer is right here." for _ in range(20)]
    noise = [" ".join(f"q{x}" for x in rng.integers(0, 3000, 300)) for _ in range(60)]
    changed = item[3].split()
    changed[5:30:6] = ["other"] * len(changed[5:30:6])
    docs = frame(spark, [*noise, noise[0] + " " + item[1] + " " + noise[1], " ".join(changed), None, ""])
    bench = spark.createDataFrame([*enumerate(item), (99, None), (98, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()) == [(60, 1), (61, 3)]
    assert decontamination.clean_documents(docs, bench).count() == 62
    assert decontamination.leaks(docs, bench.where("false")).count() == 0


def hidden(rng, items, replaced):
    """Documents that hold one item each, the first of a hundred foreign words, a share of the item's words replaced."""
    out = []
    for t in items:
        w = t.split()
        for at in rng.choice(len(w), int(replaced * len(w)), replace=False):
            w[at] = f"z{rng.integers(0, 3000)}"
        noise = [f"q{x}" for x in rng.integers(0, 3000, 200)]
        out.append(" ".join(noise[:100] + w + noise[100:]))
    return out


def accepted(docs, items):
    """(document, item) where some passage of an item's span is accepted, by brute force."""
    made = [decontamination.Item(i, t.encode()) for i, t in enumerate(items)]
    words = [decontamination.plain_words(t.encode()) for t in docs]
    return sorted((d, m.id) for d, w in enumerate(words) for m in made if decontamination.closest(m, w))


def test_leaks_of_more_items_than_the_rank(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "RANK", 16)
    rng = np.random.default_rng(12)
    items = [" ".join(f"q{x}" for x in rng.integers(0, 3000, rng.integers(15, 60))) + "." for _ in range(200)]
    docs = hidden(rng, items[:100], 0.0)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect())
    assert got == accepted(docs, items) and set(got) >= {(i, i) for i in range(100)}


def test_leaks_of_short_and_long_items(spark):
    rng = np.random.default_rng(13)
    items = [" ".join(f"q{x}" for x in rng.integers(0, 3000, n)) + "!" for n in [5, 8, 10, 15, 20, 30, 60, 300, 500, 800] for _ in range(4)]
    docs = hidden(rng, items, 0.2) + hidden(rng, items, 0.0)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect())
    assert got == accepted(docs, items) and set(got) >= {(i, i % len(items)) for i in range(len(docs))}


def test_licences(spark):
    lines = ["some text\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\nmore", "he lost his driving license", None, "", "plain"]
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in licences.licences(frame(spark, lines)).collect()}
    assert {k: v for k, v in got.items() if v[0] != "unknown"} == {(0, 1): ("mit", True), (1, 0): ("cc-by-nc", True)}


def test_the_gate_loses_no_licence(spark):
    rng = np.random.default_rng(17)
    some = [" ".join(rng.choice([f"w{i}" for i in range(400)] + ["the", "of", "this", "under", "is", "and"] * 20, 30)) for _ in range(600)]
    notices = [r.notice for r in licences.notices(spark).collect()]
    mixed = [f"{a} {n} {b}" for n, a, b in zip(notices, some, some[300:] + some)] + notices
    shuffled = [" ".join(rng.permutation(n.split())) for n in notices]
    docs = frame(spark, some + mixed + shuffled)
    model = licences.train(spark, frame(spark, some).select(F.col("text").alias("p")))
    assert model.gate
    cut = sorted(map(tuple, licences.scan(docs, model).where("family <> 'unknown'").collect()))
    model.gate = None
    assert cut == sorted(map(tuple, licences.scan(docs, model).where("family <> 'unknown'").collect())) and len(cut) > len(notices)
    plain = licences.scan(frame(spark, notices), model)
    known = {r.notice: r.family for r in licences.notices(spark).collect()}
    assert sum(known[notices[r.doc_id]] == r.family for r in plain.collect()) > 0.95 * len(notices)


def test_trusted_perplexity(spark):
    rng = np.random.default_rng(8)
    good = [" ".join(rng.choice([f"w{i}" for i in range(50)], 80)) for _ in range(300)]
    docs = frame(spark, good + ["#! %% zz qq " * 20, None])
    trusted = spark.range(300).withColumnRenamed("id", "doc_id")
    kept = {r.doc_id: r.kept for r in quality_lm.quality_lm(docs, trusted).collect()}
    assert not kept[300] and np.mean([kept[i] for i in range(300)]) > 0.95


def test_empty_tables(spark):
    none = frame(spark, ["x"]).where("false")
    assert simhash.simhash_groups(none).count() == 0 and simhash.one_of_each(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0 and mixing.mix_sources(none).count() == 0
    assert suffix_dedup.remove_repeats(none, ["doc_id"]).count() == 0 and token_output.shards(none).count() == 0
    assert licences.licences(none).count() == 0 and quality_lm.quality_lm(none, none).count() == 0
    assert ngram_lm.lm_scores(none, F.lit(False), ["doc_id"]).count() == 0
    assert toxicity.toxicity(none, toxicity.train(none.withColumn("toxic", F.lit(1))), ["doc_id"]).count() == 0


def test_leaks_do_not_depend_on_the_number_of_items(spark):
    """Each document has all words of an item in order, three frequent words between every two; all are found, with few
    items or many."""
    rng = np.random.default_rng(31)
    filler = [f"c{i}" for i in range(60)]
    items = [" ".join(f"q{x}" for x in rng.integers(0, 40_000, 16)) for _ in range(700)]
    docs = []
    for i in range(40):
        out = list(rng.choice(filler, 30))
        for w in items[i].split():
            out += [w, *rng.choice(filler, 3)]
        docs.append(" ".join(out + list(rng.choice(filler, 30))))
    docs += [" ".join(rng.choice(filler, 120)) for _ in range(200)] + [None, ""]
    for n in (100, 700):
        bench = spark.createDataFrame(list(enumerate(items[:n])), "item_id long, text string")
        got = sorted((r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect())
        assert got == [(i, i) for i in range(40)]


def test_quality_of_clashing_columns_and_repeated_texts(spark):
    rng = np.random.default_rng(41)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 30)) for _ in range(60)]
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, __id string, key string"
    docs = spark.createDataFrame(rows, schema)
    trusted = docs.where("doc_id % 2 = 0").select("doc_id")
    once = {r.doc_id: r.perplexity for r in quality_lm.quality_lm(docs, trusted).collect()}
    copies = spark.createDataFrame([(i + 1000, texts[2 * i % 8], "en", "x", "y") for i in range(300)], schema)
    more = {r.doc_id: r.perplexity for r in quality_lm.quality_lm(docs.union(copies), trusted.union(copies.select("doc_id"))).collect()}
    assert all(abs(more[i] - once[i]) < 1e-6 * once[i] for i in once) and more[1003] == more[6]


def test_all_trusted_texts_train_the_quality_model(spark):
    """More trusted texts than an earlier bound of 8,000: a text of rare words that each trusted text holds alone is known."""
    texts = [f"a{i} b{i} C{i}" for i in range(18_000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trains = {r.doc_id for r in docs.where(quality_lm.fold() == 0).collect()}
    got = {r.doc_id: r for r in quality_lm.quality_lm(docs, docs.select("doc_id")).collect()}
    known = [got[i].perplexity for i in trains]
    others = sorted(r.perplexity for i, r in got.items() if i not in trains)
    assert len(trains) > 8_500 and max(known) < others[0]
    assert {r.threshold for r in got.values()} == {others[int(np.ceil(0.995 * len(others))) - 1]}


def test_pair_counts_are_as_wide_as_needed(spark, monkeypatch):
    """Counts beside the pair hashes take the bytes of a shard's largest count, and are read back exactly at every width."""
    cleaned, tidy = [], ngram_lm.tidy
    monkeypatch.setattr(ngram_lm, "tidy", lambda s: cleaned.append(tidy(s)))
    for often, wide in ((200, 1), (300, 2), (70_000, 4)):
        texts = ["a b " * often, "c d", "c d", "e"]
        folder = ngram_lm.train_model(frame(spark, texts))
        scorer = ngram_lm.Scorer(folder)
        words = [x for t in texts for x in [ngram_lm.START, *toxicity.feature_hash([w.encode() for w in t.split()], [False] * len(t.split())), ngram_lm.END]]
        pairs = Counter((v, w) for v, w in zip(words, words[1:]) if v != ngram_lm.END)
        v, w = (np.array(x, np.uint64) for x in zip(*pairs, (words[1], words[1])))
        assert scorer.pairs(v, w).tolist() == [*pairs.values(), 0] and max(pairs.values()) == often
        size = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("pairs-"))
        assert scorer.meta["shards"] == 1 and size == (8 + wide) * len(pairs) + 1
    # shuffle files of the words and of the pairs go before the next step
    assert len(cleaned) == 6


def test_exact_quantiles_of_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else None, float(x)) for i, x in enumerate(np.concatenate([rng.normal(size=60_000), np.ones(3_000), [7.0]]))]
    frame_ = spark.createDataFrame(rows, "g string, v double")
    for share in (0.0001, 0.5, 0.995, 1.0):
        got = {r.g: (r.n, r.q) for r in nearest_rank(frame_, "v", share, "g").collect()}
        for g in ("a", None):
            v = sorted(x for k, x in rows if k == g)
            assert got[g] == (len(v), v[int(np.ceil(round(share * len(v), 6))) - 1])


def test_all_plain_paragraphs_train_licences(spark):
    """Beyond 2,000 paragraphs each still counts: the model is that of the same paragraphs in other order and copies."""
    texts = [f"w{i} " + " ".join(w for k, w in enumerate(["the", "of", "software", "permission", "use", "version"]) if i >> k & 1) for i in range(3_000)]
    vocabulary = sorted({g for r in licences.notices(spark).select(licences.grams(licences.words(F.col("notice"))).alias("g")).collect() for g in r.g})
    terms = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="g", outputCol="features", binary=True)
    plain = spark.createDataFrame([(t,) for t in texts + texts[:500] + [None]], "p string")
    rows = licences.feature_sets(plain, vocabulary, terms).collect()
    held = Counter()
    for r in rows:
        held[frozenset(vocabulary[i] for i in r.features.indices if " " not in vocabulary[i])] += r.n
    assert held == Counter(frozenset(t.split()[1:]) for t in texts) and sum(r.n for r in rows if r.near) == sum(len(t.split()) > 1 for t in texts)


def test_marks_replace_the_words_of_paragraphs(spark, monkeypatch):
    """N-grams come from short marks of distinct paragraphs; cues, words and n-grams are those of the plain expressions."""
    odd = ["The the of -- the", "GPLv2 a.- +of+. 'use'", "a|b of | the", "İgnu ſpdx COPYRİGHT", "LICENSE", "cc  by", "cc-0 x", "xbsd bsd", "éclair ÉTÉ of ÉTÉ the", "", " ", "...", "c++. c-- 3.0/ 3.0.", "of the of the", "unauthorized", "unauthored", "the general public license version 3", "𝟛 the 𝐚 of"]
    rows = spark.createDataFrame([(p,) for p in [*odd, *odd[:5], *(f"the {i}x of {i}y" for i in range(50)), None]], "p string")
    plain_words = F.transform(F.regexp_extract_all(F.lower("p"), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.+/'-]*"), 0), lambda x: F.rtrim(x, F.lit(".'-/")))
    for r in rows.where("p is not null").select("p", licences.words(F.col("p")).alias("w"), plain_words.alias("plain"), licences.has_cue(F.col("p")).alias("cue"), F.col("p").rlike(licences.CUES).alias("like")).collect():
        assert (r.w, r.cue) == (r.plain, r.like), r.p
    vocabulary = sorted({g for r in licences.notices(spark).select(licences.grams(licences.words(F.col("notice"))).alias("g")).collect() for g in r.g})
    terms = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="g", outputCol="features", binary=True)
    each = rows.where("p is not null").distinct().select(F.pmod(F.xxhash64("p"), F.lit(5)).alias("fold"), licences.grams(plain_words).alias("g")).collect()
    wanted = Counter((r.fold, frozenset(r.g) & frozenset(vocabulary)) for r in each)
    written, saved = [], licences.saved
    monkeypatch.setattr(licences, "saved", lambda df, name: written.append(saved(df, name)) or written[-1])
    got = Counter()
    for r in licences.feature_sets(rows, vocabulary, terms).collect():
        got[r.fold, frozenset(vocabulary[i] for i in r.features.indices)] += r.n
        assert r.near == any(" " not in vocabulary[i] for i in r.features.indices)
    assert got == wanted
    # the 50 paragraphs that differ in other words alone are 5 rows at most, one a fold
    assert sum(w.count() for w in written) <= len(odd) + 5


def test_weighted_rank(spark):
    values = [(0.1 * i, 1 + i % 7) for i in range(300)]
    flat = sorted(v for v, c in values for _ in range(c))
    rows = spark.createDataFrame(values, "v double, c long")
    assert [licences.weighted_rank(rows, s) for s in (0.01, 0.5, 0.99, 1.0)] == [flat[int(np.ceil(round(s * len(flat), 6))) - 1] for s in (0.01, 0.5, 0.99, 1.0)]
    assert licences.weighted_rank(rows.where("false"), 0.99) is None

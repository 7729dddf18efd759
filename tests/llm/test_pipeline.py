"""Each pipeline stage against brute force on what its predecessor kept."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from propagon.llm import token_output


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    plain = [f"w{i}" for i in range(400)]
    texts, toxic = [], []
    for i in range(480):
        w = list(rng.choice(plain, 80))
        if i % 4 == 0:
            w[20:25] = rng.choice(["vileone", "viletwo", "nasty"], 5)
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    item = [" ".join(f"q{x}" for x in rng.integers(0, 3000, 40)) + ". The answer is right here." for _ in range(10)]
    texts += [texts[1], texts[1], texts[2].rsplit(" ", 1)[0] + " changed", texts[3] + " " + item[4], None, "", texts[5].replace(" ", "\n", 3)]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "clash", "clash", "clash", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score string, raw string, times int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, set(range(0, 480, 4))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


@pytest.fixture(scope="module")
def kept(spark, tables, tmp_path_factory):
    """The rows after every stage, as the stages are chained."""
    folder, _, _ = tables
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((docs.columns, docs.collect()))
    return out


def test_toxic_documents_go_and_clean_ones_stay(tables, kept):
    _, texts, toxic = tables
    columns, rows = kept[0]
    left = {r.doc_id for r in rows}
    assert columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "score", "raw", "times"] and len(left) == len(rows)
    assert len(left & toxic) <= 0.05 * len(toxic) and len(left - toxic) >= 0.98 * (len(texts) - len(toxic))


def test_one_of_each_near_duplicate_group_stays(kept):
    before = {r.doc_id: shingles(r.text or "") for r in kept[0][1]}
    root = {i: i for i in before}
    for i in sorted(before):
        for j in before:
            if j > i and len(before[i] & before[j]) >= 0.8 * len(before[i] | before[j]):
                root[j] = min(root[j], root[i])
    assert sorted(r.doc_id for r in kept[1][1]) == sorted(set(root.values()))


def test_only_the_leak_goes(tables, kept):
    leak = {i for i, t in enumerate(tables[1]) if "The answer is right here." in (t or "")}
    before, after = ({r.doc_id for r in kept[i][1]} for i in (1, 2))
    assert before & leak and before - after == before & leak


def test_mix_fills_targets(kept):
    size = {r.doc_id: (r.source, len((r.text or "").split())) for r in kept[2][1]}
    total, taken, times = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in kept[3][1])
    for source, n in size.values():
        total[source] += n
    for i, k in times.items():
        taken[size[i][0]] += k * size[i][1]
    names = sorted(k for k in total if k is not None) + [None]
    weight, want, free = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}, {}, set(names)
    while True:
        level = (1.5 * sum(total.values()) - sum(want.values())) / sum(weight[k] for k in free)
        full = {k for k in free if weight[k] * level > 2 * total[k]}
        if not full:
            break
        want |= {k: 2 * total[k] for k in full}
        free -= full
    want |= {k: weight[k] * level for k in free}
    assert max(times.values()) <= 2 and all(abs(taken[k] - want[k]) <= 90 for k in names)


def test_manifest_counts_all_tokens(kept):
    e = token_output.Encoder(token_output.tokenizer_path())
    width = e.dtype.itemsize
    assert sum(r.tokens for r in kept[4][1]) == sum(len(e.encode(r.text or "")) // width + 1 for r in kept[3][1])


def test_run_applies_every_stage(spark, tables, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, tables[0]).select("shard", "tokens").collect())) == sorted((r.shard, r.tokens) for r in kept[4][1])


def test_empty_documents(spark, tables, tmp_path):
    folder, none = tables[0], str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from propagon.operators import ancestry, batches, isotonic, projection, sampler
from propagon.sources import raw, vector_files


def pav(rows):
    """The plain walk over rows in order of score and label: (largest score, mean) of each block."""
    blocks = []
    for x, y in sorted(rows):
        blocks.append([y, 1, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            y2, w2, x2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + w2, x2]
    return [(b[2], b[0] / b[1]) for b in blocks]


@pytest.mark.parametrize("scores", ["continuous", "ties", "rising"])
def test_isotonic_steps_equal_a_plain_walk(spark, scores, monkeypatch):
    monkeypatch.setattr(isotonic, "TASK_BLOCKS", 20)
    rng = random.Random(scores)
    draw = {"continuous": rng.random, "ties": lambda: rng.randrange(7) / 7, "rising": rng.random}[scores]
    rows = [(p := draw(), int(rng.random() < (p if scores != "rising" else (p > 0.5)))) for _ in range(400)]
    valid = spark.createDataFrame([(y, p) for p, y in rows] + [(1, None)], "y_true int, y_prob double").repartition(6)
    new = [draw() for _ in range(100)] + [-1.0, 2.0, rows[0][0]]
    test = spark.createDataFrame([(i, 0, p) for i, p in enumerate(new)], "row_seq long, y_true int, y_prob double")
    got = {r.row_seq: r.p_isotonic for r in isotonic.isotonic(valid, test).collect()}
    steps = pav(rows)
    want = {i: next((v for x, v in steps if x >= p), steps[-1][1]) for i, p in enumerate(new)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    none = isotonic.isotonic(valid.limit(0), test).collect()
    assert {r.row_seq: r.p_isotonic for r in none} == {i: min(max(p, 0.0), 1.0) for i, p in enumerate(new)}


def test_projection_keeps_length_and_refuses(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(300)] + [(900, None), (901, [0.0] * 20)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = {r.k: np.array(r.v) for r in projection.project(df, "k", "v", 6, seed=3).collect()}
    m = projection.matrix(20, 6, 3)
    for k, v in rows[:300]:
        y = np.array(v) @ m
        assert np.allclose(got[k], y / np.linalg.norm(y))
    assert not got[900].any() and not got[901].any()
    assert abs(projection.matrix(400, 50, 1).std() * 50**0.5 - 1) < 0.02
    with pytest.raises(ValueError):
        projection.project(df, "k", "v", 21)


def test_batches_equal_a_greedy_walk(spark):
    rng = random.Random(2)
    counts = [rng.choice([1, 3, 10, 50, 400]) + rng.randrange(30) for _ in range(230)]
    got = batches.node_batches(spark.createDataFrame(list(enumerate(counts)), "sample long, nodes long"), 4, 5, 90).collect()
    mine = {}
    for r in got:
        mine.setdefault((r.bucket, r.batch), []).append(r["sample"])
    order = sorted(range(len(counts)), key=lambda i: (counts[i], i))
    want = []
    for at in range(0, len(order), 20):
        batch = []
        for i in order[at : at + 20]:
            grown = (len(batch) + 1) * max(counts[j] for j in [*batch, i])
            if batch and (counts[i] >= 90 or len(batch) == 4 or grown > 90):
                want.append(batch)
                batch = []
            batch.append(i)
            if counts[i] >= 90:
                want.append(batch)
                batch = []
        if batch:
            want.append(batch)
    assert [sorted(mine[k]) for k in sorted(mine)] == [sorted(b) for b in want]


def test_similar_nodes_of_large_cascades(spark, monkeypatch):
    monkeypatch.setattr(sampler, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(c, i, rng.integers(-2, 3, 3).astype(float).tolist()) for c, n in ((1, 70), (2, 5), (3, 1)) for i in range(n)]
    got = {(r.cascade_idx, r.i, r.j) for r in sampler.similar(spark.createDataFrame(rows, "cascade_idx long, node long, vector array<double>"), 4, 12).collect()}
    want = set()
    for c, n in ((1, 70), (2, 5), (3, 1)):
        v = {i: np.array(x) / max(np.linalg.norm(x), 1e-12) for k, i, x in rows if k == c}
        pool = list(range(n)) if n <= 12 else [t * (n - 1) // 11 for t in range(12)]
        take = min(4, max(len(pool) - 1, 1))
        for i in range(n):
            best = sorted(pool, key=lambda j: (-round(float(v[i] @ v[j]), 6), j))[:take]
            want |= {(c, i, j) for j in best if j != i}
    assert got == want


def test_sampled_by_keys_equals_by_vectors(spark, monkeypatch):
    monkeypatch.setattr(sampler, "BLOCK", 8)
    monkeypatch.setattr(vector_files, "ROWS", 9)
    rng = np.random.default_rng(6)
    vecs = {u: rng.integers(-2, 3, 3).astype(float).tolist() for u in range(30) if u % 5}
    users = [(c, i, int(u)) for c, n in ((1, 25), (2, 6), (3, 1)) for i, u in enumerate(rng.permutation(40)[:n])]
    edges = [(c, int(a), int(b), str(k), 1.0) for c, n in ((1, 25), (2, 6)) for k in ("current", "context", "follow") for a, b in rng.integers(0, n, (20, 2))]
    e = spark.createDataFrame(sorted(set(edges)), "cascade_idx long, src long, dst long, source string, weight double")
    whole = spark.createDataFrame([(c, i, vecs.get(u, [0.0] * 3)) for c, i, u in users], "cascade_idx long, node long, vector array<double>")
    keyed = spark.createDataFrame([(c, i, u if u % 7 or u in vecs else None) for c, i, u in users], "cascade_idx long, node long, key long")
    files = vector_files.save(spark.createDataFrame(sorted(vecs.items()), "id long, v array<double>"), "id", "v")
    assert len(files) > 1
    got = sampler.sampled(keyed, e, 4, 3, 6, files)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampler.sampled(whole, e, 4, 3, 6).collect()))
    assert "vector" not in keyed.columns and "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sampled_query_shuffles_no_vectors(spark, sf_dir):
    from propagon import catalogue

    plan = catalogue.QUERIES["sampled_neighbours"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # each relation that is read holds ids alone
    assert "array<double>" not in plan and "MapInArrow" in plan


def test_bundled_files_in_splits(spark, tmp_path):
    pairs = [(f, i, "" if i % 7 == 3 else f"e{i % 3}\tx", f"text {i % 2}" if i else "\ufefft\r") for f in (3, -1, 40, 41) for i in range(f % 50)]
    raw.write_bundles(spark.createDataFrame(pairs, "file long, pair long, event string, text string").repartition(3), str(tmp_path / "x"))
    files = [f for f in (tmp_path / "x").iterdir() if f.name.startswith("part-")]
    (tmp_path / "x" / "part-99999.txt").write_text("7\t\ufeffhead\n7\t1\n7\tev\r\n7\t\n")
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        lines = raw.numbered_lines(spark, str(tmp_path / "x"), bundled=True)
        got = {(r.file, r.line): r.value for r in lines.collect()}
        want = {("7", 0): "head", ("7", 1): "1", ("7", 2): "ev", ("7", 3): ""}
        for f, i, e, t in pairs:
            want |= {(str(f), 0): str(f), (str(f), 1): str(f % 50), (str(f), 2 + 2 * i): e, (str(f), 3 + 2 * i): t.rstrip("\r")}
        assert got == want
        assert sorted((int(r.file), r.pair, r.event, r.text) for r in raw.line_pairs(lines).collect()) == sorted([(7, 0, "ev", ""), *((f, i, e, t.rstrip("\r")) for f, i, e, t in pairs)])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pairs_of_many_cascades_lie_in_few_files(spark, sf_dir, monkeypatch):
    import os

    from propagon import catalogue, more_queries

    paths, made = [], more_queries.new_path
    monkeypatch.setattr(more_queries, "new_path", lambda s, name: paths.append(made(s, name)) or paths[-1])
    assert catalogue.QUERIES["raw_pair_counts"](spark, sf_dir).count() > 8
    assert sum(n.startswith("part-") for _, _, names in os.walk(paths[0].removeprefix("file:")) for n in names) <= 4


def test_raw_files_in_splits(spark, tmp_path):
    text = "﻿head\r\n5\n" + "".join(f"e{i % 3}\tx\ntext {i % 2}\r\n" if i % 4 else f" \nblank {i}\n" for i in range(200)) + "alone\n"
    (tmp_path / "a.txt").write_text(text, newline="")
    (tmp_path / "b.txt").write_text("only a head\n", newline="")
    (tmp_path / "c.txt").write_text("h1\nh2\nev\n\n", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        lines = raw.numbered_lines(spark, str(tmp_path))
        got = {(r.file[-5:], r.line): r.value for r in lines.collect()}
        plain = [x.rstrip("\r") for x in text.lstrip("﻿").split("\n")[:-1]]
        assert {k: v for k, v in got.items() if k[0] == "a.txt"} == {("a.txt", i): v for i, v in enumerate(plain)}
        across = {r.line: r.value for r in raw.numbered_lines(spark, str(tmp_path), True).collect()}
        assert [across[i] for i in range(len(across))] == [*plain, "only a head", "h1", "h2", "ev", ""]
        pairs = raw.line_pairs(lines)
        for by_text in (True, False):
            seen, kept = set(), []
            for i in range(200):
                e, t = plain[2 + 2 * i], plain[3 + 2 * i]
                key = (e, t) if by_text else e
                if not e.strip() or key not in seen:
                    kept.append((i, e, t))
                seen.add(key)
            mine = raw.distinct_pairs(pairs, by_text)
            assert sorted((r.pair, r.event, r.text) for r in mine.where(F.col("file").endswith("a.txt")).collect()) == kept
            n = {r.file[-5:]: (r.kept, r.dropped, r.total) for r in raw.pair_counts(pairs, mine).collect()}
            assert n == {"a.txt": (len(kept), 200 - len(kept), 200), "c.txt": (1, 0, 1)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    ("ids", "mapped", "kind", "line", "checked"),
    [(["a", "b"], ["1\ta", "2\tb"], None, None, 2), (["a", "b"], ["1\ta"], "length", 2, 1), (["a"], ["1\ta", "2\tb"], "length", 2, 1), (["a", "b", "c"], ["1\ta", "2", "3\tx"], "bad line", 2, 1), (["a"], ["x\ta"], "bad number", 1, 0), (["a", "b"], ["1\ta", "3\tb"], "mismatch", 2, 1), ([" a"], ["1\ta"], None, None, 1)],
)
def test_first_line_that_differs(spark, ids, mapped, kind, line, checked):
    frame = lambda v: spark.createDataFrame(list(enumerate(v)), "line long, value string")
    r = raw.first_mismatch(frame(ids), frame(mapped)).first()
    assert (r.kind, r.first_line, r.checked, r.ids, r.mapped) == (kind, line, checked, len(ids), len(mapped))


def test_depths_of_chains_stars_and_ancestors(spark):
    rng = random.Random(5)
    edges = [(1, i, i - 1) for i in range(1, 40)] + [(2, i, 0) for i in range(1, 30)] + [(3, i, rng.randrange(i)) for i in range(1, 60)]
    tree = spark.createDataFrame(edges, "cascade_idx long, child_tweet_idx long, parent_tweet_idx long")
    parent = {(c, i): p for c, i, p in edges}

    def path(c, i):
        out = [i]
        while (c, out[-1]) in parent:
            out.append(parent[c, out[-1]])
        return out

    assert {(r.cascade_idx, r.child_tweet_idx): r.depth for r in ancestry.depths(tree).collect()} == {(c, i): len(path(c, i)) - 1 for c, i, _ in edges}
    posts = [(c, i, rng.randrange(100), int(i == 0)) for c, n in ((1, 40), (2, 30), (3, 60)) for i in range(n)]
    got = ancestry.first_with_ancestors(spark.createDataFrame(posts, "cascade_idx long, tweet_idx long, relative_time long, is_root int"), tree, 4).collect()
    want = set()
    for c in (1, 2, 3):
        first = sorted((t, i) for k, i, t, _ in posts if k == c)[:4]
        want |= {(c, x) for i in [0, *(i for _, i in first)] for x in path(c, i)}
    assert sorted((r.cascade_idx, r.tweet_idx) for r in got) == sorted(want)
    assert ancestry.depths(tree.limit(0)).count() == 0

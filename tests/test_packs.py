"""Packs, node features and text vectors against plain versions."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from propagon.operators import features, org, packs, stability, windows
from propagon.sources import vector_files

ROWS = [(1, 1, 7, 1.0, None), (1, 2, 7, 2.0, 5.0), (1, 2, 3, -4.0, 0.5), (2, 1, 9, 0.0, 1.0)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, "cascade_idx long, window_idx long, user_idx long, a double, b double")


@pytest.fixture(scope="module")
def panes(spark):
    w = spark.createDataFrame([(1, 1, 3.0), (1, 2, float("inf")), (1, 4, -1.0), (2, 1, None), (3, 1, 1.0)], "cascade_idx long, window_idx long, a double")
    return packs.pack_windows(w, ["a"])


def test_windows_stand_in_order(panes):
    got = sorted((r["cascade_idx"], r["window_idx"], r["t"], r["x"]) for r in panes.collect())
    assert got == [(1, 1, 0, [3.0]), (1, 2, 1, [math.inf]), (1, 4, 2, [-1.0]), (2, 1, 0, [0.0]), (3, 1, 0, [1.0])]


def test_nodes_are_a_full_tensor(nodes, panes):
    got = {(r["cascade_idx"], r["t"], r["local_idx"]): (r["x_mask"], r["x"]) for r in packs.pack_nodes(nodes, panes, ["a", "b"]).collect()}
    none = (0, [0.0, 0.0])
    # user 3 is the first of cascade 1; cascade 3 has no nodes, so it has no places
    assert got == {(1, 0, 0): none, (1, 0, 1): (1, [1.0, 0.0]), (1, 1, 0): (1, [-4.0, 0.5]), (1, 1, 1): (1, [2.0, 5.0]), (1, 2, 0): none, (1, 2, 1): none, (2, 0, 0): (1, [0.0, 1.0])}


def test_other_width_is_an_error(spark, nodes, panes):
    v = spark.createDataFrame([(1, 1, 7, [1.0])], "cascade_idx long, window_idx long, user_idx long, v array<double>")
    places = packs.pack_places(nodes, panes)
    keys = ["cascade_idx", "window_idx", "user_idx"]
    assert sum(r["v_mask"] for r in packs.aligned(places, v, keys, "v", 1, "v").collect()) == 1
    with pytest.raises(PySparkException):
        packs.aligned(places, v, keys, "v", 2, "v").collect()


def test_candidates_by_sample_and_report(spark, nodes, panes):
    # user 5 is no user of the sample and keeps place 1, user 8 keeps 3, which lies outside
    c = spark.createDataFrame([(1, 3, 7, 0, 2, 0.5), (1, 3, 5, 0, 1, 0.25), (1, 5, 7, 1, 2, 9.0), (1, 8, 3, 3, 0, 2.0), (1, 7, 7, 2, 2, 1.0)], "cascade_idx long, src long, dst long, src_local long, dst_local long, w double")
    got = packs.sample_candidates(c, packs.local_nodes(nodes), "w")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1, 0.25), (1, 3, 0, 2.0)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, -1)], "cascade_idx long, label int")
    edges = spark.createDataFrame([(1, 0, 1), (2, 0, 4)], "cascade_idx long, src_local long, dst_local long")
    texts = spark.createDataFrame([(2,), (2,)], "cascade_idx long")
    from pyspark.sql import functions as F

    r = {x["label"]: x for x in packs.pack_report(panes, packs.pack_nodes(nodes, panes, ["a"]), edges, got, texts, labels, F.lit("train")).collect()}
    assert set(r) == {0, 1}
    assert (r[1]["samples"], r[1]["min_t"], r[1]["max_nodes"], r[1]["candidates"], r[1]["candidate_alignment_errors"], r[1]["edge_alignment_errors"], r[1]["samples_with_texts"]) == (1, 3, 2, 2, 1, 0, 0)
    assert (r[0]["samples"], r[0]["edge_alignment_errors"], r[0]["samples_with_texts"], r[0]["samples_with_candidates"]) == (1, 1, 1, 0)


def test_users_stand_for_the_tensor_in_a_report(spark, nodes, panes):
    # user 12 of cascade 2 has a window that the pack lacks, cascade 4 has none
    more = spark.createDataFrame([(2, 5, 12, 0.0, 0.0), (4, 1, 3, 0.0, 0.0)], nodes.schema)
    n = nodes.unionByName(more)
    whole = packs.pack_nodes(n, panes, ["a"]).groupBy("cascade_idx", "user_idx", "local_idx").agg({"x_mask": "max"})
    assert sorted(map(tuple, packs.pack_users(n, panes).collect())) == sorted(map(tuple, whole.collect()))


def test_counts_of_texts_and_users_come_without_windows(spark):
    posts = spark.createDataFrame([(1, 10, 7, 400, 1, "r"), (1, 11, 7, 1900, 0, "a"), (1, 12, 8, -30, 0, "b"), (1, 13, 8, 650, 0, "c"), (1, 14, 9, 1799, 0, None), (2, 20, 7, 0, 1, "d")], "cascade_idx long, tweet_idx long, user_idx long, relative_time long, is_root int, text string")
    extra = spark.createDataFrame([(1, 8, 0.5)], "cascade_idx long, user_idx long, text_score double")
    edges = org.star_edges(posts)
    keys = ["cascade_idx", "window_idx", "user_idx"]
    plain = windows.node_windows(posts, edges)
    stats = windows.text_stats(windows.text_windows(posts)).select(*keys, "num_texts_visible")
    want = plain.join(extra, ["cascade_idx", "user_idx"], "left").join(stats, keys, "left").na.fill(0, ["num_texts_visible"])
    got = windows.node_windows(posts, edges, texts=True, users=extra)
    assert got.columns == [*plain.columns, "text_score", "num_texts_visible"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_report_takes_no_vectors_and_no_tensor(spark, sf_dir, monkeypatch):
    from propagon import catalogue, pack_queries

    wide, kept = [], pack_queries.written
    monkeypatch.setattr(pack_queries, "written", lambda rows, name: kept(rows, wide.append((name, [t for _, t in rows.dtypes if t.startswith("array")])) or name))
    plan = catalogue.QUERIES["pack_report"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(arrays for _, arrays in wide) and "embedding#" not in plan.split("Exchange", 1)[0] and "summarizer" not in plan.lower()


def test_mean_vectors_are_unit_and_skip_null(spark):
    rng = np.random.default_rng(3)
    vecs = [(int(i % 3), [float(x) for x in rng.normal(size=4)]) for i in range(30)] + [(0, None), (9, None)]
    got = {r["k"]: (r["n"], r["v"]) for r in stability.mean_vectors(spark.createDataFrame(vecs, "k long, v array<double>").repartition(5), ["k"], "v").collect()}
    assert set(got) == {0, 1, 2}
    for k in range(3):
        m = np.mean([v for j, v in vecs if j == k and v], axis=0)
        assert got[k][0] == 10 and np.allclose(got[k][1], m / np.linalg.norm(m), atol=1e-12)


def test_neighbour_weights_of_zero(spark):
    e = spark.createDataFrame([(1, 5, 2.0), (2, 5, 1.0), (1, 6, 0.0), (2, 6, None), (3, 5, 4.0)], "src long, dst long, w double")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "node long, vector array<double>")
    got = {(r["node"], r["dim"]): round(r["x"], 9) for r in stability.neighbour_mean(e, v, "w").collect()}
    assert got == {(5, 0): round(2 / 3, 9), (5, 1): round(1 / 3, 9), (6, 0): 0.0, (6, 1): 0.0}


def test_vectors_do_not_go_along_with_edges(spark, monkeypatch):
    monkeypatch.setattr(vector_files, "ROWS", 7)
    rng = np.random.default_rng(8)
    vecs = [(int(i), rng.normal(size=3).tolist()) for i in [*range(0, 40, 2), 4, 4, 18]] + [(6, None), (None, [9.0] * 3)]
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 41, (400, 2))} | {(a, 99) for a in range(41)} | {(3, 77), (5, 77)}
    edges = [(a, b, float((a + b) % 4)) for a, b in pairs] + [(4, None, 2.0), (None, 5, 1.0)]
    e, v = spark.createDataFrame(edges, "src long, dst long, w double").repartition(3), spark.createDataFrame(vecs, "node long, vector array<double>")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for weight in (None, "w"):
            want = {}
            for a, b, w in edges:
                for k, x in vecs:
                    if a is not None and k == a and x:
                        total, mass = want.get(b, (0, 0))
                        want[b] = total + np.array(x) * (w if weight else 1), mass + (w if weight else 1)
            got = stability.neighbour_mean(e, v, weight)
            plan = got._jdf.queryExecution().executedPlan().toString()
            # one shuffle of ids and weights beside that of the test, and no join that vectors go through
            assert plan.count("Exchange") == 2 and "Join" not in plan
            mine = {}
            for r in got.collect():
                mine.setdefault(r["node"], {})[r["dim"]] = r["x"]
            assert set(mine) == set(want) and None in mine and 77 not in mine
            for b, (total, mass) in want.items():
                assert np.allclose([mine[b][i] for i in range(3)], total / max(mass, 1e-6), atol=1e-12)
        assert stability.neighbour_mean(e, v.limit(0)).count() == 0
        with pytest.raises(PySparkException):
            stability.neighbour_mean(e, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], v.schema)).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_text_rows_by_cascade_and_tweet(spark):
    t = spark.createDataFrame([(1, 1, 10, 100, "root_always_visible"), (1, 1, 11, 101, "current_window"), (2, 1, 20, 100, "root_always_visible"), (2, 1, 1, 100, "history_visible")], "cascade_idx long, window_idx long, tweet_idx long, user_idx long, text_visible_type string")
    r = spark.createDataFrame([(1, [1.0, 0.0])], "cascade_idx long, vector array<double>")
    p = spark.createDataFrame([(1, [0.0, 2.0]), (10, [9.0, 9.0])], "tweet_idx long, vector array<double>")
    rows = stability.text_rows(t, r, p)
    assert sorted((x["cascade_idx"], x["tweet_idx"], x["vector"]) for x in rows.collect() if x["vector"]) == [(1, 10, [1.0, 0.0]), (2, 1, [0.0, 2.0])]
    assert tuple(stability.text_report(rows).first()) == (4, 2, 1, 1, 2, 2)
    assert tuple(stability.text_report(rows.limit(0)).first()) == (0,) * 6


def test_tree_columns_are_zero_without_a_tree(spark, nodes):
    tree = spark.createDataFrame([(1, 7, 2, 30.0, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0, 1)], "cascade_idx long, user_idx long, depth long, parent_time_gap double, parent_score double, time_score double, text_score double, activity_score double, depth_penalty double, load_penalty double, root_fallback_flag int")
    got = {(r["cascade_idx"], r["window_idx"], r["user_idx"]): (r["has_tree_feature"], r["depth"], r["parent_time_gap"], r["root_fallback_flag"]) for r in features.with_tree_columns(nodes, tree).collect()}
    assert got == {(1, 1, 7): (1, 2, 30.0, 1), (1, 2, 7): (1, 2, 30.0, 1), (1, 2, 3): (0, 0, 0.0, 0), (2, 1, 9): (0, 0, 0.0, 0)}

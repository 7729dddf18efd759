import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from propagon.operators.components import grouped_components
from propagon.operators.coordination import coordination, links
from propagon.operators.ranking import nearest_ranks, ranked


def plain(nodes, edges, follows):
    out = []
    groups = defaultdict(list)
    for c, w, u, b, d in nodes:
        groups[c, w].append((u, b, d))
    for (c, w), users in groups.items():
        struct = {frozenset((s, t)) for x, y, s, t in edges if (x, y) == (c, w)}
        follow = {frozenset((s, t)) for x, s, t in follows if x == c and s != t}
        adjacent, weight = defaultdict(set), defaultdict(float)
        f, p, q = defaultdict(int), defaultdict(int), defaultdict(int)
        for (u, b, d), (v, e, g) in combinations(users, 2):
            k = frozenset((u, v))
            reasons = b == e, d == g and d > 0, k in struct, k in follow
            if any(reasons):
                adjacent[u].add(v), adjacent[v].add(u)
                for x in (u, v):
                    weight[x] += sum(r * z for r, z in zip(reasons, (0.35, 0.25, 0.2, 0.2), strict=True))
                    q[x] += reasons[0]
                    p[x] += reasons[1]
                    f[x] += reasons[3]
        for u, _, _ in users:
            seen, todo = {u}, [u]
            while todo:
                for v in adjacent[todo.pop()] - seen:
                    seen.add(v)
                    todo.append(v)
            n = len(adjacent[u])
            inner = sum(b in adjacent[a] for a, b in combinations(adjacent[u], 2))
            out.append((c, w, u, n, round(weight[u], 8), f[u], p[u], q[u], len(seen) if n else 0, round(inner / (n * (n - 1) / 2), 8) if n > 1 else 0.0))
    return sorted(out)


def test_closed_forms_equal_all_pairs(spark):
    rng = random.Random(7)
    nodes, edges, follows = [], [], []
    for c in range(6):
        many = 3 + 3 * c
        follows += [(c, rng.randrange(14), rng.randrange(14)) for _ in range(many)]
        for w in range(3):
            nodes += [(c, w, u, rng.randrange(1 + c), rng.randrange(4)) for u in rng.sample(range(14), rng.randrange(1, 13))]
            edges += [(c, w, rng.randrange(14), rng.randrange(14)) for _ in range(many)]
    n = spark.createDataFrame(nodes, "cascade_idx long, window_idx long, user_idx long, bin long, depth long")
    e = spark.createDataFrame(edges, "cascade_idx long, window_idx long, src long, dst long")
    f = spark.createDataFrame(follows, "cascade_idx long, src long, dst long")
    got = [tuple(r) for r in coordination(n, links(n, e, f)).collect()]
    want = plain(nodes, edges, follows)
    assert [x[:4] + x[5:9] for x in sorted(got)] == [x[:4] + x[5:9] for x in want]
    assert all(abs(a - b) < 1e-7 for x, y in zip(sorted(got), want, strict=True) for a, b in zip((x[4], x[9]), (y[4], y[9]), strict=True))
    assert coordination(n.limit(0), links(n.limit(0), e, f)).count() == 0


def test_components_of_many_graphs(spark):
    rng = random.Random(8)
    edges = [(g, rng.randrange(60), rng.randrange(60)) for g in range(4) for _ in range(10 + 15 * g)] + [(9, i, i + 1) for i in range(40)] + [(10, 3, 3)]
    got = {(r.g, r.node): r.root for r in grouped_components(spark.createDataFrame(edges, "g long, a long, b long"), ["g"]).collect()}
    label = {(g, x): x for g, *ends in edges for x in ends}
    for _ in edges:
        for g, a, b in edges:
            label[g, a] = label[g, b] = min(label[g, a], label[g, b])
    assert got == label


def test_places_and_nearest_ranks(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", None, "hot", "hot", "hot"]), rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    got = {r.i: r.place for r in ranked(df, ["k"], ["v", "i"]).collect()}
    want = {}
    for k in ("a", None, "hot"):
        want |= {x[2]: j for j, x in enumerate(sorted((y for y in rows if y[0] == k), key=lambda y: y[1:]))}
    assert got == want
    assert [r.place for r in ranked(df.drop("k"), [], ["v", "i"]).orderBy("v", "i").collect()] == list(range(400))
    values = [rng.choice([0.25, 3.5, rng.random() * 1e6, -2.0]) for _ in range(301)]
    shares = [0.0, 0.5, 0.9, 0.95, 1.0]
    x = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert nearest_ranks(x, "v", shares) == [sorted(values)[round(300 * q)] for q in shares]
    assert nearest_ranks(x.where(F.lit(False)), "v", [0.5]) == [0.0]

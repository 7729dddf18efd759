import random
from collections import defaultdict

from propagon.operators import key_users


def plain(seeds, edges, hops, pool, budget, rho):
    """Pools of one cascade's windows by walking from the seeds."""
    near = defaultdict(list)
    for a, b, w in edges:
        if a != b:
            near[a].append((b, w))
            near[b].append((a, w))
    rows = []
    for window, visible in seeds.items():
        start = sorted(visible, key=lambda u: (-visible[u], u))[:budget]
        path, hop, front = defaultdict(float), {u: 0 for u in start}, set(start)
        for u in start:
            path[u] = visible[u]
        for h in range(1, hops + 1):
            after = set()
            for u in front:
                for v, w in near[u]:
                    if v in visible:
                        path[v] += rho ** (h - 1) * w
                        if v not in hop:
                            after.add(v)
            hop.update({v: h for v in after})
            front = after
        score = {u: round(0.45 * path[u] + 0.3 * visible[u] + 0.15 * min(1, len(near[u]) / 50) + 0.1 / (1 + hop[u]), 8) for u in hop}
        best = sorted(score, key=lambda u: (-score[u], u))[:pool]
        low, high = min(score[u] for u in best), max(score[u] for u in best)
        rows += [(window, i, u, round((score[u] - low) / max(high - low, 1e-8), 5), hop[u]) for i, u in enumerate(best, 1)]
    return sorted(rows)


def test_pool_against_a_walk(spark):
    rng = random.Random(4)
    seeds = {w: {u: rng.randrange(1000) / 1000 for u in range(60) if rng.random() < 0.3 + 0.2 * w} for w in range(1, 4)}
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.5, 1.0, 2.0])) for _ in range(70)]
    edges += edges[:5]
    s = spark.createDataFrame([(7, w, u, x) for w, users in seeds.items() for u, x in users.items()], "cascade_idx long, window_idx long, user_idx long, seed double")
    e = spark.createDataFrame([(7, *x) for x in edges], "cascade_idx long, src long, dst long, weight double")
    got = sorted((r.window_idx, r["rank"], r.user_idx, r.weight, r.hop) for r in key_users.key_user_pool(s, e, 4, 12, 3, 0.6).collect())
    assert got == plain(seeds, edges, 4, 12, 3, 0.6)
    assert {r[4] for r in got} >= {0, 1, 2}
    assert key_users.key_user_pool(s.where("false"), e).count() == 0 and {r.hop for r in key_users.key_user_pool(s, e.where("false")).collect()} == {0}

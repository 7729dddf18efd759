"""Pool of key users: the seeds of each window and the visible users that lead there over candidate edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propagon.sources.shared import written

#: Hops, pool and seeds of a window, damping by hop; parts of seed and of final score; edges that count as full degree.
MAX_HOPS, POOL, SEEDS, RHO = 4, 32, 16, 0.6
SEED_MEAN, SEED_MAX = 0.6, 0.4
PATH, SEED, DEGREE, HOP = 0.45, 0.30, 0.15, 0.10
FULL_DEGREE = 50


def _scaled(value: str) -> Column:
    low, high = F.col(f"low_{value}"), F.col(f"high_{value}")
    return F.when(high - low < 1e-8, 0.0).otherwise((F.col(value) - low) / (high - low))


def seed_scores(nodes: DataFrame, features: list[str], windows: int = 6) -> DataFrame:
    """(cascade_idx, window_idx, user_idx, seed): mean and largest absolute feature, each scaled within its cascade; windows in
    which a user is not visible yet count as rows of zeros there."""
    sizes = F.array(*(F.abs(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in features))
    n = nodes.select("cascade_idx", "window_idx", "user_idx", (F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / len(features)).alias("mean"), F.array_max(sizes).alias("top"))
    each = n.groupBy("cascade_idx", "user_idx").agg(F.count("*").alias("seen"), *(g(k).alias(f"{name}_{k}") for k in ("mean", "top") for name, g in (("low", F.min), ("high", F.max))))
    padded = F.sum("seen") < windows * F.count("*")
    bounds = each.groupBy("cascade_idx").agg(*(F.when(padded, F.lit(0.0)).otherwise(F.min(f"low_{k}")).alias(f"low_{k}") for k in ("mean", "top")), *(F.max(f"high_{k}").alias(f"high_{k}") for k in ("mean", "top")))
    return n.join(bounds, "cascade_idx").select("cascade_idx", "window_idx", "user_idx", F.round(SEED_MEAN * _scaled("mean") + SEED_MAX * _scaled("top"), 8).alias("seed"))


def key_user_pool(seeds: DataFrame, edges: DataFrame, hops: int = MAX_HOPS, pool: int = POOL, budget: int = SEEDS, rho: float = RHO, undirected: bool = True) -> DataFrame:
    """(cascade_idx, window_idx, rank, user_idx, weight, hop) of the best ``pool`` users of every window.

    ``seeds``: the visible users as ``seed_scores`` gives them; ``edges``: (cascade_idx, src, dst, weight), repeats count,
    self loops don't. A hop adds to the path score of every visible neighbour of the users first met one hop before, also
    of those already met. Ties go to the smaller user. Repeated rows of ``seeds`` must not occur.
    """
    key = ["cascade_idx", "window_idx", "user_idx"]
    e = edges.where("src <> dst").select("cascade_idx", "src", "dst", "weight")
    if undirected:
        e = e.unionByName(e.select("cascade_idx", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    links = e.groupBy("cascade_idx", "src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    # each hop reads its users twice, so they are written; the plan would double at every hop
    seeds, links = written(seeds, "pool"), written(links, "pool")
    first = Window.partitionBy("cascade_idx", "window_idx").orderBy(F.desc("seed"), "user_idx")
    chosen = seeds.withColumn("place", F.row_number().over(first)).where(F.col("place") <= budget).select(*key, F.lit(0).alias("hop"))
    state = written(seeds.join(chosen, key, "left").withColumn("path", F.when(F.col("hop") == 0, F.col("seed")).otherwise(0.0)), "pool")
    for h in range(1, hops + 1):
        front = state.where(F.col("hop") == h - 1).select("cascade_idx", "window_idx", F.col("user_idx").alias("src"))
        met = front.join(links, ["cascade_idx", "src"]).groupBy("cascade_idx", "window_idx", F.col("dst").alias("user_idx")).agg(F.sum("weight").alias("add"))
        state = written(state.join(met, key, "left").select(*key, "seed", (F.col("path") + F.coalesce(rho ** (h - 1) * F.col("add"), F.lit(0.0))).alias("path"), F.coalesce("hop", F.when(F.col("add").isNotNull(), h)).alias("hop")), "pool")
    degrees = links.groupBy("cascade_idx", F.col("src").alias("user_idx")).agg(F.sum("n").alias("degree"))
    met = state.where("hop is not null").join(degrees, ["cascade_idx", "user_idx"], "left")
    score = PATH * F.col("path") + SEED * F.col("seed") + DEGREE * F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / FULL_DEGREE) + HOP / (1 + F.col("hop"))
    best = Window.partitionBy("cascade_idx", "window_idx").orderBy(F.desc("score"), "user_idx")
    kept = met.withColumn("score", F.round(score, 8)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= pool)
    whole = Window.partitionBy("cascade_idx", "window_idx")  # at most ``pool`` rows
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    return kept.withColumn("weight", F.round((F.col("score") - low) / F.greatest(high - low, F.lit(1e-8)), 5)).select("cascade_idx", "window_idx", "rank", "user_idx", "weight", "hop")

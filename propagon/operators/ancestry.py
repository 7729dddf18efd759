"""Depths and ancestors in finished trees, by jumps that double in length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propagon.operators.ranking import nearest_ranks, ranked
from propagon.operators.graph import bigrams, jaccard
from propagon.sources.shared import written

KEYS = ["cascade_idx", "node"]


def _jumps(tree: DataFrame, child: str, parent: str) -> DataFrame:
    return tree.select("cascade_idx", F.col(child).alias("node"), F.col(parent).alias("up"))


def depths(tree: DataFrame, child: str = "child_tweet_idx", parent: str = "parent_tweet_idx") -> DataFrame:
    """(cascade_idx, child, depth) of every child; a node that is no child has depth 0. Log(depth) joins; a node without end,
    which a cycle gives, is left out."""
    x = written(_jumps(tree, child, parent).withColumn("depth", F.lit(1).cast("long")), "depths")
    nodes, step = x.count(), 1
    while step <= nodes:
        far = x.select("cascade_idx", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        x = x.join(far, ["cascade_idx", "up"], "left")
        # a parent that is no child ends the walk
        x = written(x.select("cascade_idx", "node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
        if x.where("up is not null").isEmpty():
            break
        step *= 2
    return x.where("up is null").select("cascade_idx", F.col("node").alias(child), "depth")


def first_with_ancestors(posts: DataFrame, tree: DataFrame, most: int) -> DataFrame:
    """(cascade_idx, tweet_idx): the ``most`` earliest posts of each cascade, one at least, its roots, and all their ancestors."""
    early = ranked(posts.select("cascade_idx", "relative_time", "tweet_idx", "is_root"), ["cascade_idx"], ["relative_time", "tweet_idx"])
    picked = early.withColumn("node", F.col("tweet_idx")).withColumn("picked", (F.col("place") < max(1, most)) | (F.col("is_root") == 1)).select(*KEYS, "picked")
    x = written(picked.join(_jumps(tree, "child_tweet_idx", "parent_tweet_idx"), KEYS, "left"), "picked")
    while not x.where("up is not null").isEmpty():
        hit = x.where("picked and up is not null").select("cascade_idx", F.col("up").alias("node")).distinct().withColumn("hit", F.lit(True))
        far = x.select("cascade_idx", F.col("node").alias("up"), F.col("up").alias("next"))
        x = x.join(hit, KEYS, "left").withColumn("picked", F.col("picked") | F.coalesce("hit", F.lit(False))).drop("hit").join(far, ["cascade_idx", "up"], "left")
        x = written(x.select(*KEYS, "picked", F.col("next").alias("up")), "picked")
    return x.where("picked").select("cascade_idx", F.col("node").alias("tweet_idx"))


#: Fixed value: place of the post that stands for a random parent, modulo the number of earlier posts.
BASELINE = 12345


def baseline_parents(tree: DataFrame, posts: DataFrame) -> DataFrame:
    """(cascade_idx, child_tweet_idx, parent_tweet_idx): for each child the post at place BASELINE modulo its own place."""
    p = written(ranked(posts.select("cascade_idx", "relative_time", "tweet_idx"), ["cascade_idx"], ["relative_time", "tweet_idx"]), "places")
    child = p.select("cascade_idx", F.col("tweet_idx").alias("child_tweet_idx"), F.col("place").alias("child_place"), (F.lit(BASELINE) % F.greatest("place", F.lit(1))).alias("place")).where(F.col("child_place") > 0).drop("child_place")
    return tree.select("cascade_idx", "child_tweet_idx").join(child, ["cascade_idx", "child_tweet_idx"]).join(p.select("cascade_idx", "place", F.col("tweet_idx").alias("parent_tweet_idx")), ["cascade_idx", "place"]).drop("place")


def _similarity(pairs: DataFrame, posts: DataFrame):
    t = posts.select("cascade_idx", "tweet_idx", bigrams(F.col("text")).alias("g"))
    x = pairs.join(t.withColumnsRenamed({"tweet_idx": "child_tweet_idx", "g": "gc"}), ["cascade_idx", "child_tweet_idx"]).join(t.withColumnsRenamed({"tweet_idx": "parent_tweet_idx", "g": "gp"}), ["cascade_idx", "parent_tweet_idx"])
    return x.agg(F.avg(F.when((F.size("gc") > 0) & (F.size("gp") > 0), jaccard(F.col("gc"), F.col("gp"))).otherwise(0.0)).alias("m"))


def tree_shape(tree: DataFrame, posts: DataFrame, source: str | None = None) -> DataFrame:
    """(measure, value) of a whole tree: depths and gaps with nearest-rank percentiles, busiest parents, entropy of children,
    text similarity to parents and to the baseline, and with ``source`` the share of each source of parents."""
    t = written(tree.join(depths(tree), ["cascade_idx", "child_tweet_idx"]).withColumn("gap", F.greatest("time_gap", F.lit(0))), "tree")
    busy = written(t.groupBy("cascade_idx", "parent_tweet_idx").agg(F.count("*").alias("k")), "parents")
    shares = [0.5, 0.9, 0.95]
    by_depth, by_gap = nearest_ranks(t, "depth", shares), nearest_ranks(t, "gap", shares[:2])
    n, total = t.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0))).first()
    one = max(n, 1)
    # one row a different number of children
    p = F.col("k") / one
    sizes = busy.groupBy("k").agg(F.count("*").alias("m"))
    means = t.agg(F.avg("depth"), F.avg("gap")).first()
    entropy, branching = sizes.agg(-F.sum(F.col("m") * p * F.log(p + 1e-12)), F.sum(F.when(F.col("k") > 1, F.col("m")))).first()
    top = [r["k"] for r in busy.orderBy(F.desc("k")).limit(5).collect()]
    real, chance = (_similarity(x, posts).first()[0] or 0.0 for x in (t.select("cascade_idx", "child_tweet_idx", "parent_tweet_idx"), baseline_parents(t, posts)))
    values = {
        "num_tree_edges": n, "avg_depth": means[0] or 0, "depth_p50": by_depth[0], "depth_p90": by_depth[1], "depth_p95": by_depth[2], "max_depth": total,
        "time_gap_mean": means[1] or 0, "time_gap_median": by_gap[0], "time_gap_p90": by_gap[1], "num_branching_parents": branching or 0, "branch_entropy": entropy or 0,
        "top1_parent_child_ratio": sum(top[:1]) / one, "top5_parent_child_ratio": sum(top) / one, "parent_child_text_sim_mean": real, "random_pair_text_sim_mean": chance, "text_sim_lift": real - chance,
    }
    if source:
        values |= {f"source_{r[source]}": r["count"] / one for r in t.groupBy(source).count().collect()}
    return tree.sparkSession.createDataFrame([(k, round(float(v), 6)) for k, v in values.items()], "measure string, value double")

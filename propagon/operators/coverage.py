"""Texts of posts from several sources, and how far texts, profiles and follow edges cover a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved_texts(roots: DataFrame, reposts: DataFrame, posts: DataFrame) -> DataFrame:
    """(tweet_idx, text, source): the text of each tweet, from posts before reposts before roots, within one the last by seq.

    Each is (tweet_idx, text, seq); a null text counts as empty and stands for its tweet all the same; numbers below 1 do not
    count. One aggregate, whatever the number of texts of a tweet.
    """
    named = [df.select("tweet_idx", F.coalesce("text", F.lit("")).alias("text"), F.col("seq").cast("long").alias("seq"), F.lit(i).alias("order"), F.lit(k).alias("source")) for i, (k, df) in enumerate((("root", roots), ("repost", reposts), ("post", posts)))]
    every = named[0].unionByName(named[1]).unionByName(named[2]).where("tweet_idx > 0")
    best = every.groupBy("tweet_idx").agg(F.max_by(F.struct("text", "source"), F.struct("order", "seq", "text")).alias("t"))
    return best.select("tweet_idx", "t.*")


def root_texts(roots: DataFrame) -> DataFrame:
    """(cascade_idx, text): the last root text of each cascade by seq."""
    return roots.where("cascade_idx > 0").groupBy("cascade_idx").agg(F.max_by(F.coalesce("text", F.lit("")), F.struct("seq", "text")).alias("text"))


def texts_of(posts: DataFrame, texts: DataFrame, by_cascade: DataFrame) -> DataFrame:
    """(cascade_idx, tweet_idx, is_root, text, source): a post's own text; a root without any has its cascade's."""
    x = posts.select("cascade_idx", "tweet_idx", "is_root").join(texts, "tweet_idx", "left").join(by_cascade.withColumnRenamed("text", "of_cascade"), "cascade_idx", "left")
    spare = (F.col("is_root") == 1) & (F.coalesce("text", F.lit("")) == "") & (F.coalesce("of_cascade", F.lit("")) != "")
    return x.select("cascade_idx", "tweet_idx", "is_root", F.when(spare, F.col("of_cascade")).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(spare, "cascade").otherwise(F.coalesce("source", F.lit("none"))).alias("source"))


def _covered(name: str, wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    w = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    # each side is one key a row, so no key repeats in the join
    hit = w.join(present.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return hit.agg(F.count("hit").alias("covered"), F.count("*").alias("total")).select(F.lit(name).alias("measure"), "covered", "total", F.round(F.when(F.col("total") > 0, F.col("covered") / F.col("total")), 6).alias("ratio"))


def _nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s", "") != "")


def follow_coverage(follows: DataFrame, users: DataFrame) -> DataFrame:
    """Users who are an end of a follow edge. The ends are filtered by the users before they are shuffled where the users are
    few; equal ends go before the join."""
    ends = follows.select(F.explode(F.array("src", "dst")).alias("user_idx")).join(users.select("user_idx").distinct(), "user_idx", "left_semi")
    return _covered("follow", users, ends, "user_idx")


def readiness(posts: DataFrame, roots: DataFrame, reposts: DataFrame, profiles: DataFrame, follows: DataFrame) -> DataFrame:
    """(measure, covered, total, ratio): root and repost texts by tweet, profiles and follow edges by user. A blank text or
    profile covers nothing; a ratio of none is null."""
    r, p = posts.where("is_root = 1"), posts.where("is_root = 0")
    out = _covered("root_text", r, _nonblank(roots, "text"), "tweet_idx")
    for more in (_covered("repost_text", p, _nonblank(reposts, "text"), "tweet_idx"), _covered("profile", posts, _nonblank(profiles, "profile"), "user_idx"), follow_coverage(follows, p)):
        out = out.unionByName(more)
    return out


def share_present(missing: Column, n: Column) -> Column:
    """1 less missing by n, where n counts 1 at least."""
    return F.round(1 - missing / F.greatest(n, F.lit(1)), 6)


#: Upper bounds of sizes and of durations in seconds.
SIZE_BINS, DURATION_BINS = (0, 10, 50, 100, 500, 1000, 5000), (0, 3600, 21600, 86400, 604800, 2592000)


def binned(rows: DataFrame, value: str, bounds: tuple[int, ...]) -> DataFrame:
    """(bin, count, ratio) of values by the first bound that holds them, a last bin beyond all; empty bins stay."""
    at = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < F.col(value)))
    n = rows.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    every = rows.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bin"))
    total = n.agg(F.sum("count").alias("all"))
    x = every.join(n, "bin", "left").na.fill(0).join(F.broadcast(total))  # one row
    return x.select("bin", "count", F.round(F.when(F.col("all") > 0, F.col("count") / F.col("all")), 6).alias("ratio"))

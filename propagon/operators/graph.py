"""Trees of reposts, follow relations, and what both have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK_GAP = 1800


def time_only_tree(posts: DataFrame, gap: int = LOOKBACK_GAP) -> DataFrame:
    """Parent of each post: the latest strictly earlier one of its cascade; equal times go to the larger ids. Also how many
    candidates lie within the gap; where none does, all earlier posts count."""
    by = Window.partitionBy("cascade_idx").orderBy("relative_time")
    before = by.rangeBetween(Window.unboundedPreceding, -1)
    t = posts.withColumn("p", F.max(F.struct("relative_time", "tweet_idx", "user_idx")).over(before))
    near = F.count("*").over(by.rangeBetween(-gap, -1))
    t = t.withColumn("near", near).withColumn("all", F.count("*").over(before))
    out = t.where("is_root = 0 and p is not null")
    return out.select("cascade_idx", F.col("tweet_idx").alias("child_tweet_idx"), F.col("user_idx").alias("child_user_idx"), F.col("p.tweet_idx").alias("parent_tweet_idx"), F.col("p.user_idx").alias("parent_user_idx"), (F.col("relative_time") - F.col("p.relative_time")).alias("time_gap"), F.when(F.col("near") > 0, F.col("near")).otherwise(F.col("all")).alias("candidate_count"))


def tree_edges(tree: DataFrame, posts: DataFrame) -> DataFrame:
    """A tree as user edges, parent to child at the child's time, in the form of ``star_edges``."""
    t = posts.select("cascade_idx", F.col("tweet_idx").alias("child_tweet_idx"), "relative_time")
    return tree.join(t, ["cascade_idx", "child_tweet_idx"]).select("cascade_idx", F.col("parent_user_idx").alias("src"), F.col("child_user_idx").alias("dst"), F.col("parent_tweet_idx").alias("src_tweet"), F.col("child_tweet_idx").alias("dst_tweet"), "relative_time")


def tree_parents(tree: DataFrame) -> DataFrame:
    """Per cascade: edges, parents, parents of two or more, the share of the busiest, and the entropy of children."""
    n = tree.groupBy("cascade_idx", "parent_tweet_idx").agg(F.count("*").alias("c"))
    x = n.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("cascade_idx")))
    return x.groupBy("cascade_idx").agg(F.sum("c").alias("edges"), F.count("*").alias("parents"), F.count_if(F.col("c") > 1).alias("branching"), F.round(F.max("p"), 6).alias("top_share"), F.round(-F.sum(F.col("p") * F.log(F.col("p") + 1e-12)), 6).alias("entropy"))


def bigrams(text: Column) -> Column:
    """Distinct pairs of characters, lower case and without white space; a text of two or fewer is one."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= 2, F.array(t)).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def parent_similarity(tree: DataFrame, posts: DataFrame) -> DataFrame:
    """Similarity of every post's text to its parent's. Texts are cut into pairs of characters after the joins."""
    t = posts.select("tweet_idx", F.col("text").alias("g"))
    x = tree.join(t.withColumnsRenamed({"tweet_idx": "child_tweet_idx", "g": "gc"}), "child_tweet_idx").join(t.withColumnsRenamed({"tweet_idx": "parent_tweet_idx", "g": "gp"}), "parent_tweet_idx")
    x = x.withColumns({k: bigrams(F.col(k)) for k in ("gc", "gp")})
    return x.select("cascade_idx", "child_tweet_idx", "parent_tweet_idx", F.round(jaccard(F.col("gc"), F.col("gp")), 6).alias("text_similarity"))


def follow_subgraph(follows: DataFrame, users: DataFrame) -> DataFrame:
    """Follow edges whose ends are both users of the run."""
    u = users.select("user_idx").distinct()
    return follows.join(u.withColumnRenamed("user_idx", "src"), "src", "left_semi").join(u.withColumnRenamed("user_idx", "dst"), "dst", "left_semi").select("src", "dst")


def symmetric_pairs(follows: DataFrame, users: DataFrame) -> DataFrame:
    """Pairs linked in either direction, both ways round."""
    f = follow_subgraph(follows, users)
    return f.union(f.select("dst", "src")).distinct()


def candidate_edges(follows: DataFrame, posts: DataFrame) -> DataFrame:
    """Follow edges in each cascade that has both ends, with the users' 0-based places by id; self loops stay."""
    v = posts.select("cascade_idx", "user_idx").distinct()
    v = v.withColumn("local_idx", F.row_number().over(Window.partitionBy("cascade_idx").orderBy("user_idx")) - 1)
    s = v.withColumnsRenamed({"user_idx": "src", "local_idx": "src_local"})
    d = v.withColumnsRenamed({"user_idx": "dst", "local_idx": "dst_local"})
    # edges with an end outside all cascades go before a user's cascades multiply the rest
    own = follows.join(v.select(F.col("user_idx").alias("dst")).distinct(), "dst", "left_semi")
    return own.join(s, "src").join(d, ["cascade_idx", "dst"]).select("cascade_idx", "src", "dst", F.col("src_local").cast("long"), F.col("dst_local").cast("long"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient of every node of an edge list, directions and self loops ignored."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    deg = pairs.union(pairs.select("v", "u")).groupBy("u").agg(F.count("*").alias("k"))
    # edges lead to the end of more neighbours, so that a hub starts few wedges; each triangle is found once
    ku, kv = deg.withColumnsRenamed({"k": "ku"}), deg.withColumnsRenamed({"u": "v", "k": "kv"})
    up = (F.col("ku") < F.col("kv")) | ((F.col("ku") == F.col("kv")) & (F.col("u") < F.col("v")))
    e = pairs.join(ku, "u").join(kv, "v").select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("v"))
    a, b, c = e.alias("a"), e.alias("b"), e.alias("c")
    tri = a.join(b, F.col("a.v") == F.col("b.u")).join(c, (F.col("c.u") == F.col("a.u")) & (F.col("c.v") == F.col("b.v"))).select(F.explode(F.array("a.u", "a.v", "b.v")).alias("u")).groupBy("u").agg(F.count("*").alias("t"))
    return deg.join(tri, "u", "left").select(F.col("u").alias("user_idx"), F.col("k").alias("degree"), F.round(F.when(F.col("k") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0), 6).alias("clustering"))

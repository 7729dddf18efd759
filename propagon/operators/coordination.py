"""Coordination graphs: users of one window that act in the same time bin, at the same depth, or along an edge.

Bins and depths make cliques, which are counted and never written as pairs; only edges between users of different bins and
depths, here called lone, are rows. ``clique`` stands for users that share a bin or a depth above 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propagon.operators.components import grouped_components
from propagon.sources.shared import written

#: Weights of the four reasons for a link.
BIN, DEPTH, EDGE, FOLLOW = 0.35, 0.25, 0.2, 0.2
KEYS = ["cascade_idx", "window_idx"]


def _two(n: Column) -> Column:
    return n * (n - 1) / 2


def links(nodes: DataFrame, edges: DataFrame, follows: DataFrame) -> DataFrame:
    """Pairs a < b of active users with the flags edge (in the window, any scope) and follow (in the cascade).

    ``nodes`` has the active users, ``edges`` (keys, src, dst) and ``follows`` (cascade_idx, src, dst). Directions and self
    loops do not count.
    """
    low, high = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    e = edges.where("src <> dst").select(*KEYS, low, high).distinct().withColumn("edge", F.lit(1)).withColumn("follow", F.lit(0))
    f = follows.where("src <> dst").select("cascade_idx", low, high).distinct()
    a, b = (nodes.select(*KEYS, F.col("user_idx").alias(k)) for k in ("a", "b"))
    f = f.join(a, ["cascade_idx", "a"]).select(*KEYS, "a", "b", F.lit(0).alias("edge"), F.lit(1).alias("follow"))
    both = e.unionByName(f).join(a, [*KEYS, "a"], "left_semi").join(b, [*KEYS, "b"], "left_semi")
    return both.groupBy(*KEYS, "a", "b").agg(F.max("edge").alias("edge"), F.max("follow").alias("follow"))


def _lone_links(lone: DataFrame, cells: DataFrame) -> DataFrame:
    """Per user with lone edges: links among its neighbours that have an end at a lone edge's far end."""
    x = lone  # (keys, u, ub, ud, v, vb, vd), both ways round
    count = lambda by, name: x.groupBy(*KEYS, F.col("u").alias("v"), *by).agg(F.count("*").alias(name))
    by_bin, by_depth, by_cell = count([F.col("vb").alias("ub")], "nb"), count([F.col("vd").alias("ud")], "nd"), count([F.col("vb").alias("ub"), F.col("vd").alias("ud")], "nc")
    own = lambda name, bin_, depth: cells.select(*KEYS, F.col("bin").alias(bin_), F.col("depth").alias(depth), F.col("n_cell").alias(name))
    j = x.join(own("c1", "ub", "vd"), [*KEYS, "ub", "vd"], "left").join(own("c2", "vb", "ud"), [*KEYS, "vb", "ud"], "left")
    j = j.join(by_bin, [*KEYS, "v", "ub"], "left").join(by_depth, [*KEYS, "v", "ud"], "left").join(by_cell, [*KEYS, "v", "ub", "ud"], "left").na.fill(0, ["c1", "c2", "nb", "nd", "nc"])
    # the far end v with bin mates of u: alike in depth, or over lone edges; with depth mates of u: alike in bin, or over lone ones
    mates = F.when(F.col("vd") > 0, F.col("c1")).otherwise(0) + F.col("nb") - 1
    deep = F.when(F.col("ud") > 0, F.col("c2") + F.col("nd") - F.col("nc")).otherwise(0)
    first = j.groupBy(*KEYS, "u").agg(F.sum(mates + deep).alias("t"))
    # two far ends of u with each other, by bin or depth
    inner = by_bin.select(*KEYS, F.col("v").alias("u"), _two(F.col("nb")).alias("t")).unionByName(by_depth.where("ud > 0").select(*KEYS, F.col("v").alias("u"), _two(F.col("nd")).alias("t"))).unionByName(by_cell.where("ud > 0").select(*KEYS, F.col("v").alias("u"), (-_two(F.col("nc"))).alias("t")))
    # triangles of lone edges
    e = x.select(*KEYS, "u", "v")
    up = e.where("u < v")
    tri = up.alias("p").join(up.select(*KEYS, F.col("u").alias("v"), F.col("v").alias("w")).alias("q"), [*KEYS, "v"]).join(up.select(*KEYS, "u", F.col("v").alias("w")), [*KEYS, "u", "w"])
    corners = tri.select(*KEYS, F.explode(F.array("u", "v", "w")).alias("u"), F.lit(1.0).alias("t"))
    return first.withColumn("t", F.col("t").cast("double")).unionByName(inner.withColumn("t", F.col("t").cast("double"))).unionByName(corners).groupBy(*KEYS, "u").agg(F.sum("t").alias("lone_links")).withColumnRenamed("u", "user_idx")


def coordination(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Every active user: degree, weight, follow, same_depth and same_bin links, size of its component (0 for a user without
    links) and density among its neighbours.

    ``nodes`` (keys, user_idx, bin, depth), unique and without nulls; ``links`` as from ``links``. Both are read many times and
    therefore written once.
    """
    nodes = written(nodes.select(*KEYS, "user_idx", "bin", "depth"), "active")
    cells = nodes.groupBy(*KEYS, "bin", "depth").agg(F.count("*").alias("n_cell"))
    bins = cells.groupBy(*KEYS, "bin").agg(F.sum("n_cell").alias("n_bin"))
    depths = cells.where("depth > 0").groupBy(*KEYS, "depth").agg(F.sum("n_cell").alias("n_depth"), F.min("bin").alias("least"))
    spot = lambda end: nodes.select(*KEYS, F.col("user_idx").alias(end), F.col("bin").alias(f"{end}b"), F.col("depth").alias(f"{end}d"))
    pairs = links.join(spot("a"), [*KEYS, "a"]).join(spot("b"), [*KEYS, "b"])
    is_lone = (F.col("ab") != F.col("bb")) & ~((F.col("ad") == F.col("bd")) & (F.col("ad") > 0))
    turned = lambda u, v: pairs.select(*KEYS, *(F.col(f"{u}{x}").alias(f"u{x}") for x in ("", "b", "d")), *(F.col(f"{v}{x}").alias(f"v{x}") for x in ("", "b", "d")), "edge", "follow", is_lone.cast("long").alias("lone"))
    pairs = written(pairs, "links")
    ends = turned("a", "b").unionByName(turned("b", "a"))
    lone = ends.where("lone = 1").select(*KEYS, "u", "ub", "ud", "v", "vb", "vd")
    per = ends.groupBy(*KEYS, F.col("u").alias("user_idx")).agg(*(F.sum(k).alias(f"n_{k}") for k in ("edge", "follow", "lone")))
    # a bin is one node; depths and lone edges tie bins together
    ties = cells.join(depths, [*KEYS, "depth"]).where("bin <> least").select(*KEYS, F.col("bin").alias("a"), F.col("least").alias("b")).unionByName(lone.select(*KEYS, F.col("ub").alias("a"), F.col("vb").alias("b")))
    roots = grouped_components(ties, KEYS).withColumnRenamed("node", "bin")
    placed = bins.join(roots, [*KEYS, "bin"], "left").withColumn("root", F.coalesce("root", F.col("bin").cast("long")))
    sizes = placed.groupBy(*KEYS, "root").agg(F.sum("n_bin").alias("size"))
    # between bin mates and depth mates of one cell
    across = lone.where("vd > 0").groupBy(*KEYS, F.col("ub").alias("bin"), F.col("vd").alias("depth")).agg(F.count("*").alias("n_across"))
    x = nodes.select(*KEYS, "user_idx", "bin", "depth").join(cells, [*KEYS, "bin", "depth"]).join(placed.join(sizes, [*KEYS, "root"]), [*KEYS, "bin"]).join(depths.drop("least"), [*KEYS, "depth"], "left").join(across, [*KEYS, "bin", "depth"], "left").join(per, [*KEYS, "user_idx"], "left").join(_lone_links(lone, cells), [*KEYS, "user_idx"], "left")
    deep = F.col("depth") > 0
    x = x.na.fill(0, ["n_across", "n_edge", "n_follow", "n_lone", "lone_links"]).withColumns({"same_bin": F.col("n_bin") - 1, "same_depth": F.when(deep, F.col("n_depth") - 1).otherwise(0), "same_cell": F.when(deep, F.col("n_cell") - 1).otherwise(0)})
    beyond = F.col("same_depth") - F.col("same_cell")
    x = x.withColumn("degree", F.col("same_bin") + beyond + F.col("n_lone"))
    inner = _two(F.col("same_bin")) + _two(beyond) + F.col("same_cell") * beyond + F.when(deep, F.col("n_across")).otherwise(0) + F.col("lone_links")
    density = F.when(F.col("degree") > 1, inner / _two(F.col("degree"))).otherwise(0.0)
    weight = BIN * F.col("same_bin") + DEPTH * F.col("same_depth") + EDGE * F.col("n_edge") + FOLLOW * F.col("n_follow")
    return x.select(*KEYS, "user_idx", F.col("degree").cast("long").alias("degree"), F.round(weight, 8).alias("weight"), F.col("n_follow").cast("long").alias("follow_links"), F.col("same_depth").cast("long").alias("depth_links"), F.col("same_bin").cast("long").alias("bin_links"), F.when(F.col("degree") > 0, F.col("size")).otherwise(0).cast("long").alias("component"), F.round(density, 8).alias("density"))

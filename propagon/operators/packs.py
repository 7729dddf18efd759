"""Training samples in long form: nodes, edges and candidates of a cascade under local numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propagon.operators import ranking


def local_nodes(nodes: DataFrame) -> DataFrame:
    """(cascade_idx, user_idx, local_idx): 0-based places of a cascade's users by id."""
    by = Window.partitionBy("cascade_idx").orderBy("user_idx")
    return nodes.select("cascade_idx", "user_idx").distinct().withColumn("local_idx", (F.row_number().over(by) - 1).cast("long"))


def labelled_only(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of cascades with label 0 or 1."""
    return rows.join(labels.where("label >= 0").select("cascade_idx", "label").distinct(), "cascade_idx")


def pack_mask(nodes: DataFrame, windows: int = 6) -> DataFrame:
    """(cascade_idx, window_idx, local_idx, mask): every window of every user, 1 where the user is visible."""
    every = local_nodes(nodes).withColumn("window_idx", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(windows).cast("long"))))
    seen = nodes.select("cascade_idx", "window_idx", "user_idx", F.lit(1).alias("mask"))
    return every.join(seen, ["cascade_idx", "window_idx", "user_idx"], "left").select("cascade_idx", "window_idx", "local_idx", F.coalesce("mask", F.lit(0)).alias("mask"))


def pack_edges(edge_windows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of each window and scope between local numbers; ends outside the users drop out."""
    v = local_nodes(nodes)
    s, d = v.withColumnsRenamed({"user_idx": "src", "local_idx": "src_local"}), v.withColumnsRenamed({"user_idx": "dst", "local_idx": "dst_local"})
    return edge_windows.join(s, ["cascade_idx", "src"]).join(d, ["cascade_idx", "dst"]).select("cascade_idx", "window_idx", "window_scope", "src_local", "dst_local")


def pack_candidates(candidates: DataFrame) -> DataFrame:
    """Candidate edges without self loops, each once."""
    return candidates.where("src_local <> dst_local").select("cascade_idx", "src_local", "dst_local").distinct()


def pack_diagnostics(nodes: DataFrame, labels: DataFrame, split: Column) -> DataFrame:
    """Samples of each split and label, with the least and largest number of users."""
    n = labelled_only(nodes, labels).groupBy("cascade_idx", "label").agg(F.count_distinct("user_idx").alias("n"))
    return n.withColumn("split", split).groupBy("split", "label").agg(F.count("*").alias("samples"), F.min("n").alias("min_nodes"), F.max("n").alias("max_nodes"))


def numbers(columns: list[str]) -> Column:
    """The columns as one array of doubles; null counts 0."""
    return F.array(*(F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in columns))


def pack_windows(features: DataFrame, columns: list[str]) -> DataFrame:
    """(cascade_idx, window_idx, t, x): the windows of each cascade in order, t from 0, x its columns. A cascade has few."""
    by = Window.partitionBy("cascade_idx").orderBy("window_idx")
    return features.select("cascade_idx", "window_idx", (F.row_number().over(by) - 1).cast("long").alias("t"), numbers(columns).alias("x"))


def pack_places(nodes: DataFrame, windows: DataFrame) -> DataFrame:
    """(cascade_idx, window_idx, t, user_idx, local_idx): every window of ``pack_windows`` of every user. Users are numbered
    by range partitions, so that no task orders a whole cascade; a cascade of one side alone has no places."""
    users = ranking.ranked(nodes.select("cascade_idx", "user_idx").distinct(), ["cascade_idx"], ["user_idx"], "local_idx")
    return users.join(windows.select("cascade_idx", "window_idx", "t"), "cascade_idx").select("cascade_idx", "window_idx", "t", "user_idx", F.col("local_idx").cast("long").alias("local_idx"))


def aligned(places: DataFrame, rows: DataFrame, keys: list[str], vector: str, width: int, name: str) -> DataFrame:
    """``places`` with the vector of the row of the same keys as ``name``, zeros where there is none, and <name>_mask.

    ``rows`` has one row a key at most; a vector of another width is an error that the query reports.
    """
    held = F.col(name).isNotNull()
    fits = F.when(F.size(name) == width, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} is not {width} wide")).cast("array<double>"))
    x = places.join(rows.select(*keys, F.col(vector).cast("array<double>").alias(name)), keys, "left")
    return x.withColumn(f"{name}_mask", held.cast("int")).withColumn(name, F.when(held, fits).otherwise(F.array_repeat(F.lit(0.0), width)))


def pack_nodes(features: DataFrame, windows: DataFrame, columns: list[str]) -> DataFrame:
    """(cascade_idx, window_idx, t, user_idx, local_idx, x, x_mask): the node tensor in long form, zeros where a user is not
    seen yet. One row holds one node, so a cascade of any size is many rows."""
    rows = features.select("cascade_idx", "window_idx", "user_idx", numbers(columns).alias("x"))
    return aligned(pack_places(features, windows), rows, ["cascade_idx", "window_idx", "user_idx"], "x", len(columns), "x")


def pack_users(nodes: DataFrame, windows: DataFrame) -> DataFrame:
    """(cascade_idx, user_idx, local_idx, x_mask): one row for all rows of a user in ``pack_nodes``, x_mask 1 where any of them
    holds a row of ``nodes``. Neither vectors nor windows are rows here; it serves ``pack_report`` in place of the tensor."""
    own = nodes.groupBy("cascade_idx", "user_idx").agg(F.collect_set("window_idx").alias("own"))
    panes = windows.groupBy("cascade_idx").agg(F.collect_set("window_idx").alias("panes"))
    x = own.join(panes, "cascade_idx").select("cascade_idx", "user_idx", F.arrays_overlap("own", "panes").cast("int").alias("x_mask"))
    return ranking.ranked(x, ["cascade_idx"], ["user_idx"], "local_idx").select("cascade_idx", "user_idx", "local_idx", "x_mask")


def sample_candidates(candidates: DataFrame, places: DataFrame, weight: str | None = None) -> DataFrame:
    """(cascade_idx, src_local, dst_local, weight): candidates by the places of their users in the sample, each pair once with
    the weight of its first row by the candidates' own places; loops go.

    A user whom the sample lacks keeps its place among the candidates, which may lie outside the sample; ``pack_report``
    counts those. ``places`` (cascade_idx, user_idx, local_idx) has one row a user.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = candidates.withColumn("w", F.coalesce(w, F.lit(0.0)))
    for side in ("src", "dst"):
        own = places.select("cascade_idx", F.col("user_idx").alias(side), F.col("local_idx").alias(f"{side}_own"))
        x = x.join(own, ["cascade_idx", side], "left")
    ends = [F.coalesce(f"{side}_own", f"{side}_local").alias(f"{side}_at") for side in ("src", "dst")]
    x = x.select("cascade_idx", *ends, "w", F.struct("src_local", "dst_local").alias("first")).where("src_at <> dst_at")
    return x.groupBy("cascade_idx", F.col("src_at").alias("src_local"), F.col("dst_at").alias("dst_local")).agg(F.min_by("w", "first").alias("weight"))


def pack_report(windows: DataFrame, nodes: DataFrame, edges: DataFrame, candidates: DataFrame, texts: DataFrame, labels: DataFrame, split: Column) -> DataFrame:
    """Per split and label: samples, least and largest numbers of windows and users, samples without a visible user, with
    candidates and with text vectors, candidates, and edges of either kind whose ends are no users of the sample.

    A sample is a cascade with label 0 or 1, windows and nodes. ``windows`` and ``nodes`` come from ``pack_windows`` and
    ``pack_nodes`` or ``pack_users``, ``texts`` has a row for each vector.
    """
    seen = windows.groupBy("cascade_idx").agg(F.count("*").alias("t"))
    users = nodes.groupBy("cascade_idx").agg((F.max("local_idx") + 1).alias("n"), F.max("x_mask").alias("any"))
    samples = labels.where("label >= 0").select("cascade_idx", "label").distinct().join(seen, "cascade_idx").join(users, "cascade_idx")

    def outside(rows: DataFrame, name: str) -> DataFrame:
        x = rows.select("cascade_idx", "src_local", "dst_local").join(users.select("cascade_idx", "n"), "cascade_idx")
        return x.groupBy("cascade_idx").agg(F.count("*").alias(name), F.count_if((F.least("src_local", "dst_local") < 0) | (F.greatest("src_local", "dst_local") >= F.col("n"))).alias(f"{name}_outside"))

    for more in (outside(edges, "edges"), outside(candidates, "candidates"), texts.groupBy("cascade_idx").agg(F.count("*").alias("texts"))):
        samples = samples.join(more, "cascade_idx", "left")
    samples = samples.na.fill(0).withColumn("split", split)
    return samples.groupBy("split", "label").agg(
        F.count("*").alias("samples"), F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.min("n").alias("min_nodes"), F.max("n").alias("max_nodes"), F.count_if(F.col("any") == 0).alias("empty_node_mask"), F.sum("edges_outside").alias("edge_alignment_errors"),
        F.count_if(F.col("candidates") > 0).alias("samples_with_candidates"), F.sum("candidates").alias("candidates"), F.sum("candidates_outside").alias("candidate_alignment_errors"), F.count_if(F.col("texts") > 0).alias("samples_with_texts"),
    )


def stabilised(value: Column) -> Column:
    """sign(x) log(1 + |x|), with 0 for NaN and a million for the infinite."""
    x = F.when(F.isnan(value), 0.0).when(F.abs(value) == float("inf"), F.signum(value) * 1e6).otherwise(value)
    return F.signum(x) * F.log(1 + F.abs(x))


def positive_weight(labels: DataFrame) -> DataFrame:
    """Negatives by positives (1 without positives), and the root of it."""
    n = labels.agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    w = F.when(F.col("positive") > 0, F.col("negative") / F.col("positive")).otherwise(1.0)
    return n.select("positive", "negative", F.round(w, 6).alias("weight"), F.round(F.sqrt(w), 6).alias("root_weight"))


def edge_stats(candidates: DataFrame) -> DataFrame:
    """Per cascade and user over candidate edges without self loops: edges in and out, different neighbours, and neighbours
    linked both ways."""
    e = candidates.where("src <> dst").select("cascade_idx", "src", "dst")
    ends = e.select("cascade_idx", F.col("src").alias("user_idx"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.unionByName(e.select("cascade_idx", F.col("dst").alias("user_idx"), F.col("src").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    pair = ends.groupBy("cascade_idx", "user_idx", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return pair.groupBy("cascade_idx", "user_idx").agg(F.sum("i").alias("edges_in"), F.sum("o").alias("edges_out"), F.count("*").alias("neighbours"), F.count_if((F.col("o") > 0) & (F.col("i") > 0)).alias("reciprocal"))

"""Splits, size buckets and rank-based weak labels of cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propagon.operators import ranking
from propagon.sources.shared import written


def split_of(cascade: Column) -> Column:
    """70 / 15 / 15 by the first eight hex digits of the id's md5, modulo 100."""
    x = F.conv(F.substring(F.md5(cascade.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return F.when(x < 70, "train").when(x < 85, "valid").otherwise("test")


def event_size_bucket(n: Column) -> Column:
    return F.when(n < 8, "<8").when(n < 20, "8-20").when(n < 50, "20-50").when(n < 100, "50-100").when(n < 300, "100-300").otherwise("300+")


#: Weights of the five component scores.
WEIGHTS = {"burst": 0.25, "text_repetition": 0.20, "coordination": 0.20, "structure_concentration": 0.20, "persistence": 0.15}


def components(windows: DataFrame, nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Burst, repetition, coordination, concentration and persistence of every cascade, as the score label takes them."""
    w = windows.groupBy("cascade_idx").agg(F.max(F.greatest("delta_heat", F.lit(0))).alias("max_delta"), F.max("num_retweets_cur").alias("max_heat"), F.sum("num_retweets_cur").alias("retweets"), F.count_if(F.col("num_retweets_cur") > 0).alias("active"), F.count("*").alias("windows"))
    x = nodes.join(stats.select("cascade_idx", "window_idx", "user_idx", "num_texts_visible"), ["cascade_idx", "window_idx", "user_idx"], "left").na.fill(0)
    degree = F.col("in_degree_cum") + F.col("out_degree_cum")
    n = x.groupBy("cascade_idx").agg(F.max("num_posts_cum").alias("top_posts"), F.sum("num_texts_visible").alias("texts"), F.max(degree).alias("top_degree"), F.sum(degree).alias("degrees"), F.count("*").alias("node_rows"))
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    x = w.join(n, "cascade_idx", "left").na.fill(0)
    raw = {"burst": (F.col("max_delta") + F.col("max_heat")).cast("double"), "text_repetition": F.col("top_posts") / one("retweets"), "coordination": F.col("texts") / one("node_rows"), "structure_concentration": F.col("top_degree") / one("degrees"), "persistence": F.col("active") / one("windows")}
    return x.select("cascade_idx", *(v.alias(k) for k, v in raw.items()))


def score_rank_labels(parts: DataFrame) -> DataFrame:
    """Min-max scores, weighted and rounded to eight digits; the lower half is 0, the top fifth 1, between them -1. Confidence
    falls with the distance from the end of the ranking. Ranks are counted in pieces, so no task orders all rows."""
    bounds = parts.agg(*(f(k).alias(f"{k}_{f.__name__}") for k in WEIGHTS for f in (F.min, F.max)))
    x = parts.crossJoin(bounds)
    total = None
    for k, weight in WEIGHTS.items():
        span = F.col(f"{k}_max") - F.col(f"{k}_min")
        part = weight * F.when(span > 0, (F.col(k) - F.col(f"{k}_min")) / span).otherwise(0.0)
        total = part if total is None else total + part
    r = bucket_ranks(x.select("cascade_idx", F.lit("all").alias("bucket"), F.round(total, 8).alias("weak_score")), ("weak_score",))
    rank, low, high = F.col("weak_score_rank"), F.floor(0.5 * F.col("n")), F.floor(0.8 * F.col("n"))
    label = F.when(rank < low, 0).when(rank >= high, 1).otherwise(-1)
    sure = F.when(rank < low, 1 - rank / F.greatest(low, F.lit(1))).when(rank >= high, (rank - high + 1) / F.greatest(F.col("n") - high, F.lit(1))).otherwise(0.0)
    return r.select("cascade_idx", "weak_score", rank.cast("long").alias("rank"), label.alias("weak_label"), F.round(sure, 8).alias("label_confidence"), split_of(F.col("cascade_idx")).alias("split"))


def bucket_percentiles(rows: DataFrame, value: str, bucket: str, id_col: str = "cascade_idx") -> DataFrame:
    """Place within the bucket, 0 to 1, ties by id; 1 in a bucket of one."""
    w = Window.partitionBy(bucket)
    r = rows.withColumn("rn", F.row_number().over(w.orderBy(value, id_col))).withColumn("n", F.count("*").over(w))
    return r.select(id_col, bucket, value, F.round(F.when(F.col("n") > 1, (F.col("rn") - 1) / (F.col("n") - 1)).otherwise(1.0), 6).alias("percentile"))


#: The raw scores of a cascade that are ranked within size buckets.
RAW = ("burst", "coordination", "structure", "text", "temporal_sync", "follow_density", "natural_spread")
#: Added before rounding, so that a decimal half goes up whatever the last bit of its double is.
HALF_UP = 1e-11


def event_features(cascades: DataFrame, windows: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Seven raw scores per cascade with its size bucket and the counts that the network label takes.

    ``nodes`` are ``node_windows`` with num_texts_visible, and with text_score by cascade and user, null where there is none. A
    cascade without windows, users or follow candidates counts 0 for them.
    """
    heat = F.col("num_retweets_cur")
    w = windows.groupBy("cascade_idx").agg(F.sum("num_active_users_cur").alias("active_users"), F.max(heat).alias("max_heat"), F.max(F.greatest("delta_heat", F.lit(0))).alias("max_delta"), F.count_if(heat > 0).alias("active_windows"))
    x = nodes.na.fill(0)
    seen = F.when((F.col("num_posts_cum") > 0) | (F.col("num_texts_visible") > 0), F.col("first_seen_time"))
    cum, ctx = (F.col(f"in_degree_{s}") + F.col(f"out_degree_{s}") for s in ("cum", "ctx"))
    n = x.groupBy("cascade_idx").agg(
        F.count("*").alias("node_rows"), F.count_distinct("user_idx").alias("users"), F.max("num_posts_cum").alias("top_posts"), F.sum("num_texts_visible").alias("texts"), F.round(F.sum("text_score") + HALF_UP, 6).alias("text_sum"),
        F.max(cum).alias("top_degree"), F.sum(cum).alias("degrees"), F.sum(ctx).alias("degrees_ctx"), F.stddev_pop(seen).alias("seen_std"), (F.max(seen) - F.min(seen)).alias("seen_span"),
    )
    f = candidates.groupBy("cascade_idx").agg(F.count("*").alias("candidates"))
    c = cascades.select("cascade_idx", F.col("observed_retweet_count").alias("observed"), F.col("observed_duration"))
    r = c.join(w, "cascade_idx", "left").join(n, "cascade_idx", "left").join(f, "cascade_idx", "left").na.fill(0)
    one = lambda k: F.greatest(F.col(k), F.lit(1))
    share = F.col("max_heat") / (F.col("observed") + 1)
    coordination = F.col("active_users") / (F.col("active_windows") + 1) + one("users") / F.log(1 + one("observed_duration"))
    structure = F.col("top_degree") / one("degrees") + F.col("degrees_ctx") / one("node_rows") + F.col("candidates") / (one("users") * one("users"))
    raw = {
        "burst": F.col("max_delta") + F.col("max_heat") + share,
        "coordination": coordination,
        "structure": structure,
        "text": F.col("text_sum") / one("node_rows") + F.col("texts") / one("node_rows") + F.col("top_posts") / (F.col("observed") + 1),
        "temporal_sync": 1 / (F.col("seen_std") + 1) + share,
        "follow_density": F.col("candidates") / (one("users") * F.greatest(one("users") - 1, F.lit(1))),
        "natural_spread": F.log(1 + F.col("observed")) + F.col("seen_span") / 1800 - coordination - structure,
    }
    return r.select("cascade_idx", event_size_bucket(F.col("observed")).alias("bucket"), *(F.round(v.cast("double") + HALF_UP, 8).alias(k) for k, v in raw.items()), "users", "candidates", F.col("max_heat").alias("top_window"), "text_sum", "degrees_ctx")


def bucket_ranks(rows: DataFrame, names: tuple[str, ...], id_col: str = "cascade_idx") -> DataFrame:
    """``rows``, of unique ids, with n, the rows of the bucket, and the 0-based rank of each named value in it, ties by id.

    Range partitions by value and id are numbered alone, so neither a bucket with most rows nor a value that all rows share
    makes a task large. The rows are read several times and therefore written first.
    """
    kept = written(rows, "scored")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value")) for k in names))).alias("x")
    flat = kept.select(id_col, "bucket", each).select(id_col, "bucket", "x.*")
    placed = ranking.ranked(flat, ["bucket", "name"], ["value", id_col], "rank")
    wide = placed.groupBy(id_col).agg(*(F.max(F.when(F.col("name") == k, F.col("rank"))).alias(f"{k}_rank") for k in names))
    sizes = kept.groupBy("bucket").agg(F.count("*").alias("n"))  # a row a bucket
    return kept.join(wide, id_col).join(F.broadcast(sizes), "bucket")


def percentile_scores(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``rows`` with {name}_score: the place within the size bucket, 0 to 1; 1 in a bucket of one."""
    r = bucket_ranks(rows, names)
    return r.withColumns({f"{k}_score": F.round(F.when(F.col("n") > 1, F.col(f"{k}_rank") / (F.col("n") - 1)).otherwise(1.0), 8) for k in names}).drop("n", *(f"{k}_rank" for k in names))


def with_quantiles(rows: DataFrame, wanted: dict[str, tuple[float, ...]]) -> DataFrame:
    """``rows`` with {name}_q{percent}: linear quantiles of the named values within the size bucket."""
    r = bucket_ranks(rows, tuple(wanted))
    found = []
    for k, qs in wanted.items():
        for q in qs:
            pos = F.lit(q) * (F.col("n") - 1)
            low = F.max(F.when(F.col(f"{k}_rank") == F.floor(pos), F.col(k)))
            high = F.max(F.when(F.col(f"{k}_rank") == F.ceil(pos), F.col(k)))
            found.append(F.round(low + (high - low) * F.max(pos - F.floor(pos)), 8).alias(f"{k}_q{round(q * 100)}"))
    return rows.join(F.broadcast(r.groupBy("bucket").agg(*found)), "bucket")


def _weighted(weights: dict[str, float]) -> Column:
    total = None
    for k, w in weights.items():
        total = F.col(k) * w if total is None else total + F.col(k) * w
    return F.round(total, 8)


def stratified_labels(scored: DataFrame) -> DataFrame:
    """Label by a weighted score within the size bucket and the number of scores of 0.8 or more."""
    hits = sum((F.col(f"{k}_score") >= 0.8).cast("int") for k in RAW[:4])
    x = scored.withColumn("weak_score", _weighted({"burst_score": 0.25, "coordination_score": 0.3, "structure_score": 0.25, "text_score": 0.2})).withColumn("hits", hits)
    x = with_quantiles(x, {"weak_score": (0.5, 0.8)})
    s = F.col("weak_score")
    label = F.when(F.col("bucket") == "<8", -1).when((s >= F.col("weak_score_q80")) & (F.col("hits") >= 2), 1).when((s <= F.col("weak_score_q50")) & (F.col("hits") <= 1), 0).otherwise(-1)
    return x.select("cascade_idx", "bucket", "weak_score", "hits", label.alias("label"), F.round(F.least(F.abs(s - 0.5) * (1 + F.col("hits") / 4), F.lit(1.0)), 6).alias("confidence"))


def votes(scored: DataFrame) -> DataFrame:
    """Eight rules on the scores: 1 for coordinated, 0 for natural, -1 where a rule abstains."""
    s = {k: F.col(f"{k}_score") for k in RAW}
    yes = {f"lf_{k}": s[k] >= 0.8 for k in ("burst", "temporal_sync", "structure", "text", "follow_density")}
    no = {"lf_natural": (s["natural_spread"] >= 0.7) & (s["coordination"] <= 0.5), "lf_low_coordination": (s["coordination"] <= 0.3) & (s["burst"] <= 0.7), "lf_low_structure": (s["structure"] <= 0.3) & (s["follow_density"] <= 0.4)}
    rules = {k: F.when(v, 1).otherwise(-1) for k, v in yes.items()} | {k: F.when(v, 0).otherwise(-1) for k, v in no.items()}
    x = scored.withColumns(rules)
    pos, neg = (sum((F.col(k) == v).cast("int") for k in rules) for v in (1, 0))
    return x.withColumn("pos", pos).withColumn("neg", neg)


def vote_labels(voted: DataFrame, score: DataFrame) -> DataFrame:
    """Label by votes; ``score`` has weak_score of the stratified label, whose quantiles bound it."""
    x = with_quantiles(voted.join(score.select("cascade_idx", "weak_score"), "cascade_idx"), {"weak_score": (0.5, 0.8)})
    pos, neg = F.col("pos"), F.col("neg")
    conf = F.when(pos + neg > 0, F.greatest(pos, neg) / (pos + neg)).otherwise(0.0)
    big = F.col("bucket") != "<8"
    label = F.when(big & (pos >= 2) & (conf >= 0.6) & (F.col("weak_score") >= F.col("weak_score_q80")), 1).when(big & (neg >= 2) & (pos == 0) & (F.col("weak_score") <= F.col("weak_score_q50")), 0).otherwise(-1)
    return x.select("cascade_idx", "pos", "neg", label.alias("label"), F.round(conf, 6).alias("confidence"))


def network_labels(scored: DataFrame) -> DataFrame:
    """Label by the density, largest component and clustering of a network that is estimated from counts.

    The scores of timing and text are not known where this label is made; both count 0, so their places follow the id.
    """
    n, one = F.col("users"), F.lit(1)
    temporal, text, structure = F.greatest(F.col("top_window") - 1, F.lit(0)), F.floor("text_sum"), F.col("degrees_ctx")
    total = F.col("candidates") + temporal + text + structure
    x = scored.withColumn("edges", total)
    e = F.col("edges")
    raw = {"density": e / F.greatest(n * F.greatest(n - 1, one), one), "largest": F.when(n > 0, F.least(F.lit(1.0), (F.sqrt(e) + 1) / n)).otherwise(0.0), "clustering": F.least(F.lit(1.0), (structure + text) / (e + 1)), "follow_ratio": F.col("candidates") / (e + 1)}
    x = x.withColumns({k: F.round(v, 8) for k, v in raw.items()})
    x = x.withColumn("sync", F.lit(0.0)).withColumn("alike", F.lit(0.0))
    x = percentile_scores(x, ("density", "largest", "clustering", "sync", "alike", "follow_ratio"))
    x = x.withColumn("network", _weighted({"density_score": 0.25, "largest_score": 0.25, "clustering_score": 0.15, "sync_score": 0.15, "alike_score": 0.1, "follow_ratio_score": 0.1}))
    x = with_quantiles(x, {"network": (0.4, 0.8), "largest_score": (0.4, 0.7), "density_score": (0.4, 0.7)})
    high = (F.col("network") >= F.col("network_q80")) & (F.col("largest_score") >= F.col("largest_score_q70")) & (F.col("density_score") >= F.col("density_score_q70"))
    low = (F.col("network") <= F.col("network_q40")) & (F.col("largest_score") <= F.col("largest_score_q40")) & (F.col("density_score") <= F.col("density_score_q40"))
    big = F.col("bucket") != "<8"
    return x.select("cascade_idx", F.col("edges").cast("long").alias("edges"), "network", F.when(big & high, 1).when(big & low, 0).otherwise(-1).alias("label"), F.round(F.least(F.lit(1.0), 2 * F.abs(F.col("network") - 0.5)) + HALF_UP, 6).alias("confidence"))


def consensus_labels(*versions: DataFrame) -> DataFrame:
    """Cascades of all versions: 1 or 0 where two or more say so and none says the other, else -1."""
    x = versions[0].select("cascade_idx", F.col("label").alias("l0"))
    for i, v in enumerate(versions[1:], 1):
        x = x.join(v.select("cascade_idx", F.col("label").alias(f"l{i}")), "cascade_idx")
    names = [f"l{i}" for i in range(len(versions))]
    x = x.withColumns({k: sum((F.col(c) == v).cast("int") for c in names) for k, v in (("pos", 1), ("neg", 0))})
    yes, no = (F.col("pos") >= 2) & (F.col("neg") == 0), (F.col("neg") >= 2) & (F.col("pos") == 0)
    conf = F.when(yes, F.col("pos")).when(no, F.col("neg")).otherwise(F.greatest("pos", "neg")) / len(versions)
    clash = ~(yes | no) & (F.col("pos") > 0) & (F.col("neg") > 0)
    return x.select("cascade_idx", "pos", "neg", F.when(yes, 1).when(no, 0).otherwise(-1).alias("label"), F.round(conf, 6).alias("confidence"), clash.cast("int").alias("conflict"))


def label_counts(labels: DataFrame, by: str = "bucket") -> DataFrame:
    """Cascades of each label in each group."""
    return labels.groupBy(by).agg(*(F.count_if(F.col("label") == v).alias(k) for k, v in (("positive", 1), ("negative", 0), ("ignore", -1))))


def label_describe(labels: DataFrame, value: str) -> DataFrame:
    """Per label: rows, mean, least, middle (the upper one of two) and largest value."""
    r = bucket_ranks(labels.select("cascade_idx", F.col("label").alias("bucket"), value), (value,))
    middle = F.max(F.when(F.col(f"{value}_rank") == F.expr("n div 2"), F.col(value)))
    return r.groupBy(F.col("bucket").alias("label")).agg(F.count("*").alias("count"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), middle.alias("p50"), F.max(value).alias("max"))


def pearson(a: str, b: str) -> Column:
    """Correlation, 0 where a side does not vary."""
    return F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b)).otherwise(0.0)


def label_agreement(**versions: DataFrame) -> DataFrame:
    """(left, right, label_left, label_right, cascades): how often each two versions give each two labels."""
    x = None
    for k, v in versions.items():
        one = v.select("cascade_idx", F.col("label").alias(k))
        x = one if x is None else x.join(one, "cascade_idx")
    names = list(versions)
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).alias("label_left"), F.col(b).alias("label_right")) for i, a in enumerate(names) for b in names[i + 1 :]))).alias("x")
    return x.select(pairs).groupBy("x.left", "x.right", "x.label_left", "x.label_right").agg(F.count("*").alias("cascades"))


def label_comparison(cascades: DataFrame, **versions: DataFrame) -> DataFrame:
    """Per version: labels and their shares, correlation with the reposts observed, mean confidence, and the balance of labels
    within size buckets (the share of the rarer one, averaged over buckets with a label)."""
    every = None
    for k, v in versions.items():
        one = v.select(F.lit(k).alias("label_version"), "cascade_idx", "label", F.col("confidence").cast("double").alias("confidence"))
        every = one if every is None else every.unionByName(one)
    x = every.join(cascades.select("cascade_idx", F.col("observed_retweet_count").cast("double").alias("observed"), event_size_bucket(F.col("observed_retweet_count")).alias("bucket")), "cascade_idx").withColumn("y", F.col("label").cast("double"))
    total = F.count("*")
    of = {k: F.count_if(F.col("label") == v) for k, v in (("positive", 1), ("negative", 0), ("ignore", -1))}
    n = x.groupBy("label_version").agg(*(v.alias(k) for k, v in of.items()), *(F.round(v / total, 6).alias(f"{k}_ratio") for k, v in of.items()), F.round(pearson("observed", "y"), 6).alias("correlation"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    b = x.where("label >= 0").groupBy("label_version", "bucket").agg((F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)) / F.count("*")).alias("balance"))
    return n.join(b.groupBy("label_version").agg(F.avg("balance").alias("balance")), "label_version", "left").withColumn("balance", F.round(F.coalesce("balance", F.lit(0.0)), 6))


#: The five rules that vote 1 and the three that vote 0, in the order of ``votes``.
RULES = ("lf_burst", "lf_temporal_sync", "lf_structure", "lf_text", "lf_follow_density", "lf_natural", "lf_low_coordination", "lf_low_structure")


def rule_report(voted: DataFrame) -> DataFrame:
    """(measure, value) of ``votes``: the share of cascades on which each rule does not abstain, and the share on which rules
    contradict each other."""
    n = F.greatest(F.count("*"), F.lit(1))
    shares = {**{f"coverage_{k}": F.count_if(F.col(k) != -1) / n for k in RULES}, "conflict_rate": F.count_if((F.col("pos") > 0) & (F.col("neg") > 0)) / n}
    one = voted.agg(*(F.round(v, 6).alias(k) for k, v in shares.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in shares))))


def unified_labels(ranked: DataFrame, cascades: DataFrame, method: str = "score_rank") -> DataFrame:
    """Labels of ``score_rank_labels`` in the common form: label, split, confidence and score beside the method, the size bucket
    and the reposts of the cascade, which count 0 where ``cascades`` lacks it. A split that is empty follows the id."""
    c = cascades.select("cascade_idx", "observed_retweet_count", "final_retweet_count")
    x = ranked.join(c, "cascade_idx", "left").na.fill(0, ["observed_retweet_count", "final_retweet_count"])
    split = F.coalesce(F.nullif(F.col("split"), F.lit("")), split_of(F.col("cascade_idx")))
    return x.select("cascade_idx", F.col("weak_label").alias("label"), split.alias("split"), F.coalesce("label_confidence", F.lit(0.0)).alias("label_confidence"), F.coalesce("weak_score", F.lit(0.0)).alias("weak_score"), F.lit(method).alias("label_method"), event_size_bucket(F.col("observed_retweet_count")).alias("size_bucket"), "observed_retweet_count", "final_retweet_count")


def label_diagnostics(rows: DataFrame, least: int = 10, strong: float = 0.5) -> DataFrame:
    """(section, name, label, value) of rows in the common form: cascades and shares of each label, cascades by size bucket and
    label and by split and label, correlations of the label with reposts and score, and a warning (value: the figure) for a
    correlation of ``strong`` or more and for each bucket with fewer than ``least`` of a label.

    One aggregate by (bucket, split, label) carries counts and sums; everything else is made from those few rows.
    """
    o, s, y = F.col("observed_retweet_count").cast("double"), F.col("weak_score").cast("double"), F.col("label").cast("double")
    sums = {"n": F.count("*"), "o": F.sum(o), "s": F.sum(s), "oo": F.sum(o * o), "ss": F.sum(s * s), "oy": F.sum(o * y), "sy": F.sum(s * y), "y": F.sum(y), "yy": F.sum(y * y)}
    cells = rows.groupBy("size_bucket", "split", "label").agg(*(v.alias(k) for k, v in sums.items()))
    none, out = F.lit(None).cast("int"), []
    row = lambda df, section, name, label, value: df.select(F.lit(section).alias("section"), name.alias("name"), label.alias("label"), F.round(value.cast("double"), 6).alias("value"))
    total = cells.agg(*(F.sum(k).alias(k) for k in sums), *(F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0)).alias(f"l{i}") for i, v in enumerate((-1, 0, 1))))
    each = total.select(F.inline(F.array(*(F.struct(F.lit(v).alias("label"), F.col(f"l{i}").alias("k"), F.coalesce("n", F.lit(0)).alias("n")) for i, v in enumerate((-1, 0, 1))))))
    out += [row(each, "count", F.lit("all"), F.col("label"), F.col("k")), row(each, "ratio", F.lit("all"), F.col("label"), F.col("k") / F.greatest("n", F.lit(1)))]
    for section, key in (("by_size_bucket", "size_bucket"), ("by_split", "split")):
        out.append(row(cells.groupBy(key, "label").agg(F.sum("n").alias("k")), section, F.col(key), F.col("label"), F.col("k")))

    def corr(k: str) -> Column:
        n = F.col("n")
        vx, vy, xy = F.col(k + k) - F.col(k) * F.col(k) / n, F.col("yy") - F.col("y") * F.col("y") / n, F.col(f"{k}y") - F.col(k) * F.col("y") / n
        # a spread below the rounding of the sums is none
        return F.when((n >= 2) & (vx > 1e-9 * F.col(k + k)) & (vy > 1e-9 * F.col("yy")), xy / F.sqrt(vx * vy)).otherwise(0.0)

    both = total.select(F.inline(F.array(*(F.struct(F.lit(name).alias("name"), corr(k).alias("c")) for k, name in (("o", "observed_retweet_count"), ("s", "weak_score"))))))
    out += [row(both, "correlation", F.col("name"), none, F.col("c")), row(both.where((F.col("name") == "observed_retweet_count") & (F.abs("c") >= strong)), "warning", F.lit("observed_retweet_count_label_correlation_high"), none, F.col("c"))]
    few = cells.groupBy("size_bucket").agg(*(F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0)).alias(k) for k, v in (("positive", 1), ("negative", 0))))
    few = few.select("size_bucket", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("label"), F.col(k).alias("k")) for k, v in (("positive", 1), ("negative", 0))))))
    out.append(row(few.where(F.col("k") < least), "warning", F.concat(F.lit("few_"), F.col("kind"), F.lit("_in_bucket:"), F.col("size_bucket")), F.col("label"), F.col("k")))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every

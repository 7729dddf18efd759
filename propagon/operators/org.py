"""Base relations: cleaned posts, star edges, cascades, users, activity windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVATION, WINDOW, MIN_REPOSTS, MIN_DURATION = 1800, 300, 8, 300


def posts(raw: DataFrame) -> DataFrame:
    """Roots and the first repost of every id; an id of a root is taken."""
    roots = raw.where("is_root = 1")
    first = Window.partitionBy("tweet_idx").orderBy("event_seq")
    reposts = raw.where("is_root = 0").withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return roots.unionByName(reposts.join(roots.select("tweet_idx"), "tweet_idx", "left_anti").select(*raw.columns))


def star_edges(clean: DataFrame) -> DataFrame:
    """(cascade_idx, src, dst, src_tweet, dst_tweet, relative_time): root to each reposter."""
    roots = clean.where("is_root = 1").select("cascade_idx", F.col("user_idx").alias("src"), F.col("tweet_idx").alias("src_tweet"))
    return clean.where("is_root = 0").join(roots, "cascade_idx").select("cascade_idx", "src", F.col("user_idx").alias("dst"), "src_tweet", F.col("tweet_idx").alias("dst_tweet"), "relative_time")


def quality_counters(raw: DataFrame) -> DataFrame:
    """Rows, negative times, rows after the observation and rows dropped as duplicates."""
    n = raw.agg(F.count("*").alias("rows"), F.count_if(F.col("relative_time") < 0).alias("negative"), F.count_if(F.col("relative_time") > OBSERVATION).alias("late"), F.count_if(F.col("is_root") == 1).alias("roots"))
    return n.crossJoin(posts(raw).agg(F.count("*").alias("kept"))).select("rows", "negative", "late", "roots", (F.col("rows") - F.col("kept")).alias("duplicates"))


#: The reasons why a cascade does not train.
REASONS = ("min_retweets", "min_duration", "bad_root_user_idx", "bad_root_time_epoch")


def cascade_table(raw: DataFrame, obs: int = OBSERVATION, min_reposts: int = MIN_REPOSTS, min_duration: int = MIN_DURATION) -> DataFrame:
    """Per root: repost counts before the removal of duplicates, durations, reasons to drop it and whether it trains."""
    rel = F.col("relative_time")
    inside = rel.between(0, obs)
    seen = raw.where("is_root = 0").groupBy("cascade_idx").agg(F.count("*").alias("n"), F.count_if(inside).alias("o"), F.max(rel).alias("m"), F.max(F.when(inside, rel)).alias("d"))
    c = raw.where("is_root = 1").select("cascade_idx", F.col("tweet_idx").alias("root_tweet_idx"), F.col("user_idx").alias("root_user_idx"), F.col("time_epoch").alias("root_time_epoch")).join(seen, "cascade_idx", "left")
    none = F.lit(0).cast("long")
    c = c.select("cascade_idx", "root_tweet_idx", "root_user_idx", "root_time_epoch", F.coalesce("n", none).alias("final_retweet_count"), F.coalesce("o", none).alias("observed_retweet_count"), F.greatest(F.coalesce("m", none), none).alias("duration"), F.coalesce("d", none).alias("observed_duration"))
    fails = (F.col("observed_retweet_count") < min_reposts, F.col("observed_duration") < min_duration, F.col("root_user_idx") <= 0, F.col("root_time_epoch") <= 0)
    reason = F.concat_ws(";", *(F.when(f, name) for f, name in zip(fails, REASONS, strict=True)))
    return c.withColumn("drop_reason", reason).withColumn("valid_for_training", (F.col("drop_reason") == "").cast("int"))


def user_table(clean: DataFrame) -> DataFrame:
    """Users of positive id with their roots and reposts, duplicates removed."""
    n = clean.where("user_idx > 0").groupBy("user_idx").agg(F.count_if(F.col("is_root") == 1).alias("num_root_posts"), F.count_if(F.col("is_root") == 0).alias("num_retweets"))
    return n.select("user_idx", F.lit(1).alias("is_active_in_events"), (F.col("num_root_posts") > 0).cast("int").alias("is_root_user"), (F.col("num_retweets") > 0).cast("int").alias("is_retweet_user"), "num_root_posts", "num_retweets")


def org_window(rel: Column, obs: int = OBSERVATION, size: int = WINDOW) -> Column:
    """1-based window of a time; the last window is closed on the right, other times have none."""
    return F.when(rel == obs, -(-obs // size)).when((rel >= 0) & (rel < obs), F.floor(rel / size) + 1).cast("long")


def org_node_windows(clean: DataFrame) -> DataFrame:
    """Per cascade, window and user: posts, degrees and their running sums; the root user stands in window 1 and in every
    window with reposts."""
    edges = star_edges(clean).withColumn("window_id", org_window(F.col("relative_time"))).where("window_id is not null")
    acted = edges.select("cascade_idx", "window_id", F.col("dst").alias("user_idx"), F.lit(1).alias("p"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    spread = edges.select("cascade_idx", "window_id", F.col("src").alias("user_idx"), F.lit(0).alias("p"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    root = clean.where("is_root = 1").select("cascade_idx", F.lit(1).cast("long").alias("window_id"), "user_idx", F.lit(1).alias("p"), F.lit(0).alias("i"), F.lit(0).alias("o"))
    n = acted.unionByName(spread).unionByName(root).groupBy("cascade_idx", "window_id", "user_idx").agg(F.sum("p").alias("num_posts"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    run = Window.partitionBy("cascade_idx", "user_idx").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("in_degree_cum", F.sum("in_degree").over(run)).withColumn("out_degree_cum", F.sum("out_degree").over(run))


def distribution(values: DataFrame, column: str) -> DataFrame:
    """Least, quartiles, upper percentiles (linear), mean and largest of a column."""
    q = F.percentile(column, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)))).alias("q")
    names = ("p25", "median", "p75", "p90", "p95", "p99")
    x = values.agg(F.count(column).alias("n"), F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"), F.avg(column).alias("mean"), q)
    return x.select("n", "min", "max", F.round("mean", 6).alias("mean"), *(F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(names)))


def follow_table(follows: DataFrame, users: DataFrame) -> DataFrame:
    """Follow edges with an active endpoint, and which end is active."""
    u = users.select("user_idx").distinct()
    f = follows.join(u.select(F.col("user_idx").alias("src"), F.lit(1).alias("s")), "src", "left").join(u.select(F.col("user_idx").alias("dst"), F.lit(1).alias("d")), "dst", "left")
    return f.where("s is not null or d is not null").select("src", "dst", F.coalesce("s", F.lit(0)).alias("src_active"), F.coalesce("d", F.lit(0)).alias("dst_active"))


def dedup_lines(lines: DataFrame, key: list[str], order: str, by: str) -> DataFrame:
    """The first row of each key within a file, in file order; rows with a blank key stay."""
    w = Window.partitionBy(by, *key).orderBy(order)
    return lines.withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) | (F.trim(F.col(key[0])) == "")).drop("rn")


def valid_events(raw: DataFrame, roots: DataFrame) -> DataFrame:
    """Reposts of a known root with positive ids and time; the root comes from ``roots``."""
    known = roots.select("cascade_idx").distinct()
    return raw.where("is_root = 0 and tweet_idx > 0 and user_idx > 0 and time_epoch > 0").join(known, "cascade_idx", "left_semi")


def all_counters(raw: DataFrame, roots: DataFrame, obs: int = OBSERVATION) -> DataFrame:
    """What was wrong with the reposts of a log: unknown roots, bad ids, negative times, repeated ids, missing texts."""
    r = raw.where("is_root = 0").join(roots.select("cascade_idx", F.lit(1).alias("known")).distinct(), "cascade_idx", "left")
    known = F.col("known").isNotNull()
    bad = known & ((F.col("tweet_idx") <= 0) | (F.col("user_idx") <= 0) | (F.col("time_epoch") <= 0))
    good = known & ~bad
    n = r.agg(F.count_if(~known).alias("missing_cascade_root"), F.count_if(bad).alias("bad_event_rows"), F.count_if(bad & (F.col("user_idx") <= 0)).alias("missing_user_idx"), F.count_if(good & (F.col("relative_time") < 0)).alias("negative_relative_time"), F.count_if(good).alias("valid"))
    kept = posts(roots.unionByName(valid_events(raw, roots))).where("is_root = 0").agg(F.count("*").alias("kept"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("missing_retweet_text"))
    missing = roots.agg(F.count_if(F.coalesce("text", F.lit("")) == "").alias("missing_root_text"))
    return n.crossJoin(kept).crossJoin(missing).select("missing_cascade_root", "bad_event_rows", "missing_user_idx", "negative_relative_time", (F.col("valid") - F.col("kept")).alias("duplicate_tweet_idx"), "missing_retweet_text", "missing_root_text")


def overlapping_windows(clean: DataFrame, obs: int = OBSERVATION, size: int = 600, step: int = 300) -> DataFrame:
    """(cascade_idx, tweet_idx, window_id): every window that holds a post; windows start at each step before ``obs``, end at
    ``obs`` at the latest, and the last one is closed on the right. Only windows that hold the time are made."""
    rel, last = F.col("relative_time"), -(-obs // step)
    low = F.greatest(F.lit(1), F.floor((rel - size) / step) + 2)
    high = F.least(F.lit(last), F.floor(rel / step) + 1)
    # at the end of the observation only the closed window is left
    held = F.when(rel == obs, F.array(F.lit(last).cast("long"))).when(low <= high, F.sequence(low.cast("long"), high.cast("long")))
    return clean.where(rel.between(0, obs)).select("cascade_idx", "tweet_idx", F.explode(held).alias("window_id"))


def window_activity(clean: DataFrame) -> DataFrame:
    """Per cascade, window and user: posts, reposts, texts, first and last time; roots stand in window 1."""
    w = F.when(F.col("is_root") == 1, F.lit(1).cast("long")).otherwise(org_window(F.col("relative_time")))
    p = clean.withColumn("window_id", w).where("window_id is not null").withColumn("t", (F.coalesce("text", F.lit("")) != "").cast("int"))
    time = F.when(F.col("is_root") == 1, 0).otherwise(F.col("relative_time")).cast("long")
    return p.groupBy("cascade_idx", "window_id", "user_idx").agg(F.count("*").alias("active_count"), F.count_if(F.col("is_root") == 0).alias("retweet_count"), F.sum("t").alias("text_count"), F.min(time).alias("first_active_time"), F.max(time).alias("last_active_time"), F.max("is_root").alias("is_root"), F.max("t").alias("has_text"))


def window_sizes(activity: DataFrame) -> DataFrame:
    """Mean and median of users and reposts over windows with any."""
    n = activity.groupBy("cascade_idx", "window_id").agg(F.count("*").alias("nodes"), F.sum("retweet_count").alias("retweets"))
    return n.agg(F.count("*").alias("windows"), *(F.round(f, 6).alias(k) for k, f in (("avg_nodes", F.avg("nodes")), ("median_nodes", F.percentile("nodes", 0.5)), ("avg_retweets", F.avg("retweets")), ("median_retweets", F.percentile("retweets", 0.5)))))


def integrity(raw: DataFrame, clean: DataFrame, activity: DataFrame, obs: int = OBSERVATION, size: int = WINDOW) -> DataFrame:
    """One row of checks: positive ids, windows in range, a root of every cascade and its row in window 1."""
    ids = clean.agg(F.min((F.col("cascade_idx") > 0) & (F.col("tweet_idx") > 0) & (F.col("user_idx") > 0)).alias("all_positive"), F.count_distinct("cascade_idx").alias("cascades"), F.count_distinct(F.when(F.col("is_root") == 1, F.col("cascade_idx"))).alias("rooted"))
    rows = activity.agg(F.min(F.col("window_id").between(1, -(-obs // size))).alias("windows_in_range"), F.count_distinct(F.when((F.col("is_root") == 1) & (F.col("window_id") == 1), F.col("cascade_idx"))).alias("first"))
    return ids.crossJoin(rows).select(F.col("all_positive").cast("int").alias("all_positive"), F.col("windows_in_range").cast("int").alias("windows_in_range"), (F.col("cascades") == F.col("rooted")).cast("int").alias("roots_exist"), (F.col("cascades") == F.col("first")).cast("int").alias("roots_in_first_window"))


#: Observation, window, step, least reposts and least duration of each setting of the sweep.
SETTINGS = {"A": (1800, 300, 300, 8, 300), "B": (3600, 600, 600, 8, 600), "C": (7200, 600, 600, 10, 600), "D": (1800, 300, 300, 5, 300), "E": (3600, 600, 600, 5, 600)}


def setting_sweep(raw: DataFrame) -> DataFrame:
    """Per setting: cascades, those that train, and how many fail for each reason. One pass over the reposts serves all."""
    rel = F.col("relative_time")
    seen = raw.where("is_root = 0").groupBy("cascade_idx").agg(*(f for k, (o, *_) in SETTINGS.items() for f in (F.count_if(rel.between(0, o)).alias(f"n{k}"), F.max(F.when(rel.between(0, o), rel)).alias(f"d{k}"))))
    c = raw.where("is_root = 1").select("cascade_idx").join(seen, "cascade_idx", "left").na.fill(0)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("setting"), (F.col(f"n{k}") < m).alias("few"), (F.col(f"d{k}") < d).alias("short")) for k, (_, _, _, m, d) in SETTINGS.items()))).alias("x")
    return c.select(each).select("x.*").groupBy("setting").agg(F.count("*").alias("cascades"), F.count_if(~F.col("few") & ~F.col("short")).alias("valid"), F.count_if("few").alias("min_retweets"), F.count_if("short").alias("min_duration"))


def whole(value: Column) -> Column:
    """A text as a whole number, 0 where it is none."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("long"))


def decimal(value: Column) -> Column:
    """A text as a number, 0 where it is none, NaN or infinite."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def root_dimension(lines: DataFrame) -> DataFrame:
    """(cascade_idx, root_user_idx, root_tweet_idx, root_time_epoch) of root records; the time and the tweet come from
    root_time and tweet_idx where their own field is absent, and what is no number counts 0. A cascade twice is an error."""
    pick = lambda *names: whole(F.coalesce(*(F.col(k).cast("string") for k in names)))
    r = lines.select(pick("cascade_idx").alias("cascade_idx"), pick("root_user_idx").alias("root_user_idx"), pick("root_tweet_idx", "tweet_idx").alias("root_tweet_idx"), pick("root_time_epoch", "root_time").alias("root_time_epoch"))
    one = r.groupBy("cascade_idx").agg(F.count("*").alias("n"), *(F.first(k).alias(k) for k in ("root_user_idx", "root_tweet_idx", "root_time_epoch")))
    once = F.when(F.col("n") == 1, F.col("root_user_idx")).otherwise(F.raise_error(F.concat(F.lit("cascade twice: "), F.col("cascade_idx"))).cast("long"))
    return one.select("cascade_idx", once.alias("root_user_idx"), "root_tweet_idx", "root_time_epoch")


def full_node_windows(clean: DataFrame, obs: int = OBSERVATION, size: int = WINDOW) -> DataFrame:
    """Per cascade, window and user: bounds, posts, reposts, texts, first and last time, degrees of the window and up to it.

    The root stands in window 1 with its own post, and in every window with reposts, where it has edges but no post and so
    neither a first nor a last time. Reposts outside the observation have no window.
    """
    w = F.when(F.col("is_root") == 1, F.lit(1).cast("long")).otherwise(org_window(F.col("relative_time"), obs, size))
    text, zero, none = (F.coalesce("text", F.lit("")) != "").cast("int"), F.lit(0), F.lit(None).cast("long")
    time = F.when(F.col("is_root") == 1, 0).otherwise(F.col("relative_time")).cast("long")
    own = clean.withColumn("window_id", w).where("window_id is not null").select("cascade_idx", "window_id", "user_idx", F.lit(1).alias("a"), (1 - F.col("is_root")).alias("r"), text.alias("x"), time.alias("t"), (1 - F.col("is_root")).alias("i"), zero.alias("o"), "is_root")
    roots = clean.where("is_root = 1").select("cascade_idx", "user_idx")
    # reposts are counted before they meet their root, so a cascade brings a row a window to the join
    busy = own.where("is_root = 0").groupBy("cascade_idx", "window_id").agg(F.count("*").alias("o")).join(roots, "cascade_idx")
    spread = busy.select("cascade_idx", "window_id", "user_idx", zero.alias("a"), zero.alias("r"), zero.alias("x"), none.alias("t"), zero.alias("i"), "o", F.lit(1).alias("is_root"))
    n = own.unionByName(spread).groupBy("cascade_idx", "window_id", "user_idx").agg(F.sum("a").alias("active_count"), F.sum("r").alias("retweet_count"), F.sum("x").alias("text_count"), F.min("t").alias("first_active_time"), F.max("t").alias("last_active_time"), F.sum("i").alias("in_degree_cur"), F.sum("o").alias("out_degree_cur"), F.max("is_root").alias("is_root"), F.max("x").alias("has_text"))
    run = Window.partitionBy("cascade_idx", "user_idx").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.col("window_id") - 1) * size
    return n.withColumns({"in_degree_cum": F.sum("in_degree_cur").over(run), "out_degree_cum": F.sum("out_degree_cur").over(run), "window_start": start, "window_end": F.least(start + size, F.lit(obs))})


def follow_edges(lines: DataFrame, users: DataFrame) -> DataFrame:
    """(src, dst, weight, src_active, dst_active, both_active) of lines (src, dst, weight) with an active end.

    Ends below 1 or without a number go; a weight that is missing is 1, one that is no number too. Users are one row each, so
    no edge repeats in the joins; equal lines stay.
    """
    u = users.where("user_idx > 0").select("user_idx").distinct()
    ends = lines.select(*(whole(F.col(k)).alias(k) for k in ("src", "dst")), F.coalesce(F.col("weight").try_cast("bigint"), F.lit(1).cast("long")).alias("weight")).where("src > 0 and dst > 0")
    x = ends.join(u.select(F.col("user_idx").alias("src"), F.lit(1).alias("src_active")), "src", "left").join(u.select(F.col("user_idx").alias("dst"), F.lit(1).alias("dst_active")), "dst", "left").na.fill(0, ["src_active", "dst_active"])
    return x.where("src_active + dst_active > 0").select("src", "dst", "weight", "src_active", "dst_active", (F.col("src_active") * F.col("dst_active")).alias("both_active"))


def profiles_of(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """``users`` with profile_text, the last of the user by seq, empty without one, and has_profile; ``profiles`` (user_idx,
    profile_text, seq)."""
    p = profiles.where("user_idx > 0").groupBy("user_idx").agg(F.max_by(F.coalesce("profile_text", F.lit("")), "seq").alias("profile_text"), F.lit(1).alias("has_profile"))
    return users.join(p, "user_idx", "left").na.fill("", ["profile_text"]).na.fill(0, ["has_profile"])


def run_report(counters: DataFrame, users: DataFrame, roots: DataFrame, clean: DataFrame) -> DataFrame:
    """``all_counters`` with missing_user_profile (``users`` from ``profiles_of``) and the shares of root texts, repost texts
    and profiles that are present."""
    u = users.agg(F.count("*").alias("users"), F.count_if(F.col("has_profile") == 0).alias("missing_user_profile"))
    n = counters.crossJoin(u).crossJoin(roots.agg(F.count("*").alias("roots"))).crossJoin(clean.where("is_root = 0").agg(F.count("*").alias("reposts")))  # one row each
    share = lambda miss, of: F.round(1 - F.col(miss) / F.greatest(F.col(of), F.lit(1)), 6)
    return n.select(*counters.columns, "missing_user_profile", share("missing_root_text", "roots").alias("root_text_coverage"), share("missing_retweet_text", "reposts").alias("retweet_text_coverage"), share("missing_user_profile", "users").alias("user_profile_coverage"))

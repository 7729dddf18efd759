"""When reposts come: bins, thresholds, size buckets, lists of cascades for development."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the time bins in seconds, cumulative thresholds, observation sweep, size buckets.
BINS = (300, 600, 900, 1200, 1500, 1800, 3600, 7200, 21600, 86400, 604800, 2592000)
CUMULATIVE = {"30m": 1800, "1h": 3600, "2h": 7200, "6h": 21600, "24h": 86400}
SWEEP = ((1800, 5), (1800, 8), (3600, 5), (3600, 8), (7200, 8), (7200, 10), (21600, 10), (86400, 10))
SIZES = ((10, "0-10"), (50, "11-50"), (100, "51-100"), (500, "101-500"), (1000, "501-1000"), (5000, "1001-5000"))
LISTS = {"A": ("30m", 8), "B": ("1h", 8), "C": ("2h", 10)}


def time_bin(rel: Column) -> Column:
    """1-based bin; a bound belongs to the bin that it ends, 0 to the first."""
    out = F.when(rel <= BINS[0], 1)
    for i, b in enumerate(BINS[1:], 2):
        out = out.when(rel <= b, i)
    return out.otherwise(len(BINS) + 1)


def size_bucket(n: Column) -> Column:
    out = F.when(n <= SIZES[0][0], SIZES[0][1])
    for b, name in SIZES[1:]:
        out = out.when(n <= b, name)
    return out.otherwise("5001+")


def cascade_times(raw: DataFrame) -> DataFrame:
    """Per cascade: reposts in all, up to each threshold, their share, and whether it passes the usual minima."""
    r = raw.where("is_root = 0 and relative_time >= 0")
    n = r.groupBy("cascade_idx").agg(F.count("*").alias("total"), *(F.count_if(F.col("relative_time") <= s).alias(f"cum_{k}") for k, s in CUMULATIVE.items()), *(F.count_if(time_bin(F.col("relative_time")) == i).alias(f"bin_{i}") for i in range(1, 8)))
    c = raw.where("is_root = 1").select("cascade_idx").join(n, "cascade_idx", "left").na.fill(0)
    share = {f"ratio_{k}": F.round(F.when(F.col("total") > 0, F.col(f"cum_{k}") / F.col("total")).otherwise(0.0), 6) for k in CUMULATIVE}
    return c.withColumns(share).withColumns({"pass_30m_8": (F.col("cum_30m") >= 8).cast("int"), "pass_2h_10": (F.col("cum_2h") >= 10).cast("int"), "size_bucket": size_bucket(F.col("total"))})


def bin_summary(raw: DataFrame) -> DataFrame:
    """Per bin: reposts, share of all and cascades; bins without reposts count 0."""
    spark = raw.sparkSession
    r = raw.where("is_root = 0 and relative_time >= 0").withColumn("bin", time_bin(F.col("relative_time")).cast("long"))
    n = r.groupBy("bin").agg(F.count("*").alias("retweets"), F.count_distinct("cascade_idx").alias("cascades"))
    every = spark.range(1, len(BINS) + 2).withColumnRenamed("id", "bin")
    out = every.join(n, "bin", "left").na.fill(0)
    return out.crossJoin(n.agg(F.sum("retweets").alias("t"))).select("bin", "retweets", "cascades", F.round(F.col("retweets") / F.col("t"), 6).alias("ratio"))


def size_by_bin(raw: DataFrame) -> DataFrame:
    """Reposts per size bucket and bin, with a row for every combination."""
    r = raw.where("is_root = 0 and relative_time >= 0").withColumn("bin", time_bin(F.col("relative_time")).cast("long"))
    sizes = cascade_times(raw).select("cascade_idx", "size_bucket")
    n = r.join(sizes, "cascade_idx").groupBy("size_bucket", "bin").agg(F.count("*").alias("retweets"))
    names = [b for _, b in SIZES] + ["5001+"]
    every = raw.sparkSession.range(1, len(BINS) + 2).select(F.col("id").alias("bin"), F.explode(F.array(*map(F.lit, names))).alias("size_bucket"))
    return every.join(n, ["size_bucket", "bin"], "left").na.fill(0)


def observation_sweep(raw: DataFrame) -> DataFrame:
    """Per observation and minimum: cascades that pass and their share; mean and median of the reposts and durations observed,
    over all cascades."""
    r = raw.where("is_root = 0 and relative_time >= 0")
    t, every = F.col("relative_time"), sorted({o for o, _ in SWEEP})
    n = r.groupBy("cascade_idx").agg(*(F.count_if(t <= o).alias(f"n{o}") for o in every), *(F.max(F.when(t <= o, t)).alias(f"d{o}") for o in every))
    c = raw.where("is_root = 1").select("cascade_idx").join(n, "cascade_idx", "left").na.fill(0)
    combos = F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("obs_seconds"), F.lit(m).cast("long").alias("min_retweets"), F.col(f"n{o}").alias("n"), F.col(f"d{o}").alias("d")) for o, m in SWEEP))).alias("x")
    x = c.select(combos).select("x.*").groupBy("obs_seconds", "min_retweets")
    ok = F.col("n") >= F.col("min_retweets")
    return x.agg(F.count_if(ok).alias("num_pass_cascades"), F.round(F.count_if(ok) / F.count("*"), 6).alias("pass_ratio"), F.round(F.avg("n"), 6).alias("avg_observed_retweets"), F.round(F.percentile("n", 0.5), 6).alias("median_observed_retweets"), F.round(F.avg("d"), 6).alias("avg_observed_duration"), F.round(F.percentile("d", 0.5), 6).alias("median_observed_duration"))


def largest_cascade(raw: DataFrame) -> DataFrame:
    return cascade_times(raw).agg(F.max(F.struct("total", (-F.col("cascade_idx")).alias("i"))).alias("m")).select((-F.col("m.i")).alias("cascade_idx"), F.col("m.total").alias("total"))


def dev_lists(raw: DataFrame) -> DataFrame:
    """Cascades of each development list."""
    c = cascade_times(raw)
    pick = F.explode(F.filter(F.array(*(F.when(F.col(f"cum_{k}") >= m, F.lit(name)) for name, (k, m) in LISTS.items())), lambda x: x.isNotNull())).alias("list")
    return c.select(pick, "cascade_idx", "total")


def dev_summary(raw: DataFrame) -> DataFrame:
    return dev_lists(raw).groupBy("list").agg(F.count("*").alias("cascades"), F.round(F.avg("total"), 6).alias("mean_total"), F.round(F.percentile("total", 0.5), 6).alias("median_total"))


#: Names of the time bins and the columns that say which cascades pass, with threshold and minimum.
BIN_NAMES = ("0_5m", "5_10m", "10_15m", "15_20m", "20_25m", "25_30m", "30_60m", "1_2h", "2_6h", "6_24h", "1_7d", "7_30d", "gt_30d")
PASSES = {"pass_30m_min5": ("30m", 5), "pass_30m_min8": ("30m", 8), "pass_1h_min5": ("1h", 5), "pass_1h_min8": ("1h", 8), "pass_2h_min8": ("2h", 8), "pass_2h_min10": ("2h", 10)}
DEV_LISTS = {"dev_A_30m_min8_cascades": ("30m", 8), "dev_B_1h_min8_cascades": ("1h", 8), "dev_C_2h_min10_cascades": ("2h", 10)}


def _share(part: Column, of: Column) -> Column:
    return F.round(F.when(of > 0, part / of).otherwise(0.0), 6)


def cascade_bins(raw: DataFrame) -> DataFrame:
    """Per cascade: reposts, the last one's time, reposts of every bin and up to each threshold with their share, and which
    minima it passes. A cascade without reposts has a row of zeros; negative times do not count."""
    rel = F.col("relative_time")
    r = raw.where("is_root = 0 and relative_time >= 0").select("cascade_idx", "relative_time", time_bin(rel).alias("bin"))
    n = r.groupBy("cascade_idx").agg(F.count("*").alias("total_retweets"), F.max(rel).alias("duration"), *(F.count_if(F.col("bin") == i).alias(f"bin_{k}") for i, k in enumerate(BIN_NAMES, 1)), *(F.count_if(rel <= s).alias(f"cum_{k}") for k, s in CUMULATIVE.items()))
    c = raw.where("is_root = 1").select("cascade_idx").distinct().join(n, "cascade_idx", "left").na.fill(0)
    c = c.withColumns({f"ratio_{k}": _share(F.col(f"cum_{k}"), F.col("total_retweets")) for k in CUMULATIVE})
    return c.withColumns({k: (F.col(f"cum_{t}") >= m).cast("int") for k, (t, m) in PASSES.items()})


def bin_report(bins: DataFrame, by_size: bool = False) -> DataFrame:
    """Reposts of each bin and the cascades with any, both also as shares, of rows of ``cascade_bins``; with ``by_size`` within
    each size bucket, whose empty ones stay, beside its cascades and reposts.

    The bins of a cascade are columns, so one pass over the cascades serves all of them.
    """
    keys = ["size_bucket"] if by_size else []
    x = bins.withColumn("size_bucket", size_bucket(F.col("total_retweets")))
    n = x.groupBy(*keys).agg(F.count("*").alias("num_cascades"), F.coalesce(F.sum("total_retweets"), F.lit(0)).alias("total_retweets"), *(f for k in BIN_NAMES for f in (F.coalesce(F.sum(f"bin_{k}"), F.lit(0)).alias(f"n_{k}"), F.count_if(F.col(f"bin_{k}") > 0).alias(f"c_{k}"))))
    if by_size:
        names = [b for _, b in SIZES] + ["5001+"]
        n = bins.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("size_bucket")).join(n, "size_bucket", "left").na.fill(0)
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("time_bin"), F.col(f"n_{k}").alias("retweet_count"), F.col(f"c_{k}").alias("cascade_count_with_retweet")) for k in BIN_NAMES)))
    x = n.select(*keys, "num_cascades", "total_retweets", each)
    return x.withColumns({"retweet_ratio": _share(F.col("retweet_count"), F.col("total_retweets")), "cascade_ratio_with_retweet": _share(F.col("cascade_count_with_retweet"), F.col("num_cascades"))})


def dev_report(bins: DataFrame) -> DataFrame:
    """Per development list: its cascades, mean and median of their reposts in all and observed, and of the share observed;
    a list without cascades has zeros."""
    picked = F.inline(F.array(*(F.struct(F.lit(name).alias("list_name"), F.lit(CUMULATIVE[k]).cast("long").alias("obs_seconds"), F.lit(m).cast("long").alias("min_retweets"), F.when(F.col(f"cum_{k}") >= m, F.col("total_retweets")).alias("total_retweets"), F.when(F.col(f"cum_{k}") >= m, F.col(f"cum_{k}")).alias("cum_obs"), F.when(F.col(f"cum_{k}") >= m, F.col(f"ratio_{k}")).alias("ratio_obs")) for name, (k, m) in DEV_LISTS.items())))
    measures = {f"{f}_{k}": F.round(F.coalesce(g(k), F.lit(0.0)), 6) for k in ("total_retweets", "cum_obs", "ratio_obs") for f, g in (("avg", F.avg), ("median", lambda k: F.percentile(k, 0.5)))}
    return bins.select(picked).groupBy("list_name", "obs_seconds", "min_retweets").agg(F.count("total_retweets").alias("num_cascades"), *(v.alias(k) for k, v in measures.items()))

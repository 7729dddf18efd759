"""Cascades from the driver's tables: one deterministic reading of ``events`` as reposts and of ``lineitem`` as follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: 64 ids make two cascades of changing size, the first event of each is its root; some ids repeat and
    some times are negative."""
    e = table(spark, sf_dir, "events")
    b, k = F.expr("event_id div 64"), F.col("event_id") % 64
    cut = 8 + (b * 37) % 57
    j = F.when(k < cut, k).otherwise(k - cut)
    rel = F.when(j == 0, 0).when(F.col("event_id") % 640 == 639, -30).otherwise(F.floor((j * 40 + F.col("user_id") % 40) / 30) * 30).cast("long")
    cascade = 2 * b + 1 + (k >= cut).cast("int")
    return e.select(
        cascade.alias("cascade_idx"),
        F.when(F.col("event_id") % 100 == 99, F.col("event_id")).otherwise(F.col("event_id") + 1).alias("tweet_idx"),
        (F.col("user_id") + 1).alias("user_idx"),
        (j == 0).cast("int").alias("is_root"),
        rel.alias("relative_time"),
        (F.lit(1704067200) + (cascade - 1) * 86400 + rel).alias("time_epoch"),
        F.concat("event_type", F.lit(" "), "props").alias("text"),
        F.col("event_id").alias("event_seq"),
    )


def follows(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Distinct (src, dst) user pairs; self loops stay. With ``by`` they are shuffled once, by that column, for what groups by
    it next."""
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 1).alias("src"), (F.col("l_partkey") + 1).alias("dst"))
    return (pairs.repartition(by) if by else pairs).distinct()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_seq, y_true, y_prob): scores of 100 distinct values, so ties are common."""
    e = table(spark, sf_dir, "events")
    prob = F.get_json_object("props", "$.k").cast("double") / 100
    return e.select(F.col("event_id").alias("row_seq"), (F.col("value") > 20).cast("int").alias("y_true"), prob.alias("y_prob"))


def node_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and window of a cascade with an event, its predictions made from the ids."""
    n = raw_posts(spark, sf_dir).where("relative_time between 0 and 1799").select("cascade_idx", F.col("user_idx").alias("node_idx"), (F.floor(F.col("relative_time") / 300) + 1).alias("window_idx")).distinct()
    c, u, w = (F.col(k) for k in ("cascade_idx", "node_idx", "window_idx"))
    roles = F.array(*map(F.lit, ("producer", "amplifier", "suppressor", "reframer", "ordinary")))
    made = {"node_prob": (u * 37 + w * 11 + c) % 100 / 100, "node_strength": (u * 7 + w * 3) % 10 / 10, "shock": (c + w) % 5 / 5, "gate_obs_weight": (u + w) % 7 / 7, "gate_prior_weight": u * 3 % 5 / 5, "uncertainty": (u + c) % 11 / 11, "event_attention": (u * 13 + w * 5) % 17 / 17}
    return n.withColumns(made).withColumn("dominant_role", F.element_at(roles, ((u + w) % 5 + 1).cast("int")))


SQL = """placed AS (
  SELECT *, event_id // 64 AS b, event_id % 64 AS k, 8 + (event_id // 64 * 37) % 57 AS cut FROM events),
raw_posts AS (
  SELECT 2 * b + 1 + CAST(k >= cut AS INT) AS cascade_idx, CASE WHEN event_id % 100 = 99 THEN event_id ELSE event_id + 1 END AS tweet_idx,
    user_id + 1 AS user_idx, CAST(CASE WHEN k < cut THEN k ELSE k - cut END = 0 AS INT) AS is_root,
    CAST(CASE WHEN CASE WHEN k < cut THEN k ELSE k - cut END = 0 THEN 0 WHEN event_id % 640 = 639 THEN -30 ELSE (CASE WHEN k < cut THEN k ELSE k - cut END * 40 + user_id % 40) // 30 * 30 END AS BIGINT) AS relative_time,
    event_type || ' ' || props AS text, event_id AS event_seq
  FROM placed),
follows AS (SELECT DISTINCT l_suppkey + 1 AS src, l_partkey + 1 AS dst FROM lineitem),
preds AS (SELECT event_id AS row_seq, CAST(value > 20 AS INT) AS y_true, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS y_prob FROM events),
npred AS (SELECT *, (node_idx * 37 + window_idx * 11 + cascade_idx) % 100 / 100 AS node_prob, (node_idx * 7 + window_idx * 3) % 10 / 10 AS node_strength, (cascade_idx + window_idx) % 5 / 5 AS shock, (node_idx + window_idx) % 7 / 7 AS gate_obs_weight, node_idx * 3 % 5 / 5 AS gate_prior_weight,
    (node_idx + cascade_idx) % 11 / 11 AS uncertainty, (node_idx * 13 + window_idx * 5) % 17 / 17 AS event_attention, ['producer', 'amplifier', 'suppressor', 'reframer', 'ordinary'][(node_idx + window_idx) % 5 + 1] AS dominant_role
  FROM (SELECT DISTINCT cascade_idx, user_idx AS node_idx, relative_time // 300 + 1 AS window_idx FROM raw_posts WHERE relative_time BETWEEN 0 AND 1799)),
roots AS (SELECT * FROM raw_posts WHERE is_root = 1),
reposts AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tweet_idx ORDER BY event_seq) AS rn FROM raw_posts WHERE is_root = 0)
  WHERE rn = 1 AND tweet_idx NOT IN (SELECT tweet_idx FROM roots)),
posts AS (SELECT * FROM roots UNION ALL SELECT * FROM reposts),
edges AS (SELECT p.cascade_idx, r.user_idx AS src, p.user_idx AS dst, r.tweet_idx AS src_tweet, p.tweet_idx AS dst_tweet, p.relative_time FROM reposts p JOIN roots r USING (cascade_idx))"""

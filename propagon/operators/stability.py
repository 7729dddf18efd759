"""What node and window predictions say: stability over time, roles, gates, uncertainty, attention, inequality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propagon.sources import vector_files

#: The roles of a node.
ROLES = ("producer", "amplifier", "suppressor", "reframer", "ordinary")


def temporal_stability(preds: DataFrame) -> DataFrame:
    """Steps between a node's consecutive windows: jumps of chance and strength, changes of role, jumps damped by shock, and how
    often a high chance stays high."""
    by = Window.partitionBy("cascade_idx", "node_idx").orderBy("window_idx")
    x = preds.withColumns({"p0": F.lag("node_prob").over(by), "s0": F.lag("node_strength").over(by), "r0": F.lag("dominant_role").over(by)}).where("p0 is not null")
    jump = F.abs(F.col("node_prob") - F.col("p0"))
    named = (F.coalesce("r0", F.lit("")) != "") & (F.coalesce("dominant_role", F.lit("")) != "")
    high, was = F.col("node_prob") >= 0.5, F.col("p0") >= 0.5
    one = lambda c: F.greatest(F.count_if(c), F.lit(1))
    return x.agg(
        F.round(F.avg(jump), 6).alias("prob_jump_mean"), F.round(F.stddev_pop(jump), 6).alias("prob_jump_std"), F.round(F.avg(F.abs(F.col("node_strength") - F.col("s0"))), 6).alias("strength_jump_mean"), F.round(F.count_if(named & (F.col("r0") != F.col("dominant_role"))) / one(named), 6).alias("role_transition_rate"),
        F.round(F.avg(jump * F.exp(-F.greatest("shock", F.lit(0.0)))), 6).alias("shock_weighted_jump"), F.round(F.count_if(high & was) / one(high | was), 6).alias("high_risk_persistence"),
    )


def role_statistics(preds: DataFrame) -> DataFrame:
    """Share of each role among all rows, and the share of roles that occur."""
    n = preds.agg(F.count("*").alias("n"), *(F.count_if(F.col("dominant_role") == r).alias(r) for r in ROLES))
    seen = sum((F.col(r) > 0).cast("int") for r in ROLES)
    return n.select(*(F.round(F.col(r) / F.greatest("n", F.lit(1)), 6).alias(f"role_{r}_ratio") for r in ROLES), F.round(seen / len(ROLES), 6).alias("dominant_role_diversity"))


def role_entropy(preds: DataFrame) -> DataFrame:
    """Mean entropy of the chances role_<name> of each row, as a share of the most possible; chances count as 1e-12 at least."""
    p = [F.greatest(F.coalesce(F.col(f"role_{r}").cast("double"), F.lit(0.0)), F.lit(1e-12)) for r in ROLES]
    bits = -sum(x * F.log(x) for x in p) / F.log(F.lit(float(len(ROLES))))
    return preds.agg(F.round(F.avg(bits), 6).alias("role_entropy"))


def gate_statistics(preds: DataFrame) -> DataFrame:
    """Means of both gates, how often each is the larger, and the mean entropy of their shares in bits."""
    o, p = F.col("gate_obs_weight"), F.col("gate_prior_weight")
    share = lambda g: F.least(F.greatest(g / F.greatest(o + p, F.lit(1e-12)), F.lit(1e-12)), F.lit(1.0))
    bits = -(share(o) * F.log(share(o)) + share(p) * F.log(share(p))) / F.log(F.lit(2.0))
    n = F.greatest(F.count("*"), F.lit(1))
    return preds.agg(F.round(F.avg(o), 6).alias("mean_gate_obs"), F.round(F.avg(p), 6).alias("mean_gate_prior"), F.round(F.count_if(o >= p) / n, 6).alias("obs_dominant_ratio"), F.round(F.count_if(p > o) / n, 6).alias("prior_dominant_ratio"), F.round(F.avg(bits), 6).alias("gate_entropy"))


def uncertainty_statistics(preds: DataFrame, events: DataFrame) -> DataFrame:
    """Mean uncertainty of all rows, and the mean of the cascades' means where the event is right and where it is wrong."""
    per = preds.groupBy("cascade_idx").agg(F.avg("uncertainty").alias("u"))
    e = events.join(per, "cascade_idx")
    right = F.col("y_true") == F.col("y_pred")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col("u"))), F.lit(0.0)), 6)
    return preds.agg(F.round(F.avg("uncertainty"), 6).alias("mean_uncertainty")).crossJoin(e.agg(mean(right).alias("uncertainty_correct_mean"), mean(~right).alias("uncertainty_wrong_mean")))


def _attention(preds: DataFrame) -> DataFrame:
    w = F.greatest("event_attention", F.lit(0.0))
    by = Window.partitionBy("cascade_idx")
    x = preds.withColumn("w", w).withColumn("total", F.sum("w").over(by)).where("total > 0")
    first = by.orderBy(F.col("w").desc(), "window_idx", "node_idx")
    return x.withColumn("p", F.col("w") / F.col("total")).withColumn("rn", F.row_number().over(first))


def attention_statistics(preds: DataFrame) -> DataFrame:
    """Means over cascades of the entropy of attention and of its largest and five largest shares."""
    c = _attention(preds).groupBy("cascade_idx").agg((-F.sum(F.col("p") * F.log(F.greatest("p", F.lit(1e-12)))) / F.log(F.greatest(F.count("*"), F.lit(2)))).alias("entropy"), F.max("p").alias("top1"), F.sum(F.when(F.col("rn") <= 5, F.col("p"))).alias("top5"))
    return c.agg(F.round(F.avg("entropy"), 6).alias("attention_entropy"), F.round(F.avg("top1"), 6).alias("top1_attention_mean"), F.round(F.avg("top5"), 6).alias("top5_attention_mass_mean"))


def key_windows(preds: DataFrame) -> DataFrame:
    """Share of cascades whose largest attention lies in each window; the first row of equals counts."""
    top = _attention(preds).where("rn = 1").groupBy("window_idx").agg(F.count("*").alias("n"))
    return top.crossJoin(top.agg(F.sum("n").alias("all"))).select("window_idx", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def inequality(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gini coefficient and normalised entropy of a non-negative value within each group."""
    v = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    w = Window.partitionBy(*keys)
    x = rows.select(*keys, v.alias("v")).withColumn("i", F.row_number().over(w.orderBy("v"))).withColumn("total", F.sum("v").over(w))
    p = F.col("v") / F.col("total")
    some = F.count_if(F.col("v") > 0)
    g = x.groupBy(*keys).agg(F.max("total").alias("t"), F.count("*").alias("n"), F.sum(F.col("i") * F.col("v")).alias("s"), (-F.sum(F.when(F.col("v") > 0, p * F.log(p + 1e-12)))).alias("e"), some.alias("k"))
    return g.select(*keys, F.round(F.when(F.col("t") > 0, 2 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0), 6).alias("gini"), F.round(F.when(F.col("t") > 0, F.col("e") / F.log(F.greatest("k", F.lit(2)))).otherwise(0.0), 6).alias("entropy"))


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12)))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of the vectors of each group at length 1, as (keys, n, v). Each partition adds its vectors up before the shuffle,
    so neither dimensions nor members become rows. Null vectors do not count; all vectors have one width."""
    x = rows.where(F.col(vector).isNotNull()).select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    m = x.groupBy(*keys).agg(F.count("*").alias("n"), Summarizer.mean(F.col("v")).alias("v"))
    return m.select(*keys, "n", unit(vector_to_array("v")).alias("v"))


def text_rows(texts: DataFrame, roots: DataFrame, reposts: DataFrame) -> DataFrame:
    """``texts`` of ``text_windows`` with ``vector``: of (cascade_idx, vector) for a root, of (tweet_idx, vector) for the others,
    null where there is none; and ``kind``, root or repost."""
    is_root = F.col("text_visible_type") == "root_always_visible"
    r = texts.where(is_root).withColumn("kind", F.lit("root")).join(roots.select("cascade_idx", "vector"), "cascade_idx", "left")
    return r.unionByName(texts.where(~is_root).withColumn("kind", F.lit("repost")).join(reposts.select("tweet_idx", "vector"), "tweet_idx", "left"))


def text_report(rows: DataFrame) -> DataFrame:
    """One row on ``text_rows``: rows, those used, roots and reposts without a vector, and users and windows with one."""
    used, kind = F.col("vector").isNotNull(), F.col("kind")
    by_user = rows.groupBy("cascade_idx", "window_idx", "user_idx").agg(F.count("*").alias("n"), F.count_if(used).alias("used"), *(F.count_if(~used & (kind == k)).alias(f"missing_{k}") for k in ("root", "repost")))
    by_window = by_user.groupBy("cascade_idx", "window_idx").agg(*(F.sum(k).alias(k) for k in ("n", "used", "missing_root", "missing_repost")), F.count_if(F.col("used") > 0).alias("users"))
    total = {"input_rows": F.sum("n"), "used_rows": F.sum("used"), "missing_root_rows": F.sum("missing_root"), "missing_repost_rows": F.sum("missing_repost"), "node_rows": F.sum("users"), "window_rows": F.count_if(F.col("used") > 0)}
    return by_window.agg(*(F.coalesce(v, F.lit(0).cast("long")).alias(k) for k, v in total.items()))


def neighbour_mean(edges: DataFrame, vectors: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, dim, x): mean of the vectors of the sources of each node's edges, weighted if a weight column is named; weights
    below 1e-6 in all shrink the mean, and edges of weight 0 or none count for nothing.

    Edges are shuffled by node, unless they lie so already, as pairs of ids; their vectors are read from mapped files, so no
    vector goes along with an edge. A node's edges pass through one task, a batch at a time.
    """
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    files = vector_files.save(vectors, "node", "vector")
    # the window asks for edges by node, in order, and tells where a node begins
    place = F.row_number().over(Window.partitionBy("node").orderBy("src"))
    x = edges.where("src is not null").select(F.col("dst").alias("node"), F.col("src").cast("long").alias("src"), w.alias("w")).withColumn("place", place)

    def run(batches):
        held, nodes, open_node = vector_files.Vectors(files), 0, None

        def rows(parts):
            sums, weights = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            mean = (sums / np.maximum(weights, 1e-6)[:, None]).ravel()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([p[0] for p in parts]), pa.ListArray.from_arrays(np.arange(len(weights) + 1, dtype=np.int32) * held.width, mean)], ["node", "v"])

        for b in batches:
            node, src, w, place = b.columns
            number = nodes + np.cumsum(place.to_numpy() == 1)
            nodes = int(number[-1]) if len(number) else nodes
            at, v = held.take(src.to_numpy())
            if not len(at):
                continue
            number, w = number[at], w.to_numpy()[at]
            start = np.flatnonzero(np.diff(number, prepend=-1))
            names, sums, weights = node.take(pa.array(at[start])), np.add.reduceat(v * w[:, None], start, axis=0), np.add.reduceat(w, start)
            done = []
            if open_node and open_node[3] == number[0]:
                sums[0] += open_node[1][0]
                weights[0] += open_node[2][0]
            elif open_node:
                done.append(open_node[:3])
            open_node = names[-1:], sums[-1:], weights[-1:], number[-1]
            done.append((names[:-1], sums[:-1], weights[:-1]))
            yield rows(done)
        if open_node:
            yield rows([open_node[:3]])

    m = x.mapInArrow(run, f"node {dict(x.dtypes)['node']}, v array<double>")
    return m.select("node", F.posexplode("v").alias("dim", "x"))

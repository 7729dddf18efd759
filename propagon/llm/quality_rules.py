"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (-1). A naive Bayes model of the hidden label is fitted by expectation
maximisation on the counts of vote patterns (3 ** rules at most, whatever the corpus); each step is an aggregate, and
only the rule accuracies come back. A text is kept if its posterior probability of being good reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propagon.llm.common import saved

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STEPS = 12
#: Chances of votes -1, 0, 1 given a bad and a good text: bad texts have one fault or a few, so most rules pass them.
START = ([0.2, 0.4, 0.4], [0.15, 0.03, 0.82])
PRIOR_SHARE = 0.02


def measures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text; a null text has none."""
    t = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.withColumn("w", F.filter(F.split("t", GAP), lambda x: x != ""))
    t = t.withColumn("n_words", F.size("w").cast("long"))
    t = t.withColumn("h", F.when(F.col("n_words") > 3, F.transform(F.arrays_zip(F.slice(F.col("w"), F.lit(1), F.size("w") - 2).alias("a"), F.slice(F.col("w"), F.lit(2), F.size("w") - 2).alias("b"), F.slice(F.col("w"), F.lit(3), F.size("w") - 2).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("word_chars", F.length(F.regexp_replace("t", GAP, "")).cast("long")).withColumn("n_symbols", (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"))
    t = t.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    t = t.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    t = t.withColumns({
        "n_letters": F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long"),
        "n_bare": F.regexp_count("t", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])")).cast("long"),
        "n_doubled": F.regexp_count("t", F.lit(r"[!?*#%&$|<>]{2,}+")).cast("long"),
    })
    # windows sorted by hash: one that equals a neighbour is repeated
    s = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    t = t.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), s).otherwise(F.lit(None)))
    near = F.arrays_zip(F.col("s").alias("x"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(F.col("s"), F.lit(1), F.size("s") - 1)).alias("p"), F.concat(F.slice(F.col("s"), F.lit(2), F.size("s")), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("q"))
    t = t.withColumn("r", F.array_sort(F.transform(F.filter(near, lambda y: F.coalesce(y["x"]["h"] == y["p"]["h"], F.lit(False)) | F.coalesce(y["x"]["h"] == y["q"]["h"], F.lit(False))), lambda y: y["x"]["i"])))
    # words from each repeated window up to the next one, three at most
    gaps = F.zip_with("r", F.concat(F.slice(F.col("r"), F.lit(2), F.size("r")), F.array(F.lit(1 << 30))), lambda a, b: F.least(b - a, F.lit(3)))
    t = t.withColumn("n_repeat_words", F.when(F.size("r") > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)).otherwise(F.lit(0)).cast("long"))
    return t.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.size("lines").cast("long").alias("n_lines"), "n_letters", "n_upper", "n_bare", "n_doubled")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict[str, Column]:
    """Votes over the measures. Bounds are shares of the text's words, characters or lines."""
    n, mean = F.greatest(F.col("n_words"), F.lit(1)), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 50),
        "word_length": _vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 10)),
        "symbols": _vote(F.col("n_symbols") > 0.1 * n, F.col("n_symbols") <= 0.02 * n),
        "symbol_chars": _vote(F.col("n_symbols") > 0.05 * F.col("word_chars"), F.col("n_symbols") <= 0.01 * F.col("word_chars")),
        "letters": _vote(F.col("n_letters") < 0.75 * F.col("word_chars"), F.col("n_letters") >= 0.85 * F.col("word_chars")),
        "bare_words": _vote(F.col("n_bare") > 0.2 * n, F.col("n_bare") <= 0.05 * n),
        "doubled": _vote(F.col("n_doubled") > 0.1 * n, F.col("n_doubled") <= 0.01 * n),
        "upper_case": _vote(F.col("n_upper") > 0.5 * F.col("n_letters"), F.col("n_upper") <= 0.2 * F.col("n_letters")),
        "lines": _vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), F.col("n_dup_lines") <= 0.1 * F.col("n_lines")),
        "repeats": _vote(F.col("n_repeat_words") > 0.4 * n, F.col("n_repeat_words") <= 0.15 * n),
    }


def fit(votes: DataFrame, names: list[str], steps: int = STEPS) -> tuple[float, dict[str, tuple[list[float], list[float]]]]:
    """Prior of a good text and, per rule, the chances of votes -1, 0, 1 given a bad and a good text.

    Starts from START; that start also counts as PRIOR_SHARE of the texts in every step, so that the hidden label keeps
    its meaning where bad votes are rare.
    """
    patterns = saved(votes.groupBy(*names).agg(F.count("*").alias("n")), "patterns")
    prior, rate = 0.8, {r: START for r in names}
    for _ in range(steps):
        p = patterns.withColumn("g", posterior(prior, rate))
        sums = [F.sum("n"), F.sum(F.col("n") * F.col("g"))]
        for r in names:
            for v in (-1, 0, 1):
                hit = F.when(F.col(r) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit * (1 - F.col("g"))), F.sum(hit * F.col("g"))]
        x = p.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first()
        if not x[0]:
            break
        total, good = float(x[0]), float(x[1])
        prior = min(0.99, max(0.01, (good + 1) / (total + 2)))
        own = PRIOR_SHARE * total
        for i, r in enumerate(names):
            c = [float(v) for v in x[2 + 6 * i : 8 + 6 * i]]
            bad, ok = total - good, good
            rate[r] = tuple([(c[2 * j + k] + own * START[k][j]) / (n + own) for j in range(3)] for k, n in ((0, bad), (1, ok)))
    return prior, rate


def posterior(prior: float, rate: dict) -> Column:
    """Chance of a good text given the votes in the columns named as the rules."""
    import math

    odds = F.lit(math.log(prior / (1 - prior)))
    for r, (bad, good) in rate.items():
        step = F.when(F.col(r) == -1, math.log(good[0] / bad[0]))
        for v in (0, 1):
            step = step.when(F.col(r) == v, math.log(good[v + 1] / bad[v + 1]))
        odds = odds + step
    return 1 / (1 + F.exp(-odds))


def quality_rules(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, measures, base_failed, a vote per rule, posterior and kept, for every row.

    A null or empty text has zero words and fails the base. Ids play no part, so null and repeated ids keep their rows.
    An empty table gives an empty result.
    """
    m = saved(measures(docs, id_col, text), "measures")
    names = list(rules())
    v = m.withColumns({f"vote_{k}": c for k, c in rules().items()})
    voted = v.select("*", *(F.col(f"vote_{k}").alias(k) for k in names))
    prior, rate = fit(voted, names)
    out = voted.withColumn("base_failed", base_failed()).withColumn("posterior", posterior(prior, rate)).drop(*names)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))

"""Quality by perplexity under a bigram model of trusted text.

The model is the interpolated modified Kneser-Ney model of ``ngram_lm`` over case-sensitive words, counted on every trusted
text of fold 0 and held in memory-mapped sorted shards, so that it needs no bound. A text is kept if its perplexity does
not exceed the quantile that trusted texts of its language have; all trusted texts of fold 1 count there, and none that
the model was trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propagon.llm.common import fresh, nearest_rank, saved, tidy
from propagon.llm.ngram_lm import score_texts, train_model

QUANTILE = 0.995
LEAST_TEXTS = 50


def fold(text: str = "text"):
    """0 or 1 by hash of the text: trusted texts of fold 0 train, those of fold 1 set the thresholds."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.coalesce(F.col(text), F.lit(""))), F.lit(2))


def perplexities(docs: DataFrame, folder: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_words and perplexity of each whole text with its end."""
    scored = score_texts(docs, folder, keep, text)
    return scored.select(*keep, (F.col("n_tokens") - 1).alias("n_words"), F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def quality_lm(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, lang, n_words, perplexity, threshold and kept, for every row; ``trusted_ids`` has the ids of trusted texts.

    A null language is a language of its own. One with under LEAST_TEXTS trusted texts of fold 1 takes the
    quantile of all; without any trusted text the threshold is null and everything is kept. A null or empty text is scored
    by its end alone. Repeated rows and ids each keep a row; equal texts train once. Texts of equal perplexity are judged
    alike, those at the threshold are kept. Columns beyond id, text and language may have any name. An empty table gives
    an empty result.
    """
    key = fresh(docs, "key")
    ids = trusted_ids.select(F.col(id_col).alias(key)).where(F.col(key).isNotNull()).distinct()
    # 128 bits stand for a text, so that texts are shuffled once and copies meet before; the joins are alike at every size
    h = [F.xxhash64(F.lit(i), F.coalesce(F.col(text), F.lit(""))).alias(f"__h{i}") for i in (1, 2)]
    some = docs.where(fold(text) == 0)
    wanted = some.select(F.col(id_col), *h).join(ids.hint("merge"), F.col(id_col) == F.col(key), "left_semi").select("__h1", "__h2").distinct()
    each = some.select(F.coalesce(F.col(text), F.lit("")).alias(text), *h).dropDuplicates(["__h1", "__h2"])
    train = saved(each.join(wanted.hint("merge"), ["__h1", "__h2"], "left_semi").select(text), "train")
    tidy(docs.sparkSession)
    folder = train_model(train, text, lower=False)
    rows = docs.select(F.col(id_col), F.col(lang), text, (fold(text) == 1).alias("__fold"))
    scored = saved(perplexities(rows, folder, [id_col, lang, "__fold"], text), "perplexity")
    judged = saved(scored.where("__fold").join(ids, scored[id_col] == ids[key], "left_semi").select(F.col(lang).alias("__lang"), "perplexity"), "trusted")
    own = nearest_rank(judged, "perplexity", quantile, "__lang").where(F.col("n") >= LEAST_TEXTS).select("__lang", F.col("q").alias("own"))
    every = nearest_rank(judged.select(F.lit(True).alias("all"), "perplexity"), "perplexity", quantile, "all").first()
    out = scored.join(own, scored[lang].eqNullSafe(F.col("__lang")), "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(every["q"] if every else None).cast("double")))
    return out.select(id_col, lang, "n_words", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))

"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propagon.llm import decontamination, filter_audit, licences, mixing, ngram_lm, pieces, prefix_trie, quality_lm, quality_rules, simhash, suffix_dedup, token_output, toxicity
from propagon.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_lm.quality_lm(table(spark, sf_dir, "documents"), trusted)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.shards(table(spark, sf_dir, "documents")).drop("path")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.toxicity(docs, model, ["doc_id"])
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"]).drop("kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"), held_out, ["doc_id"])


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    digest = [F.sha2(x.cast("binary"), 256).alias(k) for k, x in (("ids_sha256", F.array_join("ids", ",")), ("decoded_sha256", F.col("decoded")))]
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digest, "agrees")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rollups(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_quality_lm, op2_token_output, op3_toxicity, op4_mixing, op5_suffix_dedup, op6_quality_rules, op7_simhash, op8_decontamination, op9_licences, op10_lm_scores, op11_pieces, op12_prefix_trie, op13_filter_audit)}

OP12_SQL = """WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc(c, bytes, i, x) AS (
  SELECT c, CAST(c AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM ids UNION ALL
  SELECT c, bytes, i + 1, list_reduce(list_prepend(xor(x, CAST(ascii(substr(bytes, i + 1, 1)) AS BIGINT)), [CAST(j AS BIGINT) FOR j IN range(8)]), lambda a, j: xor(a // 2, CASE WHEN a % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))
  FROM crc WHERE i < length(bytes)),
head AS (SELECT c, xor(x, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE i = length(bytes)),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
made AS (SELECT h.c, 0 AS own, t.i, role, text FROM head h JOIN turns t ON t.c = h.c - h.c % 100 AND t.i <= h.h UNION ALL SELECT h.c, 1, t.i, role, text FROM head h JOIN turns t ON t.c = h.c AND t.i > h.h),
seqs AS (SELECT h.c, coalesce(list({'role': role, 'text': text} ORDER BY own, i) FILTER (role IS NOT NULL), []) AS s FROM head h LEFT JOIN made m USING (c) GROUP BY h.c),
prefixes AS (SELECT c, s[1:d] AS p, d, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(p[d].text) END AS saved FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (p)),
up AS (SELECT p[1:e] AS p, k, saved FROM (SELECT p, k, saved, unnest(range(0, d + 1)) AS e FROM whole)),
sums AS (SELECT p, count(CASE WHEN k = 0 THEN 1 END) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY p)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, w.n AS n_convs, w.k AS n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (p) LEFT JOIN whole q ON w.d > 0 AND q.p = w.p[1:w.d - 1]"""

OP13_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 200 AS INT) + 2 * CAST(100 * list_unique(w) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS x
  FROM d LEFT JOIN m USING (doc_id)),
g AS (SELECT part, x, good, toxic, count(*) AS c FROM f GROUP BY ALL),
l AS (SELECT i, chr(CAST(65 + i AS INT)) AS k, CAST(1 << i AS INT) AS b FROM range(5) t(i)),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS b, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS before FROM o, range(1, 6) t(i)),
r AS (SELECT part, filter_order, step, b, sum(CASE WHEN x & (before | b) = 0 THEN c ELSE 0 END) AS kept, sum(CASE WHEN x & before = 0 AND x & b > 0 THEN c ELSE 0 END) AS removed, sum(CASE WHEN x & before > 0 AND x & b > 0 THEN c ELSE 0 END) AS redundant, sum(CASE WHEN x = b THEN c ELSE 0 END) AS unique_fails,
    sum(CASE WHEN x & before = 0 AND x & b > 0 AND good THEN c ELSE 0 END) AS good_lost, sum(CASE WHEN x & before = 0 AND x & b > 0 AND toxic THEN c ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM r"""

#: SQL states none of the first eleven: they train models, refine buckets, tokenise or draw by Spark's hashes; tests/llm has
#: brute-force versions.
SQL: dict[str, str] = {"op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}

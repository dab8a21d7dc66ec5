"""Registered queries of the dealt operators over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    embedding_whitening, inverted_multi_index, language_id, line_dedup, packing, pii_surrogates, pivot_search, quality_classifier, quality_rules,
    sentencepiece_codec, sharding, source_divergence, weighted_minhash,
)
from .common import table


def _model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), _model_file())


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("row.text"), 256).alias("kept_sha256"))


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return inverted_multi_index.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii_surrogates.replace(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "row.text", "n_entities")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = embedding_whitening.whiten(table(spark, sf_dir, "embeddings"), 8)
    return done.withColumn("deviation", F.col("deviation").cast("long"))


def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_search.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_sentencepiece, op3_weighted_minhash, op4_sharding, op5_quality_rules, op6_packing, op7_line_dedup,
        op8_inverted_multi_index, op9_language_id, op10_pii_surrogates, op11_embedding_whitening, op12_pivot_search, op13_source_divergence,
    )
}

_WORD = r"'[^\x20\x09-\x0D]+'"
OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {_WORD})) AS lines,
         len(regexp_extract_all(coalesce(text, ''), '\p{{Lu}}')) AS n_upper
  FROM documents),
win AS (
  SELECT k, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
twice AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY k),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_upper
  FROM d LEFT JOIN rep USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 20 * n_symbols > word_chars OR 2 * n_upper > word_chars
            OR 10 * n_dup_lines > 5 * n_words OR word_chars > 30 * n_words) AS kept
FROM c"""

_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT k, doc_id, pos, line, translate(trim(line, {_ENDS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT k, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d)),
shared AS (
  SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.*, shared.key IS NOT NULL AND l.doc_id <> first_doc AS gone FROM l LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY k"""

OP12_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM e q JOIN e v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (
  SELECT k, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)),
kept AS (SELECT lang, term, count(*)::HUGEINT AS in_lang FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
held AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
lv AS (SELECT lang, count(*)::HUGEINT AS v, sum(in_lang)::HUGEINT AS lang_n FROM kept GROUP BY 1),
g AS (
  SELECT lang, source, coalesce(s.n, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM held GROUP BY 1, 2) s USING (lang, source)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(held.n, 0) AS n, 1 + 1000000000 * (coalesce(held.n, 0) + 5) // (g.total + 5 * v) AS p,
         1 + 1000000000 * (in_lang + 5) // (lang_n + 5 * v) AS q
  FROM g JOIN lv USING (lang) JOIN kept USING (lang) LEFT JOIN held ON held.lang = g.lang AND held.source = g.source AND held.term = kept.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 50"""

ORACLES: dict[str, str] = {"op5_quality_rules": OP5_SQL, "op7_line_dedup": OP7_SQL, "op12_pivot_search": OP12_SQL, "op13_source_divergence": OP13_SQL}

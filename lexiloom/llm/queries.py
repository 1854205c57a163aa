"""The queries over this subpackage's operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, divergence, licences, linechunks, mixing, mtree, multiindex, passages, quality, sharding, simhash, urls
from .shared import documents, word_count, written


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sharding.shard(docs, 24, carry_text=False).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licences.scan_licences(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


def op5_linechunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.remove_repeated_lines(documents(spark, sf_dir), keep_text=False)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(documents(spark, sf_dir))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.id, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


#: The rules that op8 is given: longest first wins.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, words=1, blocks=5, word_distance=4, distance=4)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    salt = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit(""))))
    sized = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"), salt.alias("salt"))
    return mixing.mix(written(sized, "mix-sizes"), salt="salt").select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), 'null'), CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END)) AS key
  FROM documents),
stats AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
         ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY src),
levels AS (SELECT *, source_size * 2.0::DOUBLE AS full_at, source_size * 2.0::DOUBLE / weight AS lvl FROM stats),
common AS (
  SELECT *, row_number() OVER w AS place,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_at) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS c
  FROM levels WINDOW w AS (ORDER BY lvl, src)),
targets AS (
  SELECT src, source_size, least(full_at, weight * (SELECT coalesce(min_by(c, place), 0) FROM common WHERE c <= lvl)) AS target FROM common),
placed AS (
  SELECT doc_id, src, size,
         sum(size) OVER (PARTITION BY src ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM sized),
cut AS (
  SELECT p.*, t.source_size, t.target, CAST(floor(t.target + 1e-6) AS BIGINT) AS budget,
         CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target + 1e-6) / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM placed p JOIN targets t USING (src))
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(budget - epochs * source_size - start, 0), size) AS BIGINT) AS taken
FROM cut
"""


#: Folder of the public tokenizers' files, the same on all machines.
TOKENIZERS = "/opt/tokenizers"


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = alignment.align(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
lang_terms AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS n FROM lang_terms GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN lang_terms USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n, coalesce(s.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM counts GROUP BY lang, source) s USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (t.total + 2) // (g.lang_n + 2 * g.v) AS q
  FROM groups g JOIN lang_terms t USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
best AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM best
  QUALIFY rank <= 10)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


def op13_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_licences, op3_decontamination, op4_quality, op5_linechunks, op6_passages, op7_topk, op8_urls, op9_simhash, op10_mixing, op11_alignment, op12_divergence, op13_multiindex)}


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": OP7_SQL, "op10_mixing": OP10_SQL, "op12_divergence": OP12_SQL}

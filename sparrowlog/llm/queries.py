"""The registered queries over the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, language_id, line_dedup, minhash, mixing, pii, simhash, token_files, warc
from .common import scratch


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; of fewer files than there are cores, dealt out by id, so that what reads them isn't one task."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = spark.sparkContext.defaultParallelism
    return docs.repartition(n, "doc_id") if len(docs.inputFiles()) < n else docs


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_documents(spark, sf_dir), width=3)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.evaluate(_documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark, "token-files")
    token_files.write(_documents(spark, sf_dir), where, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, where, with_ids=False).drop("ids")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir), keep="max")


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


#: Production parameters of mixing: English half of the tokens, tables and licences few, sources evened out.
MIX = mixing.Targets(language={"en": 0.5}, topic={"table": 0.05, "licence": 0.05}, temper=0.5, share=0.6)


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` that has lost some pages, holds some with other bytes, and one of its own."""
    kept = pages.select("page_id", "url", "html").filter("page_id % 211 <> 13")
    html = F.when(F.col("page_id") % 101 == 7, F.concat(F.col("html"), F.lit(" "))).otherwise(F.col("html"))
    own = pages.agg(F.max("page_id").alias("m")).select((F.col("m") + 1).alias("page_id"), F.lit("http://added.example.com/").alias("url"), F.lit("<p>added</p>").alias("html"))
    return kept.withColumn("html", html).unionByName(own)


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.audit(pages, damaged_replica(pages))


OP6_SQL = """
WITH raw AS (
    SELECT page_id, md5(page_id::VARCHAR || '|' || url) AS d, url, html FROM pages
), records AS (
    SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
        || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
        || 'WARC-Record-ID: <urn:uuid:' || d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] || '>' || chr(13) || chr(10)
        || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
        || html || chr(13) || chr(10) || chr(13) || chr(10) AS r
    FROM raw
), sized AS (
    SELECT page_id, strlen(r)::BIGINT AS length, sha256(r) AS record_sha256 FROM records
)
SELECT page_id, (sum(length) OVER (ORDER BY page_id) - length)::BIGINT AS offset, length, record_sha256,
       CASE WHEN page_id % 211 = 13 THEN 'missing' WHEN page_id % 101 = 7 THEN 'damaged' ELSE 'intact' END AS status
FROM sized
UNION ALL
SELECT max(page_id) + 1, NULL, NULL, NULL, 'added' FROM pages
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir), MIX)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(_documents(spark, sf_dir), key=b"sparrowlog demonstration key")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edit_study(_documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_documents(spark, sf_dir), least_docs=10, least_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), frequent AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
    SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_simhash_near_dedup, op2_language_id, op3_token_files, op4_byte_bpe, op5_exact_dedup, op6_warc_fixity, op7_mixing, op8_pii_pseudonyms, op9_document_fingerprints, op10_line_dedup]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op6_warc_fixity": OP6_SQL, "op10_line_dedup": OP10_SQL}

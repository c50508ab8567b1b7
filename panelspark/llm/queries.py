"""The queries of this package's operators, each over its whole table, and SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontam, hnsw, langid, licenses, linededup, pii, simhash, spm, urlfilter, warc

#: A parameter; a deployment names its own place.
SPM_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: For queries and tests; a deployment passes its own secret.
PII_KEY = b"surrogates of the registered queries"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spm.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), SPM_MODEL, restored_col="restored")
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "restored")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(_table(spark, sf_dir, "documents"), least=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_neardup, op2_pii_surrogates, op3_warc_round_trip, op4_sentencepiece, op5_template_decontamination, op6_language_id, op7_url_filter, op8_embedding_neardup, op9_license_scan, op10_line_dedup)}

#: SHA-1 in hexadecimal to base32, five bits at a time.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((((strpos('0123456789abcdef', substr(h, 5 * i // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 5 * i // 4 + 2, 1)) - 1) >> (3 - 5 * i % 4)) & 31) AS BIGINT), 1)), '')"

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM best OR best IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to FROM p JOIN m USING (h)
"""

#: All pairs; the operator finds 0.99 of them or more, and all where there are few.
VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON r.n = l.x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM (SELECT n AS vec_id, min(c) AS c FROM r GROUP BY n) LEFT JOIN k ON x = vec_id
"""

ORACLES: dict[str, str] = {"op3_warc_round_trip": WARC_SQL, "op7_url_filter": urlfilter.URL_SQL, "op8_embedding_neardup": VECTOR_SQL}

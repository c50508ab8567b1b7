"""From raw documents to training tokens: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontam, langid, pii, simhash, spm
from panelspark.llm.queries import PII_KEY, SPM_MODEL
from panelspark.plans.shared import remove, remove_at_exit, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: those without a letter, and those whose best language is not even likely."""
    return langid.keep_known(docs, langid.learn(docs)).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8, checked exactly on candidates by 256-bit fingerprints."""
    return simhash.keep_one(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, its numbers, names and units changed or not, go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; n_chars follows the text."""
    return pii.replace_pii(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it."""
    out = spm.encode(docs, SPM_MODEL, restored_col="restored")
    return out.select("doc_id", "lang", "source", "n_chars", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "restored")


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminate), ("private", private), ("tokens", tokens)]

#: The stages are models, graphs and automata; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again, so that a lost executor costs one stage at most.

    Rows are judged by id and text: repeated rows are near copies of each other, of which one stays; ties go to the smallest id, null ids last.
    Null texts are of no known language and go. An empty table gives an empty result. The result is read from the shared
    folder and goes when the process ends.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        at = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            remove(spark, last)
        last = at
    remove_at_exit(spark, last)
    return docs

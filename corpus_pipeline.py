"""A training-data pipeline over `documents`: each stage is written as Parquet and read again as the input of
the next. Every stage sees all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, decontam, secrets, simhash, toxicity
from ledgerloom.llm.queries import VOCABULARY
from ledgerloom.llm.shared import materialize, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. It is fitted on the labels of the input's documents."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays: texts whose five-word shingles have a
    similarity of 0.8 or more, found among those with linked SimHash fingerprints and those that share a band of
    MinHash values.

    Documents without a word have no content to compare and stay, as do rows with a null doc_id."""
    return without(docs, simhash.near_copies(docs.select("doc_id", "text")).where("doc_id <> group_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay."""
    return secrets.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as count and digests; with small tables, as workers hold memory of earlier stages."""
    return bpe.digests(docs, VOCABULARY, room=0.4)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("bpe_encoding", encode),
]

#: SQL expresses neither the classifier nor the automaton; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

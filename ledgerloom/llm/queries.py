"""The registered query of each operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import alignment, bpe, chat, decontam, flac, fm_dedup, merkle, merkle_sql, minhash, secrets, simhash, toxicity, url_filters, warc
from ledgerloom.llm.shared import fresh_path, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)], rows.schema)
    return chat.read_back(chat.segments(rows.unionByName(probe)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), VOCABULARY, room=3.0)


def op8_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.digests(fm_dedup.dedup(_table(spark, sf_dir, "documents")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_history(_table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "ledger")))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(materialize(flac.encode_table(_table(spark, sf_dir, "documents")), "media", "zstd"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.statistics(_table(spark, sf_dir, "documents"), VOCABULARY, PIECES)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_fm_dedup": op8_fm_dedup,
    "op9_secrets": op9_secrets,
    "op10_flac": op10_flac,
    "op11_minhash": op11_minhash,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {
    "op1_url_filters": url_filters.sql(),
    "op2_warc": warc.SQL,
    "op4_chat": chat.sql(),
    "op9_secrets": secrets.sql(),
    "op13_merkle": merkle_sql.SQL,
}

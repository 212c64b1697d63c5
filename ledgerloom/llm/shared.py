"""Folders all executors share, and lineage cuts through tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local session where that is unset (tests, a laptop) gets a new local one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder, by the session's codec unless one is named, and reads it back.

    It cuts the lineage, so an executor that is lost later never makes the work before it run again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle that this library asks for by key; it follows the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_fields(df: DataFrame, name: str, more: str) -> str:
    """The DDL of df's column `name` followed by the fields `more`."""
    return f"`{name}` {df.schema[name].dataType.simpleString()}, {more}"


#: Rows up to which a table of ids is broadcast.
BROADCAST_IDS = 500_000


def checked(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids with a hint to broadcast, where they are at most `most` rows; they should be a written table."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for those whose doc_id is in gone (doc_id). Few ids are broadcast, so texts don't travel; rows with a
    null doc_id and all columns stay."""
    ids = materialize(gone.select("doc_id").distinct(), "gone")
    return docs.join(checked(ids), "doc_id", "left_anti").select(*docs.columns)

"""Queries that read a table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.registry import add
from ledgerloom.sources.tables import EVENTS_SQL
from ledgerloom.streaming import accounts


def account_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    amount = F.round(F.col("value") * 100).cast("long")
    # A pattern, as a stream takes a single file for a folder.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    rows = stream.select(F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("purchase", "signup"), amount).otherwise(-amount).alias("moved_c"))
    return accounts.run_once(spark, rows).select("account_id", "n", "balance_c", "longest_gap", "bursts")


add("st1_account_states", account_states,
    f"""with {EVENTS_SQL}, g as (select *, date_diff('day', lag(d) over w, d) as gap, lag(ts, 2) over w as third from ev window w as (partition by account_id order by ts, seq))
select account_id, count(*) as n, arg_max(balance_c, (ts, seq))::bigint as balance_c, coalesce(max(gap), 0)::bigint as longest_gap, (count(*) filter (where third is not null and ts - third <= interval 7 day))::bigint as bursts from g group by 1""")  # fmt: skip

"""The state of each account over a stream of rows that may come late and out of order.

An account's rows wait in its state until the watermark has passed them and are then taken in the order of their time;
figures that are told before take the waiting rows in the order known by then. So what comes late within the watermark's
delay is put where it belongs. The state is bounded: rows within the delay, a handful of figures, and the times of the
last few rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.sources.tables import scratch_dir

A = "account_id"
_DAY = 86_400_000_000
OUT = f"{A} long, n long, balance_c long, last_us long, longest_gap long, bursts long"
_STATE = "n long, balance_c long, last_us long, longest_gap long, bursts long, recent array<long>, waiting array<struct<us: long, seq: long, moved_c: long>>"


def states(rows: DataFrame, delay: str, many: int = 3, days: int = 7) -> DataFrame:
    """A row of OUT whenever an account's state changed: rows taken, their balance, the time of the last in microseconds,
    the longest gap between two in whole days, and how many were the `many`-th or a later one within `days` days.

    rows: a stream of account_id, ts, seq, moved_c; ties in time are taken by seq. delay: how late a row may come."""

    def taken(figures: tuple, rows_: list[tuple]) -> tuple:
        n, balance, last, gap, bursts, recent = figures
        for us, _, moved in rows_:
            gap = max(gap, us // _DAY - last // _DAY) if last is not None else gap
            recent = [x for x in recent if us - x <= days * _DAY][-(many - 1) :]
            bursts += len(recent) >= many - 1
            n, balance, last, recent = n + 1, balance + moved, us, [*recent, us]
        return n, balance, last, gap, bursts, recent

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *figures, waiting = state.get if state.exists else (0, 0, None, 0, 0, [], [])
        new = [w for b in batches for w in zip(b["us"].tolist(), b["seq"].tolist(), b["moved_c"].tolist(), strict=True)]
        waiting = sorted([*map(tuple, waiting), *new])
        mark = state.getCurrentWatermarkMs()
        ready = sum(w[0] // 1000 <= mark for w in waiting)
        figures = taken((*figures[:5], list(figures[5])), waiting[:ready])
        waiting = waiting[ready:]
        state.update((*figures, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, mark + 1))
        if new:
            yield pd.DataFrame([(key[0], *taken(figures, waiting)[:5])], columns=[A, "n", "balance_c", "last_us", "longest_gap", "bursts"])

    timed = rows.withWatermark("ts", delay).select(A, "ts", F.unix_micros("ts").alias("us"), "seq", "moved_c")
    return timed.groupBy(A).applyInPandasWithState(run, OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_once(spark: SparkSession, stream: DataFrame, delay: str = "0 seconds", name: str = "states") -> DataFrame:
    """The last state of each account after all that the stream holds now. States and results are in the shared folder,
    so a later run with the same checkpoint would go on from there."""
    root = scratch_dir(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    states(stream, delay).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(OUT + ", batch long").parquet(f"{root}/out")
    figures = [c.split(" ")[0] for c in OUT.split(", ")][1:]
    return found.groupBy(A).agg(F.max_by(F.struct(*figures), "n").alias("s")).select(A, "s.*")

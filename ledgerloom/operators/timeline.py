"""Order and time within an account: cleaning, spines, gaps, islands, as-of and running figures.

All windows are partitioned by account, so they run side by side and need one placing of rows by account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import scan

A = "account_id"


def by_account(*order: str) -> Window:
    return Window.partitionBy(A).orderBy(*order)


def dedup_keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each exact repetition of `key` once: the row that is first in `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def end_of_day(ledger: DataFrame, order: str = "seq") -> DataFrame:
    """(account_id, d, balance_c): the balance of each day's last row, by a map-side aggregation."""
    return ledger.groupBy(A, "d").agg(F.max_by("balance_c", order).alias("balance_c"))


def daily_balance(ledger: DataFrame, order: str = "seq") -> DataFrame:
    """(account_id, d, balance_c) for every day between an account's first and last: gaps take the last known
    balance. Each stretch is spread where it stands, so the days are never shuffled or joined."""
    return stretches(ledger, order).select(A, F.explode(F.sequence("d", F.date_add("d", F.col("days") - 1))).alias("d"), "balance_c")


def stretches(ledger: DataFrame, order: str = "seq") -> DataFrame:
    """(account_id, d, days, balance_c): the balance of each day with rows and the number of days, itself included, for
    which it holds: up to the account's next one, 1 for the last. Sums over days are sums over these."""
    eod = end_of_day(ledger.where(F.col(A).isNotNull() & F.col("d").isNotNull()), order)
    filled = F.last("balance_c", ignorenulls=True).over(by_account("d").rowsBetween(Window.unboundedPreceding, 0))
    days = F.coalesce(F.datediff(F.lead("d").over(by_account("d")), "d"), F.lit(1))
    return eod.select(A, "d", days.alias("days"), filled.alias("balance_c"))


def recovery_runs(daily: DataFrame) -> DataFrame:
    """(account_id, runs, days): closed runs of days below the account's mean balance; an open run at the end
    is none."""
    low = F.col("balance_c") < F.avg("balance_c").over(Window.partitionBy(A))
    flagged = daily.withColumn("low", low).withColumn("turn", F.when(F.col("low") & ~F.coalesce(F.lag("low").over(by_account("d")), F.lit(False)), 1).otherwise(0))
    island = flagged.withColumn("island", F.sum("turn").over(by_account("d"))).withColumn("later", F.lead("low").over(by_account("d")))
    runs = island.where("low").groupBy(A, "island").agg(F.count("*").alias("days"), F.max(F.col("later").isNotNull() & ~F.col("later")).alias("closed")).where("closed")
    return runs.groupBy(A).agg(F.count("*").alias("runs"), F.sum("days").alias("days"))


def velocity(rows: DataFrame, n: int = 3, days: int = 7, order: tuple[str, ...] = ("d", "seq")) -> DataFrame:
    """Rows from which the n-th row on is at most `days` later, with that row's date."""
    return rows.withColumn("until", F.lead("d", n - 1).over(by_account(*order))).where(F.datediff("until", "d") <= days)


def exhaustion_day(ledger: DataFrame, share: float = 0.8, default: int = 25) -> DataFrame:
    """(account_id, days): days from the first row until debits pass `share` of all credits; `default` where
    they never do, 1 at least. Debits only add up, so the day is found among sums of days."""
    days = ledger.groupBy(A, "d").agg(F.sum("debit_c").alias("out_c"), F.sum("credit_c").alias("in_c"))
    run = days.withColumn("spent", F.sum("out_c").over(by_account("d").rowsBetween(Window.unboundedPreceding, 0))).withColumn("income", F.sum("in_c").over(Window.partitionBy(A)))
    at = run.groupBy(A).agg(F.min("d").alias("first"), F.min(F.when((F.col("income") > 0) & (F.col("spent") * 10 >= F.col("income") * int(share * 10)), F.col("d"))).alias("hit"))
    return at.select(A, F.greatest(F.coalesce(F.datediff("hit", "first"), F.lit(default)), F.lit(1)).cast("long").alias("days"))


def as_of(ledger: DataFrame, is_anchor: Column, name: str = "anchor_d") -> DataFrame:
    """The date of the latest anchor row on or before each row's date."""
    return scan.as_of_day(ledger, name, F.when(is_anchor, F.col("d")))


def carry_forward(rows: DataFrame, column: str, order: str = "seq", size: int = scan.PIECE) -> DataFrame:
    known = scan.scanned(rows, scan.by_number(order, size), [order], lasts={"__known": F.col(column)})
    return known.withColumn(column, F.col("__known")).drop("__known")


def chain_mismatches(ledger: DataFrame, tolerance_c: int = 50, order: str = "seq", size: int = scan.PIECE) -> DataFrame:
    """Rows whose balance doesn't follow from the row before."""
    before = scan.scanned(ledger, scan.by_number(order, size), [order], lags={"before_c": F.col("balance_c")})
    return before.withColumn("off_c", F.col("balance_c") - (F.col("before_c") - F.col("debit_c") + F.col("credit_c"))).drop("before_c").where(F.abs("off_c") > tolerance_c)


def _settle(left: list[tuple], running: int | None, tolerance_c: int) -> tuple[list[int], int]:
    """A day's rows (seq, debit, credit, balance) in an order in which balances follow; the balance after."""
    out: list[int] = []
    if running is None:
        _, debit, credit, balance = left[0]
        running = balance + debit - credit
    while left:
        fit = next((i for i, (_, debit, credit, balance) in enumerate(left) if abs(running - debit + credit - balance) <= tolerance_c), None)
        if fit is None:
            return out + [x[0] for x in left], left[-1][3]
        row = left.pop(fit)
        out.append(row[0])
        running = row[3]
    return out, running


def reorder_by_balance(ledger: DataFrame, tolerance_c: int = 50) -> DataFrame:
    """account_id, seq and pos: each day's rows put into an order in which balances follow from one another.

    Which row comes next depends on the running balance, so rows stream through in order of account and date,
    and a task holds one day of one account at a time. The opening balance is what the first row implies; where
    no row of the day fits, the rest of that day keeps its order."""
    import pyarrow as pa

    def run(batches):
        at, left, running, pos = (object(), None), [], None, 0

        def day() -> list[tuple]:
            nonlocal running, pos
            order, running = _settle(left, running, tolerance_c)
            pos += len(order)
            return [(at[0], s, pos - len(order) + i) for i, s in enumerate(order, 1)]

        kinds = None
        for b in batches:
            kinds, rows = (b.schema.field(0).type, pa.int64(), pa.int64()), []
            for account, d, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (account, d) != at:
                    if left:
                        rows += day()
                    if account != at[0]:
                        running, pos = None, 0
                    at, left = (account, d), []
                left.append(tuple(row))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [A, "seq", "pos"])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*day(), strict=True), kinds, strict=True)], [A, "seq", "pos"])

    kind = ledger.schema[A].dataType.simpleString()
    rows = ledger.select(A, F.unix_date("d").alias("day"), F.col("seq").cast("long"), "debit_c", "credit_c", "balance_c")
    return rows.repartition(A).sortWithinPartitions(A, "day", "seq").mapInArrow(run, f"{A} {kind}, seq long, pos long")


def day_clusters(rows: DataFrame, keys: list[str], gap: int = 3) -> DataFrame:
    """Rows with the number of their cluster of days: a new one begins after more than `gap` days."""
    w = Window.partitionBy(*keys).orderBy("d")
    turn = F.when(F.datediff("d", F.lag("d").over(w)) > gap, 1).otherwise(0)
    return rows.withColumn("__turn", turn).withColumn("cluster", F.sum("__turn").over(w)).drop("__turn")


def month_over_month(monthly: DataFrame, value: str, ym: str = "ym") -> DataFrame:
    """Change to the month before in percent, rounded half up to two digits; null in the first month, 0 after 0."""
    before = F.lag(value).over(by_account(ym))
    return monthly.withColumn("change_pct", F.when(before == 0, 0).otherwise(F.round(F.try_divide((F.col(value) - before).cast("double") * 100, F.abs(before).cast("double")), 2)))

"""Running figures over an account of any size: a segmented scan in two passes.

A window over a whole account is one task's work. Here an account's ordered rows are cut into pieces (a day, or a range
of numbers), each of which a task scans for itself; what a piece adds up to is an aggregation with partial sums; a
window over pieces, of which an account has few, gives what came before each, and is joined back. Rows are placed once,
by account and piece, so an account with a third of all rows is spread like the others.

A piece's key must not decrease along the order of rows; accounts and pieces are not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

A = "account_id"
#: Rows of a piece where rows are numbered.
PIECE = 1 << 16


def by_number(order: str = "seq", size: int = PIECE) -> Column:
    """Pieces of `size` consecutive numbers."""
    return F.floor(F.col(order) / size)


def scanned(rows: DataFrame, piece: Column, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> DataFrame:
    """rows with, under each name: of `sums` the running total up to and with the row, of `lasts` the last value that
    isn't null up to and with the row, of `lags` the value of the row before.

    `order` tells the rows of a piece apart. rows are read twice, so they should be a table or cheap to make."""
    sums, lasts, lags = sums or {}, lasts or {}, lags or {}
    every = {**sums, **lasts, **lags}
    own = rows.withColumn("__piece", piece).withColumns({f"__v_{n}": c for n, c in every.items()})
    inside = Window.partitionBy(A, "__piece").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    at, v = F.struct(*order), lambda n: F.col(f"__v_{n}")
    local = {f"__l_{n}": F.sum(v(n)).over(upto) for n in sums} | {f"__l_{n}": F.last(v(n), ignorenulls=True).over(upto) for n in lasts} | {f"__l_{n}": F.lag(v(n)).over(inside) for n in lags}
    first = {"__first": F.row_number().over(inside) == 1} if lags else {}
    totals = [F.sum(v(n)).alias(f"__t_{n}") for n in sums] + [F.max_by(v(n), F.when(v(n).isNotNull(), at)).alias(f"__t_{n}") for n in lasts] + [F.max_by(v(n), at).alias(f"__t_{n}") for n in lags]
    pieces = Window.partitionBy(A).orderBy("__piece")
    before = pieces.rowsBetween(Window.unboundedPreceding, -1)
    t = lambda n: F.col(f"__t_{n}")
    carry = [F.coalesce(F.sum(t(n)).over(before), F.lit(0)).alias(f"__c_{n}") for n in sums] + [F.last(t(n), ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts] + [F.lag(t(n)).over(pieces).alias(f"__c_{n}") for n in lags]
    carried = own.groupBy(A, "__piece").agg(*totals).select(A, "__piece", *carry)
    l, c = (lambda n: F.col(f"__l_{n}")), (lambda n: F.col(f"__c_{n}"))  # noqa: E741
    out = [(l(n) + c(n)).alias(n) for n in sums] + [F.coalesce(l(n), c(n)).alias(n) for n in lasts] + [F.when(F.col("__first"), c(n)).otherwise(l(n)).alias(n) for n in lags]
    return own.withColumns(local | first).join(carried, [A, "__piece"]).select(*rows.columns, *out)


def as_of_day(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with the greatest `value` of their account's rows up to and with their day: days are aggregated and
    scanned, rows only look up their own day."""
    days = rows.groupBy(A, "d").agg(F.max(value).alias("__v"))
    known = days.select(A, "d", F.max("__v").over(Window.partitionBy(A).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias(name))
    return rows.join(known, [A, "d"]).select(*rows.columns, name)

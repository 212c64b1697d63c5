"""Figures by month with totals, and over trailing windows, each from one aggregation of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import ratio

A = "account_id"
#: Measures of the month sheet, in order, and how months add up to the total.
MEASURES = {
    "opening": "first", "closing": "last", "debits": "sum", "credits": "sum", "n_debits": "sum", "n_credits": "sum", "net": "sum", "lowest": "min", "highest": "max", "average": "avg", "salary": "sum", "obligations": "sum", "investments": "sum", "cash_in": "sum",
    "cash_out": "sum", "n_cash_in": "sum", "n_cash_out": "sum", "cheque_in": "sum", "cheque_out": "sum", "n_self": "sum", "interest_in": "sum", "interest_out": "sum",
}


def half_up(total: Column, n: Column) -> Column:
    """Whole cents of an average, halves upward, by whole numbers."""
    twice, by = 2 * total + n, 2 * n
    return F.floor((twice - F.pmod(twice, by)) / by).cast("long")


def month_sheet(ledger: DataFrame) -> DataFrame:
    """(account_id, ym, measure, value): the 22 lines of the month sheet for each month and, as ym `Total`, for all.

    Rows are added up by month only; totals are windows over an account's months, which stay where its rows are, and
    that of the averages is the mean of the months' own. ledger: classified; amounts in cents; seq: from 0 up to 2^40.
    Balances are those of rows."""
    c, d, b, sub = F.col("credit_c"), F.col("debit_c"), F.col("balance_c"), F.coalesce("subcategory", F.lit(""))
    has = lambda w: F.contains(sub, F.lit(w))
    total, n, paid_in = lambda test, of: F.sum(F.when(test, of).otherwise(0)), F.count_if, c > 0
    # A date and a number as one number: by a struct, rows would be sorted to be added up.
    at = F.shiftleft(F.coalesce(F.unix_date("d"), F.lit(-(1 << 22))).cast("long"), 40) + F.col("seq")
    sums = {
        "opening": F.min_by(b + d - c, at), "closing": F.max_by(b, at), "debits": F.sum(d), "credits": F.sum(c), "n_debits": n(d > 0), "n_credits": n(paid_in), "net": F.sum(c - d), "lowest": F.min(b), "highest": F.max(b), "average": half_up(F.sum(b), F.count("*")),
        "salary": total(has("Salary"), c), "obligations": total(has("EMI") | has("Loan"), d), "investments": total(F.col("category") == "Investment", d), "cash_in": total(has("Cash") & paid_in, c), "cash_out": total(has("Cash") & (d > 0), d),
        "n_cash_in": n(has("Cash") & paid_in), "n_cash_out": n(has("Cash") & (d > 0)), "cheque_in": total(has("Cheque") & paid_in, c), "cheque_out": total(has("Cheque") & ~paid_in, d), "n_self": n(has("Self Transfer")),
        "interest_in": total(has("Interest") & paid_in, c), "interest_out": total(has("Interest") & ~paid_in, d),
    }
    months = ledger.groupBy(A, "ym").agg(*[v.cast("long").alias(k) for k, v in sums.items()], F.min(at).alias("__first"), F.max(at).alias("__last"))
    own = Window.partitionBy(A)
    whole = {"first": lambda k: F.min_by(k, "__first").over(own), "last": lambda k: F.max_by(k, "__last").over(own), "sum": lambda k: F.sum(k).over(own), "min": lambda k: F.min(k).over(own), "max": lambda k: F.max(k).over(own), "avg": lambda k: half_up(F.sum(k).over(own), F.count(k).over(own))}
    both = months.select("*", *[whole[how](k).alias(f"__{k}") for k, how in MEASURES.items()], F.row_number().over(own.orderBy("ym")).alias("__n"))
    line = lambda ym, of: F.struct(ym.alias("ym"), *[F.col(of + k).alias(k) for k in MEASURES])
    month, total = line(F.col("ym"), ""), line(F.lit("Total"), "__")
    done = both.select(A, F.inline(F.when(F.col("__n") == 1, F.array(month, total)).otherwise(F.array(month))))
    return done.select(A, "ym", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in MEASURES])))


#: Days of the trailing windows.
DAYS = (30, 90, 180, 365)


def trailing(rows: DataFrame, kind: Column, is_cash: Column, is_night: Column | None = None, days: tuple[int, ...] = DAYS) -> DataFrame:
    """(account_id, days, ten measures) of windows that end at an account's last day, both ends included.

    Rows are added up by day, days into all windows at once; no row is copied into the windows it is in. kind: NEEDS,
    WANTS or INVESTMENT of spending; is_night: null where rows have no time of day, and so is its ratio."""
    d = F.col("debit_c")
    spent = {"out_c": d, "in_c": F.col("credit_c"), "wants_c": F.when(kind == "WANTS", d), "needs_c": F.when(kind == "NEEDS", d), "invested_c": F.when(kind == "INVESTMENT", d), "cash_c": F.when(is_cash, d), "night_c": F.when(is_night, d) if is_night is not None else F.lit(0)}
    daily = rows.groupBy(A, "d").agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in spent.items()])
    aged = daily.withColumn("weekend_c", F.when(F.dayofweek("d").isin(1, 7), F.col("out_c")).otherwise(0)).withColumn("age", F.datediff(F.max("d").over(Window.partitionBy(A)), "d"))
    names = [*spent, "weekend_c"]
    sums = aged.groupBy(A).agg(*[F.sum(F.when(F.col("age") <= n, F.col(k)).otherwise(0)).alias(f"{k}_{n}") for n in days for k in names])

    def window(n: int) -> Column:
        v = {k: F.col(f"{k}_{n}") for k in names}
        share = lambda a, b: F.coalesce(F.round(ratio(a, b), 4), F.lit(0.0))
        night = share(v["night_c"], v["out_c"]) if is_night is not None else F.lit(None).cast("double")
        out = {
            "days": F.lit(n), "out_c": v["out_c"], "in_c": v["in_c"], "wants_c": v["wants_c"], "needs_c": v["needs_c"], "invested_c": v["invested_c"], "weekend_ratio": share(v["weekend_c"], v["out_c"]), "night_ratio": F.when(v["out_c"] > 0, night),
            "cash_ratio": share(v["cash_c"], v["out_c"]), "wants_to_needs": share(v["wants_c"], v["needs_c"]), "saved_c": v["in_c"] - v["out_c"],
        }
        return F.struct(*[x.alias(k) for k, x in out.items()])

    return sums.select(A, F.inline(F.array(*[window(n) for n in days])))


def drift(windows: DataFrame, short: int = 30, long: int = 365) -> DataFrame:
    """(account_id, wants_drift_c, weekend_drift, night_drift, saved_drift_c): the short window less the long one."""
    of = lambda c, n: F.max(F.when(F.col("days") == n, F.col(c)))
    gap = lambda c: of(c, short) - of(c, long)
    return windows.groupBy(A).agg(gap("wants_c").alias("wants_drift_c"), F.round(gap("weekend_ratio"), 4).alias("weekend_drift"), F.round(gap("night_ratio"), 4).alias("night_drift"), gap("saved_c").alias("saved_drift_c"))


def wants_trend(months: DataFrame, bound: float = 0.15) -> DataFrame:
    """(account_id, growth, trend) of the wants of an account's last month against the month before; months:
    (account_id, ym, wants_c). Accounts of one month are STABLE."""
    w = Window.partitionBy(A).orderBy(F.desc("ym"))
    last = months.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy(A).agg(F.max(F.when(F.col("n") == 1, F.col("wants_c"))).alias("now"), F.max(F.when(F.col("n") == 2, F.col("wants_c"))).alias("before"))
    growth = F.when(F.col("before") > 0, (F.col("now") - F.col("before")) / F.col("before")).otherwise(0.0)
    trend = F.when(growth > bound, "INCREASING").when(growth < -bound, "DECREASING").otherwise("STABLE")
    return last.select(A, F.round(growth, 4).alias("growth"), trend.alias("trend"))

"""Feature engines: income, expense, cash flow, balance, savings, investment, recurrence and debt.

Sums are whole cents; ratios are doubles of whole numbers. Every engine works on all accounts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import clamp, ratio

A = "account_id"


def monthly_cashflow(ledger: DataFrame) -> DataFrame:
    m = ledger.groupBy(A, "ym").agg(F.sum("credit_c").alias("inflow_c"), F.sum("debit_c").alias("outflow_c"), F.count("*").alias("n"))
    return m.withColumn("net_c", F.col("inflow_c") - F.col("outflow_c"))


def cashflow_summary(ledger: DataFrame) -> DataFrame:
    """Totals, months in surplus and deficit, and the spread of monthly nets (population; 0 for one month).

    The second aggregation is by a part of the first one's key, so rows are few by then."""
    spread = F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop(F.col("net_c").cast("double")))
    m = monthly_cashflow(ledger).groupBy(A).agg(
        F.sum("inflow_c").alias("inflow_c"), F.sum("outflow_c").alias("outflow_c"), F.sum("net_c").alias("net_c"),
        F.count_if(F.col("net_c") > 0).alias("surplus_months"), F.count_if(F.col("net_c") < 0).alias("deficit_months"), F.round(spread).cast("long").alias("net_spread_c"),
    )
    return m


def slope(monthly: DataFrame, value: str) -> DataFrame:
    """(account_id, months, slope): least squares over the number of the month; 0 for one month. The fraction
    is of whole numbers, so it doesn't depend on the order of summing."""
    n = monthly.withColumn("x", F.row_number().over(Window.partitionBy(A).orderBy("ym")) - 1)
    s = n.groupBy(A).agg(F.count("*").alias("months"), F.sum("x").alias("sx"), F.sum(value).alias("sy"), F.sum(F.col("x") * F.col(value)).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    top, low = F.col("months") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("months") * F.col("sxx") - F.col("sx") * F.col("sx")
    return s.select(A, "months", F.coalesce(F.try_divide(top.cast("double"), low.cast("double")), F.lit(0.0)).alias("slope"))


def trajectory(ledger: DataFrame, bound_c: int = 50_000) -> DataFrame:
    """POSITIVE, NEGATIVE or STABLE by the slope of monthly nets and the last two months. Where investments explain
    the difference (their sum is positive), nets without them are judged; one month is STABLE. The ledger may have
    category and subcategory."""
    invested = F.lit(False)
    if "category" in ledger.columns:
        invested = F.coalesce(F.lower("category").contains("investment") | F.lower("subcategory").rlike("sip|mutual|nps|ppf|securities|trading"), F.lit(False))
    m = ledger.groupBy(A, "ym").agg(F.sum(F.col("credit_c") - F.col("debit_c")).alias("raw"), F.sum(F.when(invested, F.col("debit_c")).otherwise(0)).alias("put"))
    more = F.sum("put").over(Window.partitionBy(A)) > 0
    m = m.withColumn("v", F.col("raw") + F.when(more, F.col("put")).otherwise(0))
    late = m.withColumn("r", F.row_number().over(Window.partitionBy(A).orderBy(F.desc("ym")))).where("r <= 2").groupBy(A).agg(F.count_if(F.col("v") < 0).alias("late"))
    flag = F.when(F.col("months") < 2, "STABLE").when((F.col("slope") > bound_c) & (F.col("late") == 0), "POSITIVE").when((F.col("slope") < -bound_c) | (F.col("late") >= 2), "NEGATIVE").otherwise("STABLE")
    return slope(m, "v").join(late, A).select(A, flag.alias("trajectory"))


#: Fixed: how much each kind of investment counts as long-term; others count 0.3.
LONG_TERM = {
    "PPF": 1.0, "NPS": 1.0, "Bonds / SGB": 0.9, "FD / RD": 0.8, "Mutual Funds / SIP": 0.7, "Equity Trading": 0.4, "Zerodha": 0.5, "Groww": 0.5, "Upstox": 0.5, "INDmoney": 0.6, "ET Money": 0.6, "Dividend": 0.3,
}


def long_term_score(investments: DataFrame, kind: str = "subcategory") -> DataFrame:
    """(account_id, long_term): weights of LONG_TERM averaged by amount, four digits."""
    weight = F.lit(0.3)
    for name, w in LONG_TERM.items():
        weight = F.when(F.col(kind) == name, F.lit(w)).otherwise(weight)
    tenths = F.round(weight * 10).cast("long")
    return investments.groupBy(A).agg(F.round(ratio(F.sum(tenths * F.col("debit_c")), F.sum("debit_c")) / 10, 4).alias("long_term"))


def seasonality(ledger: DataFrame) -> DataFrame:
    """Mean net by calendar month of accounts with a year or more of months."""
    m = monthly_cashflow(ledger).withColumn("months", F.count("*").over(Window.partitionBy(A))).where("months >= 12")
    return m.groupBy(A, F.substring("ym", 6, 2).alias("month")).agg(F.sum("net_c").alias("net_c"), F.count("*").alias("n"))


def top_counterparty(ledger: DataFrame, value: str = "debit_c", key: str = "counterparty") -> DataFrame:
    """The largest counterparty, its share and a band of it; ties go to the name that comes first."""
    per = ledger.where(F.col(value) > 0).groupBy(A, key).agg(F.sum(value).alias("v"))
    w = Window.partitionBy(A)
    top = per.withColumn("total", F.sum("v").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("v"), key))).where("r = 1")
    share = ratio(F.col("v"), F.col("total"))
    band = F.when(share >= 0.5, "HIGH").when(share >= 0.3, "MODERATE").otherwise("LOW")
    return top.select(A, F.col(key).alias("top"), F.col("v").alias("top_c"), F.round(share, 4).alias("share"), band.alias("band"))


def income_summary(income: DataFrame) -> DataFrame:
    """Totals, sources and stability: the share of months at 80 percent of the mean or more."""
    m = income.groupBy(A, "ym").agg(F.sum("credit_c").alias("v"))
    months = m.withColumn("ok", (F.col("v") * F.count("*").over(Window.partitionBy(A)) * 10 >= F.sum("v").over(Window.partitionBy(A)) * 8).cast("int"))
    per = months.groupBy(A).agg(F.count("*").alias("months"), F.sum("v").alias("income_c"), F.round(F.sum("ok") / F.count("*"), 4).alias("stability"))
    return per.join(income.groupBy(A).agg(F.countDistinct("counterparty").alias("sources")), A)


def salary_consistency(salary: DataFrame) -> DataFrame:
    """1 - s / mean of monthly salary, 0 at least (sample deviation; 1 for one month)."""
    m = salary.groupBy(A, "ym").agg(F.sum("credit_c").cast("double").alias("v")).groupBy(A).agg(F.stddev_samp("v").alias("s"), F.avg("v").alias("mean"), F.count("*").alias("months"))
    return m.select(A, "months", F.round(F.greatest(1 - F.coalesce(F.col("s"), F.lit(0.0)) / F.col("mean"), F.lit(0.0)), 4).alias("consistency"))


def recurring_income(credits: DataFrame, least: int = 3, mean_c: int = 500_000) -> DataFrame:
    """The largest regular source of an account: at least `least` credits of mean `mean_c` or more, spread of
    a quarter at most, median gap of 24 to 36 days."""
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy(A, "counterparty").orderBy("d", "seq")))
    g = credits.withColumn("gap", gap).groupBy(A, "counterparty").agg(F.count("*").alias("n"), F.sum("credit_c").alias("total_c"), F.avg("credit_c").alias("mean"), F.stddev_pop("credit_c").alias("s"), F.median("gap").alias("gap"))
    g = g.where((F.col("n") >= least) & (F.col("mean") >= mean_c) & (F.col("s") <= 0.25 * F.col("mean")) & F.col("gap").between(24, 36))
    best = Window.partitionBy(A).orderBy(F.desc("total_c"), "counterparty")
    return g.withColumn("r", F.row_number().over(best)).where("r = 1").select(A, "counterparty", "n", "total_c", "gap")


def needs_wants(expenses: DataFrame) -> DataFrame:
    """Spending by label with shares of what is labelled; months are those with spending."""
    total = lambda label: F.sum(F.when(F.col("needs_wants") == label, F.col("debit_c")).otherwise(0))
    s = expenses.groupBy(A).agg(total("Need").alias("needs_c"), total("Want").alias("wants_c"), F.sum("debit_c").alias("expense_c"), F.countDistinct("ym").alias("months"))
    return s.withColumns({"needs_ratio": F.round(ratio(F.col("needs_c"), F.col("expense_c")), 4), "wants_ratio": F.round(ratio(F.col("wants_c"), F.col("expense_c")), 4)})


def category_spending(expenses: DataFrame) -> DataFrame:
    return expenses.groupBy(A, "category", "subcategory").agg(F.sum("debit_c").alias("spent_c"), F.count("*").alias("n"))


def _marked_days(until: Column) -> Column:
    """A count of days 1, 14 and 28 to 31 of months up to a date: of a month with n days, n - 25."""
    day, month = F.dayofmonth(until), F.year(until) * 12 + F.month(until)
    return F.unix_date(until) - day - 25 * month + 1 + (day >= 14).cast("int") + F.greatest(day - 27, F.lit(0))


def balance_summary(stretches: DataFrame, low_c: int = 300_000) -> DataFrame:
    """Mean, median, extremes, days below bounds and the average on days 1, 14 and the end of months; spread
    over mean as a score from 0 to 1 with its band. stretches: (account_id, d, days, balance_c), see timeline; each
    counts as many times as it has days. The variance is a fraction of whole numbers."""
    b, days, whole = F.col("balance_c"), F.col("days"), F.col("balance_c").cast("decimal(18,0)")
    held = stretches.withColumn("abb", (_marked_days(F.date_add("d", days - 1)) - _marked_days(F.date_sub("d", 1))).cast("long"))
    s = held.groupBy(A).agg(
        F.sum(days).alias("days"), F.sum(b * days).alias("sum_c"), F.percentile("balance_c", 0.5, days).alias("median_c"), F.min("balance_c").alias("min_c"), F.max("balance_c").alias("max_c"),
        F.sum(F.when(b < 0, days).otherwise(0)).alias("negative_days"), F.sum(F.when(b < low_c, days).otherwise(0)).alias("low_days"), F.sum(whole * whole * days).alias("squares"),
        F.sum(F.when(F.col("abb") > 0, b * F.col("abb"))).alias("abb_sum_c"), F.sum("abb").alias("abb_days"),
    )
    n, total = F.col("days").cast("decimal(10,0)"), F.col("sum_c").cast("decimal(19,0)")
    spread = (n * F.col("squares") - total * total).cast("double") / F.col("days") / (F.col("days") - 1)
    s = s.withColumns({"s": F.when(F.col("days") > 1, F.sqrt(spread)), "mean": F.col("sum_c") / F.col("days")})
    score = F.when(F.col("mean") <= 0, 1.0).otherwise(clamp(F.coalesce(F.col("s"), F.lit(0.0)) / F.col("mean"), 0, 1))
    band = F.when(score < 0.15, "LOW").when(score < 0.40, "MODERATE").when(score < 0.70, "HIGH").otherwise("VERY_HIGH")
    return s.select(A, "days", "sum_c", "median_c", "min_c", "max_c", "negative_days", "low_days", "abb_sum_c", "abb_days", F.round(score, 4).alias("volatility"), band.alias("band"))


def monthly_balance(daily: DataFrame) -> DataFrame:
    return daily.groupBy(A, F.date_format("d", "yyyy-MM").alias("ym")).agg(F.sum("balance_c").alias("sum_c"), F.count("*").alias("days"))


def daily_change(daily: DataFrame) -> DataFrame:
    """Mean and largest absolute day-to-day change in percent."""
    before = F.lag("balance_c").over(Window.partitionBy(A).orderBy("d"))
    c = daily.withColumn("pct", F.when(before != 0, F.abs((F.col("balance_c") - before).cast("double") * 100 / before)))
    return c.groupBy(A).agg(F.round(F.avg("pct"), 2).alias("mean_pct"), F.round(F.max("pct"), 2).alias("max_pct"))


def opening_closing(ledger: DataFrame, keys: tuple[str, ...] = (A,)) -> DataFrame:
    """The balance before the first row and after the last."""
    first = F.min_by(F.col("balance_c") + F.col("debit_c") - F.col("credit_c"), "seq")
    return ledger.groupBy(*keys).agg(first.alias("opening_c"), F.max_by("balance_c", "seq").alias("closing_c"))


def savings_summary(ledger: DataFrame) -> DataFrame:
    """Net per month, the rate of income saved and its steadiness (1 - spread over mean, from 0 to 1); for a classified
    ledger also the saving with what was invested."""
    put = F.when(F.col("category") == "Investment", F.col("debit_c")).otherwise(0) if "category" in ledger.columns else F.lit(0)
    monthly = ledger.groupBy(A, "ym").agg(F.sum("credit_c").alias("inflow_c"), F.sum(F.col("credit_c") - F.col("debit_c")).alias("net_c"), F.sum(put).alias("put_c"))
    m = monthly.groupBy(A).agg(F.sum("net_c").alias("saved_c"), F.sum("put_c").alias("put_c"), F.sum("inflow_c").alias("inflow_c"), F.stddev_pop(F.col("net_c").cast("double")).alias("s"), F.avg(F.col("net_c").cast("double")).alias("mean"), F.count("*").alias("months"))
    steady = F.when((F.col("months") < 2) | (F.col("mean") <= 0), 0.0).otherwise(clamp(1 - F.col("s") / F.col("mean"), 0, 1))
    more = [(F.col("saved_c") + F.col("put_c")).alias("with_invested_c")] if "category" in ledger.columns else []
    return m.select(A, "months", "saved_c", *more, F.round(ratio(F.col("saved_c"), F.col("inflow_c")), 4).alias("rate"), F.round(steady, 4).alias("consistency"))


def emergency_fund(ledger: DataFrame) -> DataFrame:
    """Months of need that the closing balance covers, against a target of three and six. The need is the average
    monthly outflow, or that of needs where a classified ledger has more of them. One aggregation gives all of it."""
    needs = F.when(F.col("needs_wants") == "Need", F.col("debit_c")).otherwise(0) if "needs_wants" in ledger.columns else F.lit(0)
    out = ledger.groupBy(A).agg(F.sum("debit_c").alias("out_c"), F.sum(needs).alias("needs_c"), F.countDistinct("ym").alias("months"), F.max_by("balance_c", F.struct("d", "seq")).alias("closing_c"))
    need = F.greatest("out_c", "needs_c").cast("double") / F.col("months")
    return out.select(A, "closing_c", F.round(need * 3).cast("long").alias("target3_c"), F.round(need * 6).cast("long").alias("target6_c"), F.round(F.try_divide(F.greatest(F.col("closing_c"), F.lit(0)).cast("double"), need), 4).alias("coverage_months"))


def investment_by_type(investments: DataFrame) -> DataFrame:
    """Amounts and payments of each kind of investment, and the kind's share of the account's."""
    per = investments.groupBy(A, "subcategory").agg(F.sum("debit_c").alias("put_c"), F.count("*").alias("n"))
    return per.withColumn("share", F.round(ratio(F.col("put_c"), F.sum("put_c").over(Window.partitionBy(A))), 4))


def sip_clusters(investments: DataFrame, gap: int = 3, months: int = 3) -> DataFrame:
    """Plans: equal amounts on nearby days of the month (gaps of at most `gap`) in `months` months or more."""
    w = Window.partitionBy(A, "debit_c").orderBy("dom", "seq")
    r = investments.withColumn("dom", F.dayofmonth("d"))
    r = r.withColumn("cluster", F.sum(F.when(F.col("dom") - F.lag("dom").over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("dom", F.col("dom"))
    return r.groupBy(A, "debit_c", "cluster").agg(F.countDistinct("ym").alias("months"), F.count("*").alias("n")).where(F.col("months") >= months)


def obligations(ledger: DataFrame, is_obligation: Column, is_income: Column) -> DataFrame:
    """Obligations over true income with its band."""
    s = ledger.groupBy(A).agg(F.sum(F.when(is_obligation, F.col("debit_c")).otherwise(0)).alias("obligations_c"), F.sum(F.when(is_income, F.col("credit_c")).otherwise(0)).alias("income_c"))
    r = ratio(F.col("obligations_c"), F.col("income_c"))
    band = F.when(r.isNull(), "UNKNOWN").when(r <= 0.30, "HEALTHY").when(r <= 0.50, "MODERATE").when(r <= 0.70, "HIGH").otherwise("CRITICAL")
    return s.select(A, "obligations_c", "income_c", F.round(r, 4).alias("foir"), band.alias("band"))

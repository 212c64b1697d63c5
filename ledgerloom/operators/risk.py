"""Portfolio, behaviour, audit and profile measures per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import clamp, ratio

A = "account_id"


def behaviour(ledger: DataFrame, low_c: int = 300_000) -> DataFrame:
    """Ratios of an account's rows and the state that follows from them, first match."""
    u = F.upper("description")
    debit = F.col("debit_c")
    s = ledger.groupBy(A).agg(
        F.sum(debit).alias("out_c"), F.sum("credit_c").alias("in_c"), F.sum(F.when(F.contains(u, F.lit("CASH WDL")), debit).otherwise(0)).alias("cash_c"), F.sum(F.when(F.dayofweek("d").isin(1, 7), debit).otherwise(0)).alias("weekend_c"),
        F.sum(F.when(F.col("needs_wants") == "Want", debit).otherwise(0)).alias("want_c"), F.count_if(F.col("balance_c") < low_c).alias("low_rows"), F.countDistinct("counterparty").alias("payees"),
    )
    r = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    cash, weekend, want = r("cash_c", "out_c"), r("weekend_c", "out_c"), r("want_c", "out_c")
    saved = F.coalesce(ratio(F.col("in_c") - F.col("out_c"), F.col("in_c")), F.lit(0.0))
    state = F.when(F.col("low_rows") > 15, "Financial Stress").when(cash > 0.35, "Cash Dependent").when((want > 0.60) | (weekend > 0.40), "Impulsive").when(saved < -0.05, "Depleting Balance").when(want > 0.40, "Lifestyle Inflation").when((want < 0.20) & (F.col("low_rows") == 0) & (saved > 0), "High Saver").otherwise("Stable")
    return s.select(A, "payees", "low_rows", F.round(cash, 4).alias("cash"), F.round(weekend, 4).alias("weekend"), F.round(want, 4).alias("want"), F.round(saved, 4).alias("saved"), state.alias("state"))


def monthly_trend(ledger: DataFrame) -> DataFrame:
    """RISING, FALLING or STEADY: spending of the last month against the one before, 15 percent either way."""
    m = ledger.groupBy(A, "ym").agg(F.sum("debit_c").alias("v"))
    w = Window.partitionBy(A).orderBy(F.desc("ym"))
    last = m.withColumns({"r": F.row_number().over(w), "before": F.lead("v").over(w)}).where("r = 1 and before is not null")
    return last.select(A, "v", "before", F.when(F.col("v") * 100 > F.col("before") * 115, "RISING").when(F.col("v") * 100 < F.col("before") * 85, "FALLING").otherwise("STEADY").alias("trend"))


def audit(ledger: DataFrame) -> DataFrame:
    """Bounces that a later payment to the same lender clears within seven days, and the first salary payer."""
    bounce = F.contains(F.upper("description"), F.lit("RETURN CHARGES"))
    s = ledger.groupBy(A).agg(F.count_if(bounce).alias("bounces"), F.min_by("description", F.when(F.col("description").startswith("SALARY") & (F.col("credit_c") > 0), F.col("seq"))).alias("employer"))
    pay = F.when(F.col("description").startswith("ACH/") & (F.col("debit_c") > 0), F.col("d"))
    later = F.min(pay).over(Window.partitionBy(A).orderBy(F.unix_date("d")).rangeBetween(0, 7))
    cleared = ledger.withColumn("paid", later).where(bounce).groupBy(A).agg(F.count_if(F.col("paid").isNotNull()).alias("cleared"))
    return s.join(cleared, A, "left").select(A, "bounces", F.coalesce("cleared", F.lit(0)).alias("cleared"), (F.col("bounces") - F.coalesce("cleared", F.lit(0))).alias("confirmed"), "employer")


def business_profile(ledger: DataFrame, sectors: dict[str, str]) -> DataFrame:
    """Share of rows that a sector's words hit; FORMAL from 40 percent on, MIXED from 15."""
    low = F.lower("description")
    tests = {k: low.rlike(v) for k, v in sectors.items()}
    s = ledger.groupBy(A).agg(F.count("*").alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()])
    best = F.greatest(*[F.struct(F.col(k).alias("hits"), F.lit(k).alias("sector")) for k in sectors])
    share = best["hits"] / F.col("n")
    return s.select(A, "n", best["sector"].alias("sector"), best["hits"].alias("hits"), F.when(share >= 0.40, "FORMAL").when(share >= 0.15, "MIXED").otherwise("INFORMAL").alias("profile"))


def printed_balance_breaks(ledger: DataFrame, share: float = 0.02) -> DataFrame:
    """Rows whose printed balance is over two percent off what the printed balance before implies."""
    w = Window.partitionBy(A).orderBy("seq")
    off = F.abs(F.lag("balance_c").over(w) - F.col("debit_c") + F.col("credit_c") - F.col("balance_c"))
    return ledger.withColumn("off_c", off).where((F.col("balance_c") != 0) & (F.col("off_c") > share * F.abs("balance_c"))).select(A, "seq", "off_c")


def level_shift(values: Column, tight: float = 0.01) -> Column:
    """The first cut of an array of four or more where both sides are constant within one percent and differ by
    more; null where there is none."""
    n = F.size(values)
    left, right = (lambda i: F.slice(values, 1, i)), (lambda i: F.slice(values, i + 1, n - i))
    flat = lambda a: (F.array_max(a) - F.array_min(a)) <= F.array_max(a) * tight
    good = lambda i: flat(left(i)) & flat(right(i)) & (F.abs(F.array_min(right(i)) - F.array_min(left(i))) > F.array_min(left(i)) * tight)
    return F.when(n >= 4, F.get(F.filter(F.sequence(F.lit(2), n - 2), good), F.lit(0)))


def true_turnover(ledger: DataFrame, mirrored: DataFrame) -> DataFrame:
    """Credits without loans, returns and money that went both ways."""
    loan = F.col("subcategory").isin("Loan EMI") | F.col("is_return")
    s = ledger.groupBy(A).agg(F.sum(F.when(loan, 0).otherwise(F.col("credit_c"))).alias("clean_c"))
    m = mirrored.groupBy(A).agg(F.sum("mirrored_c").alias("mirrored_c"))
    return s.join(m, A, "left").select(A, F.greatest(F.lit(0), F.col("clean_c") - F.coalesce("mirrored_c", F.lit(0))).cast("long").alias("turnover_c"))


def discipline_score(ledger: DataFrame) -> DataFrame:
    """0 to 100: bounces, negative rows and spending above income take points."""
    s = ledger.groupBy(A).agg(F.count_if(F.contains(F.upper("description"), F.lit("RETURN CHARGES"))).alias("b"), F.count_if(F.col("balance_c") < 0).alias("neg"), F.sum("credit_c").alias("i"), F.sum("debit_c").alias("o"))
    points = 100 - F.least(F.lit(40), 10 * F.col("b")) - F.least(F.lit(30), F.col("neg")) - F.when(F.col("o") > F.col("i"), 20).otherwise(0)
    return s.select(A, clamp(points, 0, 100).cast("long").alias("points"))


def salary_cycle(ledger: DataFrame) -> DataFrame:
    """The usual day of the month of salary credits (median), their median amount and number."""
    s = ledger.where((F.col("credit_c") > 0) & F.upper("description").rlike("SALARY|PAYROLL"))
    return s.groupBy(A).agg(F.count("*").alias("n"), F.median(F.dayofmonth("d")).alias("day"), F.median("credit_c").alias("median_c"))


def facilities(ledger: DataFrame, words: str = "EMI|FINANCE|LENDER") -> DataFrame:
    """Rows of running facilities by keyword: uses, repayments and their sums."""
    r = ledger.where(F.upper("description").rlike(words))
    return r.groupBy(A).agg(F.count_if(F.col("credit_c") > 0).alias("drawn"), F.count_if(F.col("debit_c") > 0).alias("repaid"), F.sum("credit_c").alias("drawn_c"), F.sum("debit_c").alias("repaid_c"))


def aml_score(scores: DataFrame) -> DataFrame:
    """scores with 0.85 of the fraud score, 15 for each flag of mirrored money and 10 for each of structuring, 100 at
    most, and its band. scores: as fraud.fraud_score gives them. Fixed values."""
    score = F.round(F.least(F.lit(100.0), 0.85 * F.col("fraud_score") + 15 * F.col("mirrored") + 10 * F.col("structured")) + 1e-9, 2)
    band = F.when(F.col("aml_score") <= 25, "LOW").when(F.col("aml_score") <= 50, "MODERATE").when(F.col("aml_score") <= 75, "HIGH").otherwise("CRITICAL")
    return scores.withColumn("aml_score", score).withColumn("aml_band", band)

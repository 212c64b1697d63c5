"""Two-party operators: interval, as-of, sequence and annotation joins. Interval joins carry an equi-key (the
account) and a date bucket, so they shuffle by both and never compare all pairs of an account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import scan

A = "account_id"


def within_days(left: DataFrame, right: DataFrame, days: int) -> DataFrame:
    """Pairs of one account where the right date is 0 to `days` later. Rows meet in the bucket of the left date
    or the one after."""
    size = days + 1
    day = lambda c: F.unix_date(c)
    lb = left.withColumn("__b", F.floor(day(F.col("l_d")) / size))
    rb = right.withColumn("__b", F.explode(F.array(F.floor(day(F.col("r_d")) / size), F.floor(day(F.col("r_d")) / size) - 1)))
    return lb.join(rb, [A, "__b"]).where(F.datediff("r_d", "l_d").between(0, days)).drop("__b")


def _side(rows: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return rows.select(A, *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


#: Fixed: marks of a reversal, and subcategories whose payments are no conduit.
REVERSAL = "RVSL|REVERSAL|REFUND|RETURN"
PAYDAY = "EMI|SIP|MUTUAL FUND|INSURANCE|PPF|NPS|FD|RD|LOAN|RENT|CREDIT CARD|SECURITIES|TRADING|DIRECT|TAX"
#: Fixed: what names an obligation in a category, a subcategory, or a narration.
OBLIGED_CATEGORY, OBLIGED_SUBCATEGORY = "(?i)investment|debt|loan|tax|insurance|savings|transfer", "(?i)loan|emi|sip|mutual|nps|ppf|tax|insurance|direct|card|securities|trading"
OBLIGED_TEXT = "(?i)loan|emi|sip|mutual|ach|nach|insurance|tax|direct|securities|broking|ppf|nps"


def is_obligation(category: Column, subcategory: Column, description: Column | None = None) -> Column:
    """Payments to recognised obligations, by their labels and, if given, their narration; null counts as none."""
    tests = [category.rlike(OBLIGED_CATEGORY), subcategory.rlike(OBLIGED_SUBCATEGORY)] + ([description.rlike(OBLIGED_TEXT)] if description is not None else [])
    return F.greatest(F.lit(False), *[F.coalesce(t, F.lit(False)) for t in tests])


def rapid_transfers(ledger: DataFrame, least_c: int = 2_000_000) -> DataFrame:
    """Large credits passed on to another party within a day at 85 to 105 percent: the first debit of each. Neither
    side is a reversal, both are not cash at a machine, and the debit is no investment or known obligation. The
    ledger is classified."""
    own = ledger.where(~text.holds(F.upper(F.concat_ws(" ", "subcategory", "description")), REVERSAL)).withColumn("cash", text.rail(F.col("description")) == "ATM_CASH")
    credits = _side(own.where(F.col("credit_c") >= least_c), "l", "seq", "d", "credit_c", "counterparty", "cash")
    paid = (F.col("debit_c") > 0) & (F.col("category") != "Investment") & ~text.holds(F.upper("subcategory"), PAYDAY) & ~text.holds(F.col("counterparty"), "EBA_|PPF")
    debits = _side(own.where(paid), "r", "seq", "d", "debit_c", "counterparty", "cash")
    near = (F.col("r_debit_c") * 100 >= F.col("l_credit_c") * 85) & (F.col("r_debit_c") * 100 <= F.col("l_credit_c") * 105)
    pairs = within_days(credits, debits, 1).where(near & (F.col("l_counterparty") != F.col("r_counterparty")) & ~(F.col("l_cash") & F.col("r_cash")))
    return pairs.groupBy(A, "l_seq", "l_credit_c").agg(F.min_by(F.struct("r_seq", "r_debit_c"), F.struct("r_d", "r_seq")).alias("r")).select(A, F.col("l_seq").alias("credit_seq"), F.col("r.r_seq").alias("debit_seq"), F.col("l_credit_c").alias("credit_c"), F.col("r.r_debit_c").alias("debit_c"))


def quick_debits(ledger: DataFrame, is_salary: Column) -> DataFrame:
    """Debits of over half a salary on its day or the next, but for payments to obligations. The ledger is
    classified."""
    salary = _side(ledger.where(is_salary), "l", "seq", "d", "credit_c")
    free = ~is_obligation(F.col("category"), F.col("subcategory"), F.col("description"))
    debits = _side(ledger.where((F.col("debit_c") > 0) & free), "r", "seq", "d", "debit_c")
    return within_days(salary, debits, 1).where(F.col("r_debit_c") * 2 > F.col("l_credit_c")).select(A, F.col("l_seq").alias("salary_seq"), F.col("r_seq").alias("debit_seq"), F.col("r_debit_c").alias("debit_c"))


def two_sided(ledger: DataFrame, least_c: int = 1_000_000, within: float = 0.15) -> DataFrame:
    """Counterparties with much money both ways and a difference of 15 percent at most: one aggregation."""
    s = ledger.groupBy(A, "counterparty").agg(F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c"))
    near = F.abs(F.col("in_c") - F.col("out_c")) * 100 <= F.greatest("in_c", "out_c") * int(within * 100)
    return s.where((F.col("in_c") > least_c) & (F.col("out_c") > least_c) & near).withColumn("mirrored_c", 2 * F.least("in_c", "out_c"))


def salary_phase(ledger: DataFrame, is_salary: Column) -> DataFrame:
    """Spending by days since the latest salary."""
    days = F.datediff("d", "salary_d")
    phase = F.when(days.isNull(), "Pre-Salary").when(days <= 7, "Week 1").when(days <= 15, "Week 2").when(days <= 22, "Week 3").otherwise("Week 4+")
    return scan.as_of_day(ledger, "salary_d", F.when(is_salary, F.col("d"))).withColumn("phase", phase).groupBy(A, "phase").agg(F.sum("debit_c").alias("spent_c"), F.count("*").alias("n"))


def latest_labels(rows: DataFrame, labels: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with the last label written for their key: labels are reduced before the join."""
    last = labels.groupBy(*keys).agg(F.max_by("label", order).alias("label"))
    return rows.join(last, keys, "left")


def missing_ranges(seen: DataFrame, number: str, key: str = A) -> DataFrame:
    """(key, first, last): runs of numbers absent between each key's least and greatest, a row for each run."""
    after = F.lead(number).over(Window.partitionBy(key).orderBy(number))
    gaps = seen.select(key, number).distinct().withColumn("__after", after).where(F.col("__after") > F.col(number) + 1)
    return gaps.select(key, (F.col(number) + 1).alias("first"), (F.col("__after") - 1).alias("last"))


def missing_numbers(seen: DataFrame, number: str, key: str = A) -> DataFrame:
    """Numbers absent between each key's least and greatest, one by one."""
    return missing_ranges(seen, number, key).select(key, F.explode(F.sequence("first", "last")).alias(number))


def annotate(ledger: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows with the worst severity among flags that name them; flags: (account_id, seq, severity)."""
    rank = F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    worst = flags.groupBy(A, "seq").agg(F.max_by("severity", rank).alias("severity"), F.count("*").alias("flags"))
    return ledger.join(worst, [A, "seq"], "left")


def applications_with_results(applications: DataFrame, results: DataFrame) -> DataFrame:
    """Left outer by id; order is for the caller, as it needs all rows in one place."""
    return applications.join(results, "application_id", "left")


def duplicate_references(rows: DataFrame) -> DataFrame:
    """Rows that repeat a reference of twelve characters or more with the same amount on the same day."""
    ref = F.explode(F.array_distinct(F.regexp_extract_all("description", F.lit("([A-Z0-9]{12,})"), 1)))
    w = Window.partitionBy(A, "ref", "amount_c", "d").orderBy("seq")
    tagged = rows.withColumn("amount_c", F.col("debit_c") + F.col("credit_c")).withColumn("ref", ref).where(F.col("ref").rlike("[A-Z]"))
    return tagged.withColumn("n", F.row_number().over(w)).where("n > 1").select(A, "seq", "ref", "amount_c")


def surplus(rows: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """(*keys, copies): what EXCEPT ALL leaves of the keys of rows where `left` holds when those where `right` holds are
    taken away, a row for each distinct key with its number of copies. One aggregation, as both sides are one table."""
    return rows.groupBy(*keys).agg((F.count_if(left) - F.count_if(right)).alias("copies")).where("copies > 0")

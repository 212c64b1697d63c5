"""Irregularity detectors over a classified ledger. Each gives (account_id, detector, severity, hits, amount_c),
one row for each account it flags, from one aggregation with conditional sums where it can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import joins, timeline

A = "account_id"
#: Points and weights of severities; so are the bounds, severities and confidences of the detectors.
POINTS = {"LOW": 15, "MEDIUM": 40, "HIGH": 85, "CRITICAL": 200}
WEIGHTS = {"LOW": 2.5, "MEDIUM": 6.0, "HIGH": 15.0, "CRITICAL": 35.0}


#: Fixed: narrations of payments that were dishonoured, and of returned deposits, which are none.
INWARD = r"\bCHQ\s+(?:RET(?:URN)?|RTN)\b|\bINW(?:ARD)?\s+(?:RET(?:URN)?|RTN|CLG\s+RET)\b|\bNACH\s+(?:RET(?:URN)?|RTN|REJECT|FAIL)\b|\bECS\s+(?:RET(?:URN)?|RTN|REJECT|FAIL)\b|\bBOUNCE\s+CH(?:AR)?G|\bRETURN\s+CH(?:AR)?G|\bRET(?:URN)?\s+CHARGES?\b|\bDISHONO?UR\b|\bMANDATE\s+(?:REJECT|FAIL|RETURN)\b|\bINSUFFICIENT\s+FUNDS?\b|\bCHEQUE\s+BOUNCE\b|\bCHQ\s+BOUNCE\b|\bACH\s+DEBIT\s+RETURN\b"
OUTWARD = r"\b(?:OUT(?:WARD)?\s+RET|DEP\s+RET|CLG\s+RET\s+DEP)\b"


def is_bounce(description: Column) -> Column:
    u = F.upper(F.coalesce(description, F.lit("")))
    # Every form of INWARD holds one of these words; the regular expressions run only where one is.
    return text.holds(u, "RET|RTN|REJECT|FAIL|BOUNCE|DISHON|INSUFFICIENT") & u.rlike(INWARD) & ~u.rlike(OUTWARD)


def _cash(d: Column) -> Column:
    return F.contains(F.upper(d), F.lit("CASH WDL"))


def row_detectors() -> list[tuple[str, Column, int, str, float]]:
    """(name, row condition, least hits, severity, confidence) of detectors that count rows."""
    debit, credit, amount = F.col("debit_c"), F.col("credit_c"), F.col("debit_c") + F.col("credit_c")
    d = F.col("description")
    return [
        ("structuring", _cash(d) & amount.between(4_000_000, 5_000_000), 2, "HIGH", 0.85),
        ("high_structuring", amount.between(9_000_000, 10_000_000), 1, "HIGH", 0.92),
        ("cash_cycling", _cash(d) & (debit >= 2_500_000), 3, "MEDIUM", 0.75),
        ("inward_bounce", is_bounce(d), 1, "HIGH", 0.95),
        ("rtgs_minimum", F.upper(d).startswith("RTGS") & (debit > 0) & (debit < 20_000_000), 1, "MEDIUM", 0.85),
        ("round_tax", F.contains(F.upper(d), F.lit("TAX")) & (debit > 0) & (debit % 100_000 == 0), 2, "LOW", 0.70),
        ("atm_high", _cash(d) & (debit >= 5_000_000), 1, "MEDIUM", 0.80),
        ("negative_balance", F.col("balance_c") < 0, 1, "HIGH", 0.95),
    ]


def _row_sums() -> list[Column]:
    rules = row_detectors()
    return [x for i, (_, test, *_rest) in enumerate(rules) for x in (F.count_if(test).alias(f"n{i}"), F.sum(F.when(test, F.col("debit_c") + F.col("credit_c")).otherwise(0)).alias(f"a{i}"))]


def _flag(test: Column, name: str, severity: Column | str, sure: float, hits: Column, amount: Column) -> Column:
    return F.when(test, F.struct(F.lit(name).alias("detector"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.lit(sure).alias("confidence"), hits.cast("long").alias("hits"), amount.cast("long").alias("amount_c")))


def _row_flags() -> list[Column]:
    out = []
    for i, (name, _, least, severity, sure) in enumerate(row_detectors()):
        n = F.col(f"n{i}")
        grade = F.when(n >= 2, "CRITICAL").otherwise(severity) if name == "inward_bounce" else F.lit(severity)
        out.append(_flag(n >= least, name, grade, sure, n, F.col(f"a{i}")))
    return out


def simple_flags(ledger: DataFrame) -> DataFrame:
    """All detectors that count rows in one pass: an aggregation with a pair of sums for each."""
    return ledger.groupBy(A).agg(*_row_sums()).select(A, F.inline(F.array_compact(F.array(*_row_flags()))))


def round_amounts(ledger: DataFrame) -> DataFrame:
    """Debits over 10 000 that are whole thousands: five or more and over a quarter of all rows."""
    s = ledger.groupBy(A).agg(F.count("*").alias("n"), *_account_sums())
    return s.where(_ROUND).select(A, F.col("round_n").alias("hits"), F.col("round_c").alias("amount_c"))


def _account_sums() -> list[Column]:
    """Sums that the detectors of whole accounts share."""
    whole, d = (F.col("debit_c") > 1_000_000) & (F.col("debit_c") % 100_000 == 0), F.col("description")
    total = lambda test, of: F.sum(F.when(test, F.col(of)).otherwise(0))
    return [F.count_if(whole).alias("round_n"), total(whole, "debit_c").alias("round_c"), total(_cash(d), "credit_c").alias("cash_c"), total(F.contains(F.upper(d), F.lit("SALARY")), "credit_c").alias("salary_c"), F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c")]


_ROUND = "round_n >= 5 and round_n * 4 > n"
_CASH = "salary_c > 0 and cash_c * 2 > salary_c * 3"
_EQUAL = "n >= 15 and in_c > 10000000 and abs(in_c - out_c) * 50 < in_c"


def mad_outliers(ledger: DataFrame, bound: float = 6.0, least: int = 10) -> DataFrame:
    """Debits whose distance from the account's median is over `bound` scaled median deviations; payments to
    obligations count for the median, but are no outliers where the ledger is classified. Both medians are
    windows over one placing of the debits by account, so no table of accounts is joined or broadcast."""
    free = ~joins.is_obligation(F.col("category"), F.col("subcategory")) if "category" in ledger.columns else F.lit(True)
    debits = ledger.where(F.col(A).isNotNull() & (F.col("debit_c") > 0)).select(A, "seq", "debit_c", free.alias("free"))
    own = Window.partitionBy(A)
    far = debits.select("*", F.median("debit_c").over(own).alias("median"), F.count("*").over(own).alias("n")).withColumn("dev", F.abs(F.col("debit_c") - F.col("median")))
    return far.withColumn("mad", F.median("dev").over(own)).where(F.col("free") & (F.col("n") >= least) & (F.col("mad") > 0) & (0.6745 * F.col("dev") > bound * F.col("mad"))).select(A, "seq", "debit_c")


def concentration(ledger: DataFrame, share: float = 0.45) -> DataFrame:
    """Accounts with one payee above `share` of all debits; banks, brokers and provident funds are none."""
    per = ledger.where(F.col("debit_c") > 0).groupBy(A, "counterparty").agg(F.sum("debit_c").alias("v"))
    s = per.groupBy(A).agg(F.sum("v").alias("total"), F.max("v").alias("amount_c"), F.max_by("counterparty", F.struct("v", "counterparty")).alias("top"))
    return s.where((F.col("amount_c") * 100 > F.col("total") * int(share * 100)) & ~F.coalesce(F.col("top").rlike("HDFC|ICICI|SBI|EBA_|PPF"), F.lit(False))).select(A, "top", "amount_c")


def cash_against_salary(ledger: DataFrame) -> DataFrame:
    """Cash credits above one and a half times the salary."""
    return ledger.groupBy(A).agg(*_account_sums()).where(_CASH).select(A, "cash_c", "salary_c")


def equal_flows(ledger: DataFrame) -> DataFrame:
    """Credits and debits of 15 rows or more that differ by less than two percent."""
    return ledger.groupBy(A).agg(F.count("*").alias("n"), F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c")).where(_EQUAL)


def all_flags(ledger: DataFrame) -> DataFrame:
    """(account_id, detector, severity, confidence, hits, amount_c) of every detector over a classified ledger. What
    conditional sums can tell is one aggregation; the other detectors need pairs, medians or an order of rows."""
    as_flag = lambda df, name, severity, sure: df.select(A, F.lit(name).alias("detector"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"), F.col("hits"), F.col("amount_c"))
    one = F.lit(1)
    whole = [
        _flag(F.expr(_ROUND), "round_amounts", "LOW", 0.65, F.col("round_n"), F.col("round_c")), _flag(F.expr(_CASH), "cash_vs_salary", "MEDIUM", 0.80, one, F.col("cash_c")), _flag(F.expr(_EQUAL), "equal_flows", "LOW", 0.75, one, F.col("in_c")),
    ]
    summed = ledger.groupBy(A).agg(F.count("*").alias("n"), *_account_sums(), *_row_sums()).select(A, F.inline(F.array_compact(F.array(*_row_flags(), *whole))))
    mad = mad_outliers(ledger).groupBy(A).agg(F.count("*").alias("hits"), F.sum("debit_c").alias("amount_c")).where("hits >= 3")
    rapid = joins.rapid_transfers(ledger).groupBy(A).agg(F.count("*").alias("hits"), F.sum("debit_c").alias("amount_c"))
    both = joins.two_sided(ledger).groupBy(A).agg(F.count("*").alias("hits"), F.sum("mirrored_c").alias("amount_c"))
    chain = timeline.velocity(ledger.where(_cash(F.col("description")) & (F.col("debit_c") >= 2_000_000))).groupBy(A).agg(F.count("*").alias("hits"), F.sum("debit_c").alias("amount_c"))
    top = concentration(ledger).select(A, one.cast("long").alias("hits"), "amount_c")
    parts = [
        summed, as_flag(mad, "mad_outlier", "MEDIUM", 0.80), as_flag(rapid, "rapid_pass_through", "HIGH", 0.88), as_flag(both, "circular_mirroring", "HIGH", 0.90),
        as_flag(chain, "atm_velocity", "MEDIUM", 0.85), as_flag(top, "concentration", "MEDIUM", 0.72),
    ]
    return reduce(DataFrame.unionByName, parts)


def _by_severity(table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(F.col("severity") == k, F.lit(float(v))).otherwise(out)
    return out


def fraud_score(flags: DataFrame) -> DataFrame:
    """Weights times confidence up to 100 with a risk level, and penalty points that compound from three high
    flags on; also how many flags are of mirrored money and of structuring."""
    high = F.count_if(F.col("severity").isin("HIGH", "CRITICAL"))
    s = flags.groupBy(A).agg(F.least(F.lit(100.0), F.sum(_by_severity(WEIGHTS) * F.col("confidence"))).alias("raw"), F.sum(_by_severity(POINTS)).alias("points"), high.alias("high_flags"), F.count("*").alias("flags"), F.count_if(F.col("detector") == "circular_mirroring").alias("mirrored"), F.count_if(F.col("detector").isin("structuring", "high_structuring")).alias("structured"))
    points = F.col("points") * F.when(F.col("high_flags") >= 3, 1.25).otherwise(1.0)
    level = F.when(F.col("raw") >= 65, "CRITICAL").when(F.col("raw") >= 40, "HIGH").when(F.col("raw") >= 20, "MEDIUM").otherwise("LOW")
    return s.select(A, F.round(F.col("raw"), 3).alias("fraud_score"), level.alias("risk"), F.round(points).cast("long").alias("penalty_points"), "high_flags", "flags", "mirrored", "structured")


def state_windows(ledger: DataFrame, days: tuple[int, ...] = (30, 90, 180, 365)) -> DataFrame:
    """Measures over trailing windows that end at an account's last date, both ends included. Each row is
    expanded into the windows it is in; a last date per account is joined, not a product of tables."""
    end = F.max("d").over(Window.partitionBy(A))
    aged = ledger.withColumn("age", F.datediff(end, "d"))
    spread = aged.withColumn("days", F.explode(F.filter(F.array(*[F.lit(x) for x in days]), lambda x: x >= F.col("age"))))
    return spread.groupBy(A, "days").agg(F.count("*").alias("n"), F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c"), F.max("debit_c").alias("largest_c"), F.countDistinct("ym").alias("months"))

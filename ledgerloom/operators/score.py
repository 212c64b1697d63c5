"""Scores, decisions, sizing and checks: one row for each account, chained CASE expressions over features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import clamp, ratio
from ledgerloom.operators import classify, debt, engines, fraud, risk, timeline
from ledgerloom.sources.tables import shared_copy

A = "account_id"


#: What the score is made of, with the value of an input that no engine gave.
INPUTS = {
    "discipline_pct": 100.0, "foir": 0.0, "volatility": 0.0, "mean_balance_c": 0, "penalty_points": 0, "high_flags": 0, "negative_days": 0, "bounces": 0, "bounce_rate": 0.0, "trajectory": "STABLE",
    "invested_c": 0, "income_c": 0, "sip_count": 0, "long_term": 0.0, "history_days": 0, "fraud_score": 0.0, "aml_band": "LOW",
}


def steps() -> list[tuple[str, Column]]:
    """(name, points) of each adjustment to the base of 1000. Bounds and points are fixed values."""
    c = F.col
    calm = c("mean_balance_c") >= 10_000_000
    share = F.when(c("income_c") > 0, c("invested_c") / c("income_c")).otherwise(0.0)
    return [
        ("discipline", F.when(c("discipline_pct") < 70, -250).when(c("discipline_pct") < 90, -100).otherwise(0)),
        ("foir", F.when(c("foir") > 0.75, -180).when(c("foir") > 0.60, -90).when(c("foir") > 0.45, -40).otherwise(0)),
        ("volatility", F.when(c("volatility") >= 0.90, F.when(calm, -140).otherwise(-160)).when(c("volatility") > 0.70, F.when(calm, -80).otherwise(-120)).when(c("volatility") > 0.45, F.when(calm, -30).otherwise(-60)).when(c("volatility") > 0.20, F.when(calm, -10).otherwise(-20)).otherwise(0)),
        ("penalties", -(F.least(F.greatest(c("penalty_points"), F.lit(0)), F.lit(700)) + F.when(c("high_flags") >= 3, 100).otherwise(0))),
        ("negative_days", F.when(c("negative_days") > 0, -F.least(F.lit(150), 60 + 20 * c("negative_days"))).otherwise(0)),
        ("bounces", F.when((c("bounces") >= 2) | (c("bounce_rate") > 10), -150).when(c("bounces") == 1, -60).otherwise(0)),
        ("trajectory", F.when(c("trajectory") == "POSITIVE", 20).when(c("trajectory") == "NEGATIVE", -40).otherwise(0)),
        ("investments", F.when((c("invested_c") >= 20_000_000) | (share >= 0.15), 50).when((c("invested_c") >= 5_000_000) | (c("sip_count") >= 3) | (c("long_term") >= 0.5), 30).otherwise(0)),
    ]


def features(ledger: DataFrame) -> DataFrame:
    """INPUTS of the score for each account, from a classified ledger. What can be summed in one pass is; no engine
    gives a bounce rate, so it keeps its default."""
    income = (F.col("category") == "Income") & (F.col("subcategory") != "Refund") & ~F.col("is_return")
    base = ledger.groupBy(A).agg(
        F.datediff(F.max("d"), F.min("d")).alias("history_days"), F.count_if(F.contains(F.upper("description"), F.lit("RETURN CHARGES"))).alias("bounces"), F.sum("credit_c").alias("turnover_c"),
        F.sum(F.when(F.col("category") == "Investment", F.col("debit_c")).otherwise(0)).alias("invested_c"), F.sum(F.when(income, F.col("credit_c")).otherwise(0)).alias("income_c"), F.sum(F.when(income & (F.col("subcategory") == "Salary"), F.col("credit_c")).otherwise(0)).alias("salary_c"),
        F.countDistinct(F.when(income, F.col("ym"))).alias("income_months"), F.sum(F.when(F.col("subcategory") == "Loan EMI", F.col("debit_c")).otherwise(0)).alias("owed_c"), F.sum(F.when((F.col("category") != "Transfer") & ~F.col("is_return"), F.col("credit_c")).otherwise(0)).alias("true_income_c"),
    )
    base = base.withColumn("foir", F.round(ratio(F.col("owed_c"), F.col("true_income_c")), 4)).drop("owed_c", "true_income_c")
    balance = engines.balance_summary(timeline.stretches(ledger)).select(A, "negative_days", "volatility", F.round(F.col("sum_c") / F.col("days")).cast("long").alias("mean_balance_c"))
    marks = risk.aml_score(fraud.fraud_score(fraud.all_flags(ledger))).select(A, "fraud_score", "penalty_points", "high_flags", "aml_band")
    plans = ledger.where((F.col("category") == "Investment") & (F.col("debit_c") > 0))
    sips = engines.sip_clusters(plans).groupBy(A).agg(F.count("*").alias("sip_count"))
    paid = debt.discipline(debt.loans(classify.lenders(ledger), ledger.groupBy(A).agg(F.max("d").alias("end_d")))).select(A, F.col("pct").alias("discipline_pct"))
    out = base.join(balance, A).join(engines.trajectory(ledger), A)
    for more in (marks, sips, engines.long_term_score(plans), paid):
        out = out.join(more, A, "left")
    return out.withColumn("bounce_rate", F.lit(0.0)).fillna({k: v for k, v in INPUTS.items() if k != "foir"})


def composite(f: DataFrame) -> DataFrame:
    """The score with each step's points, the decision (the first rung that fits) and its band. f: account_id and
    INPUTS. Stops come first: fraud, then AML risk, bounces and many grave flags, which also cap the score."""
    items = F.array(*[F.struct(F.lit(n).alias("step"), F.coalesce(p, F.lit(0)).cast("long").alias("points")) for n, p in steps()])
    total = F.aggregate("items", F.lit(1000).cast("long"), lambda a, x: a + x["points"])
    s = f.withColumn("items", items).withColumn("raw", clamp(F.when(F.col("history_days") < 90, F.least(total, F.lit(720))).otherwise(total), 0, 1000).cast("long"))
    stops = [
        ("REJECT_FRAUD_DETECTED", "CRITICAL_FRAUD_RISK", None, (F.col("aml_band") == "CRITICAL") | (F.col("fraud_score") >= 50)), ("REJECT_HIGH_AML_RISK", "HIGH_RISK", 450, F.col("aml_band") == "HIGH"),
        ("REJECT_REPAYMENT_DEFAULT", "HIGH_RISK", 450, F.col("bounces") >= 2), ("REJECT_MULTIPLE_IRREGULARITIES", "HIGH_RISK", 480, F.col("high_flags") >= 3),
    ]
    rungs = [("APPROVE_FAST_TRACK", "VERY_LOW_RISK", 800), ("APPROVE_STANDARD", "LOW_RISK", 650), ("MANUAL_REVIEW", "MODERATE_RISK", 500), ("REJECT", "HIGH_RISK", 300), ("DECLINE", "VERY_HIGH_RISK", 0)]
    verdict = lambda decision, band, score: F.struct(F.lit(decision).alias("decision"), F.lit(band).alias("band"), (F.lit(None) if score is None else score).cast("long").alias("score"))
    tests = [(test, verdict(d, b, None if cap is None else F.least(F.col("raw"), F.lit(cap)))) for d, b, cap, test in stops] + [(F.col("raw") >= low, verdict(d, b, F.col("raw"))) for d, b, low in rungs]
    v = F.coalesce(*[F.when(test, x) for test, x in tests])
    return s.withColumn("v", v).select(A, "raw", "v.score", "v.decision", "v.band", "items")


def itemised(scored: DataFrame) -> DataFrame:
    """A row for each step of each account; with the base they add up to the score before caps and clamps."""
    return scored.select(A, F.inline("items"))


def present_value(payment: Column, annual_pct: Column, months: Column) -> Column:
    """The loan that an instalment of cents repays, in cents."""
    r = annual_pct / 1200
    return F.when(payment > 0, F.round(payment * (1 - F.pow(1 + r, -months)) / r)).otherwise(0.0)


def instalment(principal: Column, annual_pct: Column, months: Column) -> Column:
    r = annual_pct / 1200
    growth = F.pow(1 + r, months)
    return F.when(principal > 0, F.round(principal * r * growth / (growth - 1))).otherwise(0.0)


def _tens(amount: Column) -> Column:
    """Cents to the nearest 10 000 units, halves to even."""
    return F.bround(amount / 1_000_000) * 1_000_000


def eligibility(f: DataFrame) -> DataFrame:
    """The facility that an account can be offered, in cents. f: account_id, decision, score, income_c, salary_c,
    income_months, turnover_c (true), mean_balance_c, foir, bounces, volatility_band, liquid_c (investments and a year
    of savings and plans) and, if asked for, requested_c.

    Nothing is offered after a rejection. Salaried accounts (half of all income) are sized by the room under a cap on
    instalments over income; others by 18 percent of turnover or three times the mean balance. Wealth raises the
    offer, bounces and weak scores cut it, and it is held under the cap. Bounds and rates are fixed values."""
    c = F.col
    one = lambda name, value: {name: value.cast("double")}
    f = f if "requested_c" in f.columns else f.withColumn("requested_c", F.lit(None).cast("long"))
    f = f.withColumns(one("monthly", F.coalesce(F.try_divide(c("income_c").cast("double"), c("income_months")), F.lit(0.0))) | one("owed", F.greatest(F.coalesce("foir", F.lit(0.0)), F.lit(0.0))))
    f = f.withColumn("salaried", (c("income_c") > 0) & (c("salary_c") * 2 >= c("income_c")))
    f = f.withColumns(one("cap", F.when(c("salaried"), F.when(c("monthly") >= 10_000_000, 0.60).otherwise(0.50)).otherwise(0.65)) | one("rate0", F.when(c("salaried"), 12.0).otherwise(13.5)))
    f = f.withColumn("months", F.when(~c("salaried") & c("volatility_band").isin("HIGH", "SEVERE"), 36).otherwise(48))
    room = c("monthly") * F.greatest(c("cap") - c("owed"), F.lit(0.0))
    trade = F.greatest(c("turnover_c") * 0.18, c("mean_balance_c") * 3.0)
    f = f.withColumns(one("base", _tens(F.when(c("salaried"), present_value(room, F.lit(12.0), F.lit(48))).otherwise(trade))) | one("limit", _tens(F.when(c("salaried"), present_value(room, F.lit(12.0), F.lit(60))).otherwise(trade * 1.25))))
    rich, some = (c("base") > 0) & (c("liquid_c") >= c("base") * 1.5), (c("base") > 0) & (c("liquid_c") >= c("base") * 0.5)
    f = f.withColumn("cushion", F.when(rich, "STRONG").when(some, "MODERATE").otherwise("LIMITED"))
    level = lambda strong, moderate: F.when(c("cushion") == "STRONG", strong).when(c("cushion") == "MODERATE", moderate).otherwise(0.0)
    f = f.withColumns(one("rate", F.greatest(F.lit(9.5), c("rate0") - level(0.50, 0.25))) | one("raised", _tens(c("base") * (1.0 + level(15.0, 5.0) / 100.0))))
    score = F.coalesce("score", F.lit(750))
    f = f.withColumns(one("cut", F.greatest(F.when(c("bounces") >= 2, 80.0).when(c("bounces") == 1, 20.0).otherwise(0.0), F.when(score < 500, 70.0).when(score < 650, 25.0).otherwise(0.0))))
    offer = _tens(c("raised") * (1.0 - c("cut") / 100.0))
    offer = F.least(offer, F.when(c("bounces") >= 2, 5_000_000.0).otherwise(offer), F.when(c("requested_c") > 0, _tens(c("requested_c"))).otherwise(offer))
    f = f.withColumns(one("offer", offer) | one("earning", F.greatest(c("monthly"), c("turnover_c") / 12.0, F.lit(100.0))))
    spare = F.greatest(F.lit(0.0), (c("cap") - c("owed")) * c("earning"))
    held = _tens(present_value(spare, c("rate"), c("months")))
    f = f.withColumn("final", F.when((c("offer") > 0) & (instalment(c("offer"), c("rate"), c("months")) > spare), F.least("offer", held)).otherwise(c("offer")))
    no = F.coalesce(c("decision").startswith("REJECT") | c("decision").startswith("DECLINE"), F.lit(False))
    sized = lambda x, none: F.when(no, none).otherwise(x)
    emi = instalment(c("final"), c("rate"), c("months"))
    return f.select(
        A, F.when(no, "NO_FACILITY").when(c("final") > 0, "SIZED").otherwise("NO_HEADROOM").alias("status"), F.when(no, "Not assessed").when(c("salaried"), "Salaried").otherwise("MSME_Self_Employed").alias("borrower"),
        sized(c("final"), 0).cast("long").alias("offer_c"), sized(F.greatest("limit", "final"), 0).cast("long").alias("limit_c"), sized(c("months"), None).cast("long").alias("months"), sized(emi, 0).cast("long").alias("emi_c"), sized(c("rate"), None).alias("rate"),
        F.when(no | (c("final") <= 0), "No facility recommended").when(c("salaried"), "Unsecured Personal Loan").when(c("volatility_band") == "LOW", "MSME Working Capital Dropline Overdraft").otherwise("MSME Business Term Loan").alias("product"),
        sized(c("cushion"), None).alias("cushion"), sized(c("cut"), None).alias("cut_pct"), sized(F.round(c("owed") + emi / c("earning") + 1e-9, 4), None).alias("foir_after"),
    )


def data_sufficiency(ledger: DataFrame) -> DataFrame:
    """Months of history and whether they are enough: under 6, 6 to 24, over 24."""
    s = ledger.groupBy(A).agg((F.datediff(F.max("d"), F.min("d")) + 1).alias("days"), F.count("*").alias("n"))
    months = F.col("days") / 30.4375
    return s.select(A, "days", "n", F.when(months < 6, "INSUFFICIENT").when(months <= 24, "SUFFICIENT").otherwise("RICH").alias("sufficiency"))


def ledger_checks(ledger: DataFrame, tolerance_c: int = 100) -> DataFrame:
    """(account_id, check, passed, off_c): rows and totals of a ledger that must agree."""
    ends = engines.opening_closing(ledger)
    s = ledger.groupBy(A).agg(F.sum("credit_c").alias("cr"), F.sum("debit_c").alias("db"), F.count_if((F.col("debit_c") > 0) & (F.col("credit_c") > 0)).alias("both"), F.count_if((F.col("debit_c") == 0) & (F.col("credit_c") == 0)).alias("neither")).join(ends, A)
    breaks = timeline.chain_mismatches(ledger).groupBy(A).agg(F.count("*").alias("breaks"))
    monthly = engines.monthly_cashflow(ledger).groupBy(A).agg(F.sum("net_c").alias("net"))
    s = s.join(monthly, A).join(breaks, A, "left").fillna({"breaks": 0})
    check = lambda name, off: F.struct(F.lit(name).alias("check"), (F.abs(off) <= tolerance_c).alias("passed"), off.cast("long").alias("off_c"))
    c = F.col
    return s.select(A, F.inline(F.array(check("conservation", c("opening_c") + c("cr") - c("db") - c("closing_c")), check("monthly_net", c("net") - (c("cr") - c("db"))), check("balance_chain", c("breaks") * (tolerance_c + 1)), check("one_side", (c("both") + c("neither")) * (tolerance_c + 1)))))


def reconciliation(ledger: DataFrame, tolerance_c: int = 100) -> DataFrame:
    """(account_id, check, passed, expected_c, actual_c): what the engines say of a classified ledger against its rows:
    the movement of the balance, net cash flow, savings, credits as income or something else, spending as needs or
    wants (where there is spending), and debits that have a category."""
    c, spent = F.col, F.col("category") == "Expense"
    ledger = shared_copy(ledger.select(A, "seq", "ym", "debit_c", "credit_c", "balance_c", "category", "subcategory", "needs_wants", "is_return"), "reconciled")
    income = (c("category") == "Income") & (c("subcategory") != "Refund") & ~c("is_return")
    total = lambda test, of: F.sum(F.when(test, c(of)).otherwise(0))
    s = ledger.groupBy(A).agg(
        F.sum("credit_c").alias("cr"), F.sum("debit_c").alias("db"), total(income, "credit_c").alias("income"), total(~F.coalesce(income, F.lit(False)), "credit_c").alias("other"), total(spent, "debit_c").alias("expense"),
        total(spent & c("needs_wants").isin("Need", "Want"), "debit_c").alias("labelled"), total(c("category").isNotNull(), "debit_c").alias("bucketed"),
    )
    s = s.join(engines.opening_closing(ledger), A).join(engines.cashflow_summary(ledger).select(A, "net_c"), A).join(engines.savings_summary(ledger).select(A, "saved_c"), A)
    move = c("cr") - c("db")
    tests = [
        ("ledger_balance_movement", c("closing_c"), c("opening_c") + move), ("net_cash_flow_matches_ledger", move, c("net_c")), ("savings_matches_ledger", move, c("saved_c")), ("credit_conservation", c("cr"), c("income") + c("other")),
        ("needs_plus_wants_equals_expense", c("expense"), c("labelled")), ("all_debits_bucketed", c("db"), c("bucketed")),
    ]
    check = lambda name, expected, actual: F.struct(F.lit(name).alias("check"), (F.abs(expected - actual) <= tolerance_c).alias("passed"), expected.cast("long").alias("expected_c"), actual.cast("long").alias("actual_c"))
    every = F.array(*[F.when(c("expense") > 0, check(*t)) if t[0].startswith("needs") else check(*t) for t in tests])
    return s.select(A, F.inline(F.array_compact(every)))


def fidelity(ledger: DataFrame, anchors: DataFrame) -> DataFrame:
    """Printed facts against the ledger: VERIFIED, FAILED, or UNVERIFIED where nothing is printed. anchors:
    (account_id, a_debit_c, a_credit_c, a_rows)."""
    s = ledger.groupBy(A).agg(F.sum("debit_c").alias("debit"), F.sum("credit_c").alias("credit"), F.count("*").alias("n")).join(anchors, A, "left")
    status = lambda a, b: F.when(a.isNull(), "UNVERIFIED").when(a == b, "VERIFIED").otherwise("FAILED")
    return s.select(A, status(F.col("a_debit_c"), F.col("debit")).alias("debits"), status(F.col("a_credit_c"), F.col("credit")).alias("credits"), status(F.col("a_rows"), F.col("n")).alias("row_count"))


def gate(scored: DataFrame, checks: DataFrame) -> DataFrame:
    """Scores whose account fails a check are withheld."""
    bad = checks.groupBy(A).agg(F.count_if(~F.col("passed")).alias("failed"))
    return scored.join(bad, A, "left").select(A, F.when(F.coalesce("failed", F.lit(0)) == 0, F.col("score")).alias("score"), F.when(F.coalesce("failed", F.lit(0)) == 0, F.col("decision")).otherwise("INTEGRITY_REVIEW").alias("decision"))

"""Loans mined from payments to lenders: facilities, their life cycle, the portfolio and the discipline of paying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import ratio
from ledgerloom.operators.streams import walk_groups

A = "account_id"
#: Amounts of one facility are within 100.00 or 2 percent of its first; ages in days of a life cycle.
FLOOR_C, PERCENT, GRACE = 10_000, 2, (35, 65, 95)


def facility_rows(payments: DataFrame, floor_c: int = FLOOR_C, percent: int = PERCENT) -> DataFrame:
    """(account_id, lender, seq, day, v, facility): each payment joins the first facility of its lender, in order of
    date, whose first amount is within the tolerance, else it opens one."""
    own = payments.where((F.col("debit_c") > 0) & (F.trim("lender") != "")).select(A, "lender", F.unix_date("d").alias("day"), F.col("seq").cast("long").alias("seq"), F.col("debit_c").alias("v"))

    def walk(held: list[tuple]) -> list[tuple]:
        firsts: list[int] = []
        out = []
        for day, seq, v in held:
            at = next((i for i, x in enumerate(firsts) if abs(v - x) * 100 <= max(100 * floor_c, percent * x)), len(firsts))
            if at == len(firsts):
                firsts.append(v)
            out.append((seq, day, v, at))
        return out

    return walk_groups(own, [A, "lender"], ["day", "seq"], walk, {"seq": "long", "day": "int", "v": "long", "facility": "int"})


def loan_type(lender: Column, emi_c: Column) -> Column:
    """By the lender's name and the instalment; fixed order."""
    u = F.upper(lender)
    return F.when(u.rlike("HL|HOUSING") | (emi_c > 2_000_000), "HOME_LOAN").when(u.rlike("AUTO|VEHICLE"), "VEHICLE_LOAN").when(u.rlike("MUTHOOT|MANAPPURAM"), "GOLD_LOAN").otherwise("PERSONAL_LOAN")


def loans(payments: DataFrame, ends: DataFrame, borrowings: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Facilities of `least` or more payments as loans: mean instalment, type, life cycle by days since the last
    payment, the most frequent regularity of gaps (ties: in the order below), expected and missed payments, the next
    three dates, and whether money came in from the lender (a top-up). ends: (account_id, end_d)."""
    rows = facility_rows(payments)
    f = rows.groupBy(A, "lender", "facility").agg(F.count("*").alias("n"), F.sum("v").alias("paid_c"), F.min("day").alias("first"), F.max("day").alias("last"), F.array_sort(F.collect_list("day")).alias("days")).where(F.col("n") >= least)
    gaps = F.transform(F.sequence(F.lit(1), F.size("days") - 1), lambda i: F.element_at("days", i + 1) - F.element_at("days", i))
    named = F.transform(gaps, lambda g: F.when(g < 27, "2Early").when(g <= 33, "1On-Time").when(g <= 40, "3Late").otherwise("4Skipped/Irregular"))
    kinds = ("1On-Time", "2Early", "3Late", "4Skipped/Irregular")
    most = F.array_max(F.array(*[F.struct((F.size("named") - F.size(F.array_remove("named", k))).alias("n"), F.lit(-i).alias("order"), F.lit(k[1:]).alias("name")) for i, k in enumerate(kinds)]))["name"]
    age = F.datediff("end_d", F.date_from_unix_date("last"))
    status = F.when(age <= GRACE[0], "Active").when(age <= GRACE[1], "Grace").when(age <= GRACE[2], "Missed EMI").otherwise("Overdue / Closed")
    emi = F.round(F.col("paid_c").cast("double") / F.col("n")).cast("long")
    expected = F.greatest(F.col("n"), F.bround((F.col("last") - F.col("first")) / 30.0).cast("long") + 1)
    j = f.withColumn("named", named).join(ends, A).withColumn("emi_c", emi).withColumn("loan_type", loan_type(F.col("lender"), emi))
    out = j.select(
        A, "lender", "facility", "n", "emi_c", "loan_type", F.col("loan_type").isin("HOME_LOAN", "VEHICLE_LOAN", "GOLD_LOAN").alias("secured"), status.alias("status"), most.alias("regularity"),
        (expected - F.col("n")).alias("missed"), F.date_from_unix_date("first").alias("first_d"), F.date_from_unix_date("last").alias("last_d"),
        F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.date_add(F.date_from_unix_date("last"), 30 * i)).alias("next_d"),
    )
    if borrowings is None:
        return out.withColumn("top_up", F.lit(False))
    from_lender = borrowings.select(A, "lender").distinct().withColumn("top_up", F.lit(True))
    return out.join(from_lender, [A, "lender"], "left").withColumn("top_up", F.coalesce("top_up", F.lit(False)))


def portfolio(loan: DataFrame, income: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """One row an account: instalments of active loans, obligations with a tenth of the mean card payment, burdens
    of monthly income (null where it is unknown), concentration, secured share, stacking. income: (account_id,
    monthly_c); cards: (account_id, card_c), the mean payment."""
    active = F.col("status").isin("Active", "Grace")
    p = loan.groupBy(A).agg(
        F.count("*").alias("loans"), F.count_if(active).alias("active"), F.countDistinct("lender").alias("lenders"), F.sum(F.when(active, F.col("emi_c")).otherwise(0)).alias("emi_c"), F.max(F.when(active, F.col("emi_c"))).alias("top_c"),
        F.count_if("secured").alias("secured"), F.count_if((F.col("status") == "Active") & (F.col("n") <= 3)).alias("recent"), F.count_if(F.col("status") == "Missed EMI").alias("missed_loans"),
    )
    j = p.join(income, A, "left")
    j = j.join(cards, A, "left") if cards is not None else j.withColumn("card_c", F.lit(0.0))
    owed = F.col("emi_c") + F.coalesce("card_c", F.lit(0.0)) * 0.10
    known = F.when(F.col("monthly_c") > 0, F.col("monthly_c"))
    return j.select(
        A, "loans", "active", "lenders", "emi_c", F.round(F.try_divide(F.col("emi_c").cast("double"), known) + 1e-9, 4).alias("foir"), F.round(F.try_divide(owed, known) + 1e-9, 4).alias("dti"),
        F.round(F.coalesce(ratio(F.col("top_c"), F.col("emi_c")), F.lit(0.0)) + 1e-9, 4).alias("concentration"), F.round(F.col("secured") / F.col("loans") + 1e-9, 2).alias("secured_share"), "recent", (F.col("recent") >= 2).alias("stacking"), "missed_loans",
    )


def discipline(loan: DataFrame) -> DataFrame:
    """Paid over due instalments in percent with its band."""
    s = loan.groupBy(A).agg(F.sum("n").alias("paid"), F.sum("missed").alias("missed"))
    pct = F.round(F.col("paid") * 100.0 / (F.col("paid") + F.col("missed")) + 1e-9, 2)
    return s.withColumn("pct", pct).withColumn("band", F.when(F.col("pct") >= 90, "GOOD").when(F.col("pct") >= 70, "FAIR").otherwise("POOR"))


def lender_profiles(loan: DataFrame) -> DataFrame:
    """Loans by lender: active and closed, the instalments of active ones, and the types, sorted."""
    active = F.col("status").isin("Active", "Grace")
    return loan.groupBy("lender").agg(F.count_if(active).alias("active"), F.count_if(~active).alias("closed"), F.sum(F.when(active, F.col("emi_c")).otherwise(0)).alias("emi_c"), F.array_join(F.array_sort(F.collect_set("loan_type")), ",").alias("types"))


def schedule(loan: DataFrame) -> DataFrame:
    """The next expected instalments of active loans, one row a date."""
    return loan.where(F.col("status").isin("Active", "Grace")).select(A, "lender", "facility", "loan_type", "emi_c", F.explode("next_d").alias("expected_d"))

"""Printed facts against parsed rows, sheets of one kind of rows, cheques, and scores of the specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import ratio
from ledgerloom.operators import timeline

A = "account_id"
#: Fixed: cents by which a printed figure may differ, and subcategories of business.
TOLERANCE_C = 100
BUSINESS = ("Sales & Marketing", "Office Expenses", "Business", "Vendor", "Supplier")


def fidelity(ledger: DataFrame, anchors: DataFrame) -> DataFrame:
    """(account_id, status, anchors_found, failed, checks): the rows against what the statement prints, up to twelve
    checks of which only those are made whose facts are there. status: FAILED, VERIFIED, or UNVERIFIED where no figure
    is printed (or there are no rows).

    anchors, a row for each account, columns null where nothing is printed: opening_c, closing_c, debits_c, credits_c,
    rows, serial_gaps (missing numbers of a serial column), period_start, period_end, pages_declared, pages_actual,
    template_fallback, empty_pages (indices of pages without a table), pages_total. How a parse was made counts against
    it only where no printed figure confirms the rows."""
    at = F.struct("d", "seq")
    first = F.min_by(F.col("balance_c") + F.col("debit_c") - F.col("credit_c"), at)
    own = ledger.groupBy(A).agg(F.sum("debit_c").alias("out_c"), F.sum("credit_c").alias("in_c"), F.count("*").alias("n"), first.alias("open_c"), F.max_by("balance_c", at).alias("close_c"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    broken = timeline.chain_mismatches(ledger).groupBy(A).agg(F.count("*").alias("broken"))
    c = F.col
    near = lambda a, b: F.abs(a - b) <= TOLERANCE_C
    made = lambda name, known, passed: F.when(known, F.struct(F.lit(name).alias("check"), passed.alias("passed")))
    has = lambda *names: F.greatest(F.lit(False), ~F.greatest(F.lit(False), *[c(x).isNull() for x in names]))
    debits, credits = F.abs("debits_c"), F.abs("credits_c")
    facts = [
        made("debits_match_printed_total", has("debits_c"), near(c("out_c"), debits)), made("credits_match_printed_total", has("credits_c"), near(c("in_c"), credits)),
        made("closing_matches_printed", has("closing_c"), near(c("close_c"), c("closing_c"))), made("opening_matches_printed", has("opening_c"), near(c("open_c"), c("opening_c"))),
        made("printed_figures_are_self_consistent", has("opening_c", "closing_c", "debits_c", "credits_c"), near(c("opening_c") - debits + credits, c("closing_c"))),
        made("row_count_matches_statement", has("rows"), c("n") == c("rows")), made("serial_run_unbroken", F.coalesce(c("serial_gaps") > 0, F.lit(False)), F.lit(False)),
        made("dates_within_printed_period", has("period_start", "period_end"), (c("first_d") >= c("period_start")) & (c("last_d") <= c("period_end"))),
        made("page_count_matches_declared", has("pages_declared", "pages_actual"), c("pages_declared") == c("pages_actual")), made("balance_chain_intact", F.lit(True), F.coalesce("broken", F.lit(0)) == 0),
    ]
    found = sum(c(x).isNotNull().cast("int") for x in ("opening_c", "closing_c", "debits_c", "credits_c", "rows"))
    joined = own.join(anchors, A, "left").join(broken, A, "left").withColumn("facts", F.array_compact(F.array(*facts))).withColumn("anchors_found", found)
    confirmed = (c("anchors_found") > 0) & F.forall("facts", lambda x: x["passed"])
    trailing = (F.size("empty_pages") == 1) & (F.get("empty_pages", F.lit(0)) == c("pages_total") - 1)
    hints = [made("bank_template_available", F.coalesce("template_fallback", F.lit(False)), confirmed), made("every_page_yielded_rows", F.coalesce(F.size("empty_pages") > 0, F.lit(False)), F.coalesce(trailing, F.lit(False)) | confirmed)]
    done = joined.withColumn("checks", F.concat("facts", F.array_compact(F.array(*hints)))).withColumn("failed", F.size(F.filter("checks", lambda x: ~x["passed"])))
    return done.select(A, F.when(c("failed") > 0, "FAILED").when(c("anchors_found") > 0, "VERIFIED").otherwise("UNVERIFIED").alias("status"), "anchors_found", "failed", "checks")


def sheets(rows: DataFrame, rail: Column) -> DataFrame:
    """rows with `sheet`, once for each of the six focused sheets that a row is in. rows: description, subcategory."""
    has = lambda w: F.contains(F.lower(F.coalesce("subcategory", F.lit(""))), F.lit(w))
    upi = F.contains(F.lower(F.coalesce(F.nullif(rail, F.lit("")), F.col("description"), F.lit(""))), F.lit("upi"))
    tests = {"Salary Txns": has("salary"), "Cash Txns": has("cash"), "Cheque Txns": has("cheque"), "UPI Txns": upi, "Self Txns": has("self transfer"), "Loans & EMI": has("emi") | has("loan")}
    return rows.select("*", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("sheet"))


def sheet_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(A, "sheet").agg(F.count("*").alias("n"), F.sum("debit_c").alias("out_c"), F.sum("credit_c").alias("in_c"))


def business(ledger: DataFrame) -> DataFrame:
    """(account_id, in_c, out_c, in_pct, out_pct): flows of business subcategories and their shares, 0 of nothing."""
    is_ = F.coalesce(F.col("subcategory").isin(*BUSINESS), F.lit(False))
    of = lambda c: F.sum(F.when(is_, F.col(c)).otherwise(0))
    share = lambda c: F.coalesce(F.round(ratio(of(c) * 100, F.sum(c)), 2), F.lit(0.0))
    return ledger.groupBy(A).agg(of("credit_c").alias("in_c"), of("debit_c").alias("out_c"), share("credit_c").alias("in_pct"), share("debit_c").alias("out_pct"))


def cheques(ledger: DataFrame, is_cheque: Column, is_return: Column, recent: int = 90) -> DataFrame:
    """(account_id, total, bounced, rate_pct, red_flag, inward_bounced, outward_bounced, recent_bounces, same_day,
    days_since): cheques and those returned, by direction; recent: within so many days of the account's last row;
    same_day: returns on a day with another cheque. Days are added up first, so no row meets another."""
    n = F.count_if
    back, paid_in = is_cheque & is_return, F.col("credit_c") > 0
    daily = ledger.groupBy(A, "d").agg(n(is_cheque).alias("total"), n(back & paid_in).alias("inward"), n(back & ~paid_in).alias("outward"))
    day = daily.withColumn("back", F.col("inward") + F.col("outward"))
    last = day.groupBy(A).agg(F.max("d").alias("last_d"))
    s = day.join(last, A).groupBy(A).agg(
        F.sum("total").alias("total"), F.sum("back").alias("bounced"), F.sum("inward").alias("inward_bounced"), F.sum("outward").alias("outward_bounced"), F.sum(F.when(F.datediff("last_d", "d") <= recent, F.col("back")).otherwise(0)).alias("recent_bounces"),
        F.sum(F.when(F.col("total") > 1, F.col("back")).otherwise(0)).alias("same_day"), F.min(F.when(F.col("back") > 0, F.datediff("last_d", "d"))).alias("days_since"),
    )
    rate = F.coalesce(ratio(F.col("bounced") * 100, F.col("total")), F.lit(0.0))
    return s.select(A, "total", "bounced", F.round(rate, 2).alias("rate_pct"), (rate > 10).alias("red_flag"), "inward_bounced", "outward_bounced", "recent_bounces", "same_day", "days_since")


def _steps(*rungs: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for test, points in reversed(rungs):
        out = F.when(test, points).otherwise(out)
    return out


def discipline(f: DataFrame) -> DataFrame:
    """(account_id, score) from 100 down. f: account_id, emi_score, bounce_pct, penalties, charges_c, mean_balance_c,
    delay_days. Bounds and points are fixed values."""
    c = F.col
    charged = (c("mean_balance_c") > 0) & (c("charges_c") * 20 > c("mean_balance_c"))
    lost = _steps((c("emi_score") < 70, 30), (c("emi_score") < 90, 15)) + _steps((c("bounce_pct") > 10, 25), (c("bounce_pct") > 5, 15), (c("bounce_pct") > 1, 5)) + F.least(c("penalties") * 3, F.lit(20)) + F.when(charged, 10).otherwise(0) + _steps((c("delay_days") > 30, 10), (c("delay_days") > 7, 5))
    return f.select(A, F.greatest(F.lit(0), F.lit(100) - lost).cast("long").alias("score"))


def laundering(daily: DataFrame, rows: DataFrame, suspicious: DataFrame) -> DataFrame:
    """(account_id, score), 100 at most: the gap of balances, the days between its ends, rows for each 10 000 of mean
    balance, the longest dormancy, five points a suspicion. daily: (account_id, d, balance_c); suspicious: (account_id,
    n). Of days with one balance the first counts. Bounds and points are fixed values."""
    high, low = F.max_by("d", F.struct("balance_c", -F.unix_date("d"))), F.min_by("d", F.struct("balance_c", F.unix_date("d")))
    b = daily.groupBy(A).agg(F.sum("balance_c").alias("sum_c"), F.count("*").alias("days"), F.max("balance_c").alias("most_c"), F.min("balance_c").alias("least_c"), F.abs(F.datediff(high, low)).alias("apart"))
    days = rows.groupBy(A, "d").agg(F.count("*").alias("k"))
    quiet = days.withColumn("gap", F.datediff("d", F.lag("d").over(timeline.by_account("d")))).groupBy(A).agg(F.sum("k").alias("n_rows"), F.coalesce(F.max("gap"), F.lit(0)).alias("dormant"))
    c = F.col
    gap, positive = (c("most_c") - c("least_c")) * c("days"), c("sum_c") > 0
    busy = c("n_rows") * c("days") * 1_000_000  # rows over mean balance in ten thousands, without a division
    score = F.when(positive, _steps((gap > c("sum_c") * 5, 20), (gap > c("sum_c") * 3, 15), (gap > c("sum_c"), 10)) + _steps((busy > c("sum_c") * 10, 15), (busy > c("sum_c") * 5, 10))).otherwise(0)
    score = score + _steps((c("apart") <= 3, 15), (c("apart") <= 7, 10), (c("apart") <= 14, 5)) + _steps((c("dormant") > 30, 10), (c("dormant") > 15, 5)) + 5 * F.coalesce("n", F.lit(0))
    return b.join(quiet, A).join(suspicious, A, "left").select(A, F.least(score, F.lit(100)).cast("long").alias("score"))

"""The classified ledger lies in parts by account: what works by account moves no row; rows travel without narrations."""

import re

import __spark_entry__
from ledgerloom.operators import classify, fraud, periods, score
from ledgerloom.plans.registry import written
from ledgerloom.sources.tables import ledger_items
from pyspark.sql import functions as F

from test_stretches import plan


def test_narrations_are_made_after_rows_have_travelled(spark, sf_dir):
    text = plan(ledger_items(spark, sf_dir))
    window, lower = text.index("Window"), text.rindex("UPI/P2M/")
    assert lower < window


def test_groups_windows_and_joins_of_the_written_ledger_move_no_row(spark, sf_dir):
    rows = written(spark, sf_dir)
    assert not {"p_type", "needs_wants", "confidence", "method"} & set(rows.columns)
    a, b = rows.groupBy("account_id", "ym").agg(F.sum("debit_c").alias("v")), rows.groupBy("account_id").agg(F.count("*").alias("n"))
    assert "Exchange hashpartitioning" not in plan(a.join(b, "account_id"))


def test_score_and_flags_shuffle_little(spark, sf_dir):
    rows = written(spark, sf_dir)
    # Left: both sides of the passed-on credits and the flags, which are few.
    assert plan(fraud.all_flags(rows)).count("Exchange hashpartitioning") <= 3
    assert plan(score.composite(score.features(rows))).count("Exchange hashpartitioning") <= 5


def test_bounces_are_told_by_every_form(spark):
    forms = ["CHQ RTN", "INW RET", "INWARD CLG RET", "NACH REJECT", "NACH FAIL", "ECS RTN", "BOUNCE CHG", "RETURN CHARGES", "RET CHARGE", "DISHONUR", "DISHONOUR", "MANDATE FAIL", "INSUFFICIENT FUND", "CHEQUE BOUNCE", "CHQ BOUNCE", "ach debit return"]
    rows = spark.createDataFrame([(t,) for t in [*forms, "CHQ RET DEP RET", "SALARY", None]], "t string").select("t", fraud.is_bounce(F.col("t")).alias("b"), (F.upper("t").rlike(fraud.INWARD)).alias("r"))
    got = {r.t: (r.b, r.r) for r in rows.collect()}
    assert all(got[t] == (True, True) for t in forms) and not got["CHQ RET DEP RET"][0] and not got["SALARY"][0] and not got[None][0]


def test_month_sheet_adds_up_rows_once_and_unsorted(spark):
    kind = "account_id long, seq long, d date, ym string, debit_c long, credit_c long, balance_c long, category string, subcategory string"
    rows = spark.createDataFrame([(1, 2, "2024-01-05", "2024-01", 30, 0, 70, "Expense", "Cash"), (1, 1, "2024-01-05", "2024-01", 0, 60, 100, "Income", "Salary"), (1, 3, "2024-02-01", "2024-02", 10, 0, 60, "Expense", None)], re.sub("d date", "d string", kind)).withColumn("d", F.to_date("d"))
    sheet = periods.month_sheet(rows)
    assert "SortAggregate" not in plan(sheet) and "Expand" not in plan(sheet)
    got = {(r.ym, r.measure): r.value for r in sheet.collect()}
    assert len(got) == 3 * len(periods.MEASURES)
    assert [got["Total", m] for m in ("opening", "closing", "debits", "credits", "n_debits", "lowest", "highest", "average", "salary", "cash_out")] == [40, 60, 40, 60, 2, 60, 100, 73, 60, 30]
    assert [got["2024-01", m] for m in ("opening", "closing", "average")] == [40, 70, 85]


def test_context_rows_read_a_written_ledger(spark, sf_dir):
    text = plan(__spark_entry__.queries()["t5_context_rows"](spark, sf_dir))
    assert "Join" not in text and "Exchange hashpartitioning" not in text


def test_labels_and_tags_are_compiled(spark):
    rows = spark.createDataFrame([("UPI/P2M/1/ECS LOAN",), ("UPI/x@ybl/ECS",), (None,)], "t string")
    tagged = rows.select("t", classify.tags(F.col("t"), F.lit(None).cast("string"), F.lit(1)).alias("tags"), classify.keyword_of(F.col("t")).alias("k"))
    assert "lambda" not in plan(tagged)
    assert {r.t: r.tags for r in tagged.collect()} == {"UPI/P2M/1/ECS LOAN": ["UPI", "UPI/P2M", "ECS", "NACH", "Loan", "EMI"], "UPI/x@ybl/ECS": ["UPI", "UPI/P2P", "ECS", "NACH"], None: []}

"""Label caches and overrides on small rows."""

from datetime import date

from ledgerloom.operators import settle
from pyspark.sql import functions as F

ROW = "account_id long, key string, category string, subcategory string, needs_wants string, confidence double, method string, rule string"


def test_cache_labels_unseen_texts_only(spark, tmp_path):
    path, rule = f"{tmp_path}/labels", F.concat(F.lit("label of "), "text")
    make = lambda ts: spark.createDataFrame([(t,) for t in ts], "text string")
    size = lambda: spark.read.parquet(path).count()
    assert {tuple(r) for r in settle.cached_labels(spark, make(["a", "b", "a", None]), path, "1", rule).collect()} == {("a", "label of a"), ("b", "label of b")} and size() == 2
    settle.cached_labels(spark, make(["b", "a"]), path, "1", rule)
    assert size() == 2
    got = settle.cached_labels(spark, make(["b", "c"]), path, "1", F.lit("new"))
    assert {tuple(r) for r in got.collect()} == {("b", "label of b"), ("c", "new")} and size() == 3
    got = settle.cached_labels(spark, make(["a", "b", "c"]), path, "2", F.lit("second"))
    assert {r.label for r in got.collect()} == {"second"} and size() == 6


def test_overrides(spark):
    rows = [(1, "ACME TRADERS LTD", "Transfer", "P2P Transfer Out", "", 0.8, "m", "r"), (2, "ACME TR", "Transfer", "Unknown", "", 0.8, "m", "r"), (1, "ACME TRADERS", "Expense", "Rent", "Need", 0.9, "m", "r"), (1, "ACM", "Transfer", "Other", "", 0.1, "m", "r"), (1, "", "Transfer", "Other", "", 0.1, "m", "r"), (1, None, "Transfer", None, "", 0.1, "m", "r")]
    given = [("ACME TRADERS", None, "Expense", "Shopping", "Want", 1), ("ACME TRADERS", None, "Expense", "Gifts", "Want", 2), ("ACME TRADERS", 2, "Income", "Own", "Unknown", 0), ("ZZZZZZ", None, "Expense", "No", "Want", 9)]
    found = settle.overridden(spark.createDataFrame(rows, ROW), spark.createDataFrame(given, "o_key string, o_account long, o_category string, o_subcategory string, o_label string, updated_at int"))
    got = {(r.account_id, r.key): (r.subcategory, r.confidence, r.rule) for r in found.collect()}
    assert got == {(1, "ACME TRADERS LTD"): ("Gifts", 0.99, "override:global"), (2, "ACME TR"): ("Own", 0.99, "override:applicant"), (1, "ACME TRADERS"): ("Rent", 0.9, "r"), (1, "ACM"): ("Other", 0.1, "r"), (1, ""): ("Other", 0.1, "r"), (1, None): (None, 0.1, "r")}


def test_salary_cycle(spark):
    rows = [(1, i, date(2024, 1, i), 600_000 + i, "A", False) for i in (1, 2, 3)] + [(1, 9, date(2024, 1, 9), 900_000, "S", True), (2, 1, date(2024, 1, 1), 600_000, "A", False), (2, 2, date(2024, 1, 2), 700_001, "B", False), (3, 1, date(2024, 1, 1), 100, "A", True)]
    rows += [(4, i, date(2024, 2, i), 800_000, "AB"[i % 2], False) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "account_id long, seq long, d date, credit_c long, payee string, paid boolean")
    got = {r.account_id: (r.income_c, r.detected, r.source, r.payee, r.n, [x.day for x in r.days]) for r in settle.salary_cycle(df, F.col("paid")).collect()}
    assert got == {1: (900_000.0, True, "keyword", None, 1, [9]), 2: (650_001.0, False, "mean", None, 0, []), 4: (800_000.0, True, "payee", "A", 2, [2, 4])}


def test_rows_meet_their_labels_by_digest(spark, tmp_path):
    path = f"{tmp_path}/labels"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "z")], "account_id long, text string")
    settle.cached_labels(spark, rows.where("account_id < 4"), path, "1", F.upper("text"))
    found = settle.with_labels(rows, path, "1")
    assert found.columns == ["account_id", "label"] and sorted(map(tuple, found.collect())) == [(1, "A"), (1, "A"), (2, "B")]
    assert settle.with_labels(rows, path, "2").count() == 0

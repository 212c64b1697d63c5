"""Rows that are dear to make are made once: what reads them several times reads a written copy."""

from ledgerloom.operators import score, settle

from test_settle import ROW
from test_stretches import plan


def test_overrides_read_a_copy_of_rows(spark):
    rows = spark.createDataFrame([(1, "ACME TRADERS", "Transfer", "Unknown", "", 0.1, "m", "r")], ROW)
    given = spark.createDataFrame([("ACME TRADERS", None, "Expense", "Gifts", "Want", 1)], "o_key string, o_account long, o_category string, o_subcategory string, o_label string, updated_at int")
    text = plan(settle.overridden(rows, given))
    assert "parquet" in text and "ExistingRDD" not in text and "LocalTableScan" not in text


def test_reconciliation_reads_a_copy_of_the_ledger(spark):
    rows = [(1, 1, "2024-01", 0, 500, 500, "Income", "Salary", "N/A", False), (1, 2, "2024-01", 200, 0, 300, "Expense", "Rent", "Need", False)]
    found = score.reconciliation(spark.createDataFrame(rows, "account_id long, seq long, ym string, debit_c long, credit_c long, balance_c long, category string, subcategory string, needs_wants string, is_return boolean"))
    text = plan(found)
    assert "parquet" in text and "ExistingRDD" not in text and "LocalTableScan" not in text
    assert [r.passed for r in found.collect()] == [True] * 6

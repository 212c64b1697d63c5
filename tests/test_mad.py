"""Outliers by medians over one placing of rows."""

from ledgerloom.operators import fraud

from test_stretches import plan


def test_medians_are_not_joined(spark):
    """A table of medians for each account would be broadcast, through the driver, as long as it is compact."""
    rows = [(1, i, 100 + i) for i in range(12)] + [(1, 12, 9_000), (2, 0, 5), (None, 1, 7)]
    found = fraud.mad_outliers(spark.createDataFrame(rows, "account_id long, seq long, debit_c long"))
    assert "Join" not in plan(found) and [tuple(r) for r in found.collect()] == [(1, 12, 9_000)]

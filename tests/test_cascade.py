"""Narrations and labels on rows that the forms of the query tables don't have."""

from ledgerloom.operators import cascade, narration
from ledgerloom.plans.statements import RULES
from pyspark.sql import functions as F

COLUMNS = "account_id long, bank_name string, description string, debit_c long, credit_c long"


def test_awkward_narrations(spark):
    rows = [(1, "SBI", None, 1, 0), (1, None, "", 0, 1), (1, "Axis", "UPI/P2M/", 1, 0), (1, "ICICI", "UPI/1", 1, 0), (1, "BOB", "UPI/1/10:11/UPI/cutoff", 1, 0), (1, "Nobody", "x" * 5000, 1, 0), (2, "Kotak", "UPI-A*B*C*NAME*D", 0, 0)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = [r.p for r in df.select(narration.parse(F.col("bank_name"), F.col("description")).alias("p")).collect()]
    assert [p.rail for p in got] == ["", "", "UPI", "UPI", "UPI", "", "UPI"] and got[2].is_p2m and not got[3].is_p2m
    assert (got[3].ref, got[3].payee) == ("", "UPI/1") and (got[4].vpa, got[4].payee) == ("cutoff", "cutoff") and got[6].payee == "UPI-A" and got[6].remarks == "NAME"
    labels = cascade.classify(df, RULES).collect()
    assert len(labels) == len(rows) and all(r.method for r in labels) and cascade.classify(df.limit(0), RULES).count() == 0


def test_payers_need_two_credits(spark):
    rows = [(1, "Other", "ACH-CR-ACME WORKS-1", 0, 5), (1, "Other", "ACH-CR-ACME WORKS-2", 0, 5), (1, "Other", "NEFT/1/ACME WORKS", 0, 5), (2, "Other", "ACH-CR-ACME WORKS-1", 0, 5), (2, "Other", "NEFT/1/ACME WORKS", 0, 5), (1, "Other", "NEFT/1/ACME WORKS", 5, 0)]
    got = {(r.account_id, r.description, r.debit_c): r.rule for r in cascade.classify(spark.createDataFrame(rows, COLUMNS), RULES).collect()}
    assert got[1, "NEFT/1/ACME WORKS", 0] == "known_salary_payer" and got[2, "NEFT/1/ACME WORKS", 0] == "named_transfer" == got[1, "NEFT/1/ACME WORKS", 5]

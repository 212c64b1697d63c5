"""Every form of a dishonoured payment, and returned deposits, which are none."""

from ledgerloom.operators import fraud
from pyspark.sql import functions as F

YES = [
    "CHQ RETURN 12", "chq rtn", "CHQ RET", "INW RET", "INWARD RETURN", "INW CLG RET", "NACH REJECT", "NACH FAIL 1", "ECS RTN", "BOUNCE CHG", "BOUNCE CHARGES", "RETURN CHG GST", "ECS RETURN CHARGES 7", "RET CHARGE", "CHEQUE DISHONOUR", "DISHONUR FEE",
    "MANDATE RETURN", "INSUFFICIENT FUND", "CHEQUE BOUNCE", "CHQ BOUNCE", "ACH DEBIT RETURN",
]
NO = ["", None, "NEFT RETURN", "CHQ RETURN OUTWARD RET", "DEP RET CHQ RET", "RETURNED GOODS", "NACHRETURN", "DISHONOR", "SALARY", "CLG RET DEP INW RET"]


def test_bounces(spark):
    df = spark.createDataFrame([(t,) for t in YES + NO], "t string")
    got = {r.t: r.b for r in df.select("t", fraud.is_bounce(F.col("t")).alias("b")).collect()}
    assert got == {t: True for t in YES} | {t: False for t in NO}

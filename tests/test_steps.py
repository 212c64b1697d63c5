"""The cascade in steps: what is made once a row, and that the steps say what one expression or one dictionary says."""

import random
import re

import pyarrow as pa
from ledgerloom.operators import cascade, dictionary, narration, settle
from ledgerloom.plans import statements
from ledgerloom.plans.statements import RULES
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from test_settle import ROW
from test_stretches import plan

COLUMNS = "account_id long, bank_name string, description string, debit_c long, credit_c long"


def test_a_row_visits_the_dictionaries_once(spark):
    df = spark.createDataFrame([(1, "SBI", "ATW-1", 1, 0)], COLUMNS)
    found = cascade.classify(df, RULES)
    assert len(re.findall(r"\bfound\(", found._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_narrations_do_not_travel(spark, sf_dir):
    text = statements.classified(spark, sf_dir).select("l_orderkey", "method")._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in text.splitlines() if "Join LeftOuter" in line)
    assert "account_id" in join
    under = text.split(join, 1)[1].split("Aggregate", 1)[0]
    assert "description" not in under and "bank_name" not in under


def test_steps_equal_one_expression(spark):
    banks = [*narration.FORMS, "HDFC", None]
    words = ["UPI", "P2M", "NEFT", "ACME TRADERS", "x@ybl", "123456789012", "HDFC BANK", "ok", "é ß", " ", "petrol", "WDL TFR UPI/DR", "ATM", "DR", "ACHDr 12 X", "a" * 60]
    rng = random.Random(3)
    rows = [(rng.choice(banks), rng.choice("/-*: ").join(rng.choice(words) for _ in range(rng.randrange(7)))) for _ in range(600)] + [("SBI", None), (None, None), ("BOB", ""), ("Other", "\n")]
    df = narration.parsed(spark.createDataFrame(rows, "bank_name string, description string")).withColumn("q", narration.parse(F.col("bank_name"), F.col("description")))
    assert df.count() == len(rows) and df.where("not p <=> q").count() == 0
    # A filter on a field isn't written out into the steps.
    assert narration.parsed(spark.createDataFrame(rows, "bank_name string, description string")).where("length(p.payee) > 2 and p.rail <> '' and upper(p.payee) <> 'X'").count() > 0


def test_any_of_finds_what_its_words_find():
    words = ["bank", "ban", "union", "uco", "jana ", "au small", "a.b", "s"]
    for text in ["bank", "xban", "janab", "jana b", "au smal", "ausmall", "aab", "za.b", "Uco", "u", "os"]:
        assert bool(re.search("(?i)" + narration.any_of("|".join(words)), text)) == any(w in text.lower() for w in words)


def test_dictionaries_together_equal_each_alone():
    a = dictionary.Dictionary([("RETURN", "Income", "Refund", "N/A"), ("FEE", "Banking", "Charges", "N/A"), ("CROMWELL STORES", "Expense", "Shopping", "Want")], excluded={"RETURN": ["CHARGES"]}, required={"FEE": ["UNION", "Q"]})
    b = dictionary.Dictionary([("RETURN", "x", "y", "z"), ("STORES", "x", "y", "z"), ("UNION FEE", "w", "y", "z")])
    both, starts = dictionary.together(a, b)
    texts = pa.array(["RETURN CHARGES", "return", "fee", "union-fee", "UNIONFEE q", None, "", "CROMWELL_STORES", "é cromwell stores", "xRETURN fee Q"])
    row, entry = both.found_in(texts)
    got = sorted(set(zip(row.tolist(), entry.tolist(), strict=True)))
    want = sorted({(int(r), int(e) + at) for d, at in zip((a, b), starts, strict=True) for r, e in zip(*d.found_in(texts), strict=True)})
    assert got == want and {e for _, e in want} == set(range(6))


def test_rows_that_state_a_purpose_are_not_joined_with_overrides(spark):
    rows = spark.createDataFrame([(1, "ACME TRADERS", "Transfer", "Unknown", "", 0.1, "m", "r"), (1, "ACME TRADERS", "Expense", "Rent", "Need", 0.9, "m", "r"), (1, None, "Transfer", None, "", 0.1, "m", "r")], ROW)
    given = spark.createDataFrame([("ACME TRADERS", None, "Expense", "Gifts", "Want", 1)], "o_key string, o_account long, o_category string, o_subcategory string, o_label string, updated_at int")
    found = settle.overridden(rows, given)
    assert "Union" in plan(found) and sorted(str(r.subcategory) for r in found.collect()) == ["Gifts", "None", "Rent"]


def test_narrations_are_those_of_the_sql(spark, sf_dir):
    keys = statements.statement_keys(spark, sf_dir).withColumn("p_name", F.when(F.col("l_linenumber") == 1, F.lit(None).cast(StringType())).otherwise(F.col("p_name")))
    own = statements.narrated(keys).withColumn("told", F.expr(statements._case([f[1] for f in statements.FORMS]))).withColumn("bank", F.expr(statements._case([statements.q(f[0]) for f in statements.FORMS])))
    assert own.where("not (told <=> description and bank <=> bank_name)").count() == 0
    assert "CASE" not in statements.narrated(keys).select("description")._jdf.queryExecution().optimizedPlan().toString().split("__taken")[0]

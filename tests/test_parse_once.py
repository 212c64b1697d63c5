"""The general reader stands once in a parsed narration, not once for each field; keywords off Arrow's own buffers."""

import pyarrow as pa
from ledgerloom.operators import dictionary, narration
from pyspark.sql import functions as F


def test_the_general_reader_is_not_repeated(spark):
    df = spark.createDataFrame([("SBI", "UPI/1/ACME STORES/x@ybl")], "bank string, d string").select(narration.parse(F.col("bank"), F.col("d")).alias("p"))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count(r"[^\p{L}]") <= 2


def test_keywords_of_an_array_equal_those_of_a_list():
    d = dictionary.Dictionary([("CROMWELL STORES", "Expense", "Shopping", "Want"), ("RETURN", "Income", "Refund", "N/A"), ("FEE", "Banking", "Charges", "N/A"), ("STORES", "Expense", "Shops", "Want")], excluded={"RETURN": ["CHARGES"]}, required={"FEE": ["UNION"]})
    texts = ["at CROMWELL STORES", "CROMWELL STORES@pay", "cromwell\x1cstores", None, "", "return", "RETURN CHARGES", "fee", "union fee return", "é STORES fee"]
    for array in (pa.array(texts), pa.array(["STORES", *texts]).slice(1)):
        got = [[x["keyword"] for x in row] for row in d.best_of(array).to_pylist()]
        assert got == [[d.entries[e][0] for e in row] for row in d.best(texts)]

"""Facts printed in a statement's text: holder, bank codes, balances, totals and serial numbers.

Input is a row for each line (document, line_no, line); each scan is one aggregation over lines that match. The first of
texts is found by sorting, so lines are placed by document in parts of bounded size before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_numeric
from ledgerloom.sources.tables import placed

#: Bytes of files whose lines a task sorts.
SHARE = 1 << 20
HOLDER = r"(?i)(?:account holder|customer name|account name|name)\s*[:\-]\s*([A-Za-z][A-Za-z#0-9 .]+)"


def _first(value: Column) -> Column:
    """The value of the first line that has one."""
    return F.min_by(F.nullif(value, F.lit("")), F.when(value != "", F.col("line_no")))


def holder(lines: DataFrame, head: int = 6) -> DataFrame:
    """(document, holder): a labelled name, else the first of the first lines that is letters only; else null."""
    labelled = _first(F.trim(F.regexp_extract("line", HOLDER, 1)))
    plain = _first(F.when((F.col("line_no") < head) & F.col("line").rlike(r"^[A-Z][A-Za-z .]{4,}$") & ~F.col("line").rlike("(?i)bank|statement|branch"), F.trim("line")).otherwise(F.lit("")))
    return placed(lines, "document", share=SHARE).groupBy("document").agg(F.coalesce(labelled, plain).alias("holder"))


def anchors(lines: DataFrame) -> DataFrame:
    """(document, opening_c, closing_c, debit_c, credit_c, debit_count, credit_count, ifsc): null where a fact
    isn't printed, never 0."""
    money = lambda label: (clean_numeric(_first(F.regexp_extract("line", rf"(?i){label}\s*[:\-]?\s*([\d,]+\.\d\d(?:\s*[DC]r)?)", 1)), True) * 100).cast("long")
    known = lambda label, c: F.when(F.max(F.col("line").rlike(rf"(?i){label}\s*[:\-]?\s*[\d,]+\.\d\d")), c)
    count = lambda label: _first(F.regexp_extract("line", rf"(?i){label}\s*[:\-]?\s*(\d+)\s*$", 1)).try_cast("long")
    fact = lambda label: known(label, money(label))
    return placed(lines, "document", share=SHARE).groupBy("document").agg(
        fact("opening balance").alias("opening_c"), fact("closing balance").alias("closing_c"), fact("total debits").alias("debit_c"), fact("total credits").alias("credit_c"),
        count("debit count").alias("debit_count"), count("credit count").alias("credit_count"), _first(F.regexp_extract("line", r"\b([A-Z]{4}0[A-Z0-9]{6})\b", 1)).alias("ifsc"),
    )


def pages(files: DataFrame, separator: str = "\f") -> DataFrame:
    """(path, page, line_no, line) of text files (path, content): a page for each form feed."""
    p = files.select("path", F.posexplode(F.split("content", separator)).alias("page", "text"))
    return p.select("path", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def read_files(spark, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, content) of whole text files, distributed by file."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

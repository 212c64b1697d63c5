"""Cells and rows of extracted statements put right before they become a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text

#: Fixed: header names that mean a column of the ledger.
ALIASES = {
    "narration": "description", "transaction remarks": "description", "particulars": "description", "remarks": "description", "txn date": "date", "transaction date": "date", "tran date": "date",
    "withdrawal amt.": "debit", "withdrawal amount (inr )": "debit", "deposit amt.": "credit", "deposit amount (inr )": "credit", "closing balance": "balance", "balance (inr )": "balance",
}
REQUIRED = ("date", "description", "debit", "credit", "balance")


def rename_columns(raw: DataFrame) -> DataFrame:
    """Headers trimmed, lower-cased and replaced by the ledger's names."""
    low = {c: c.strip().lower() for c in raw.columns}
    return raw.withColumnsRenamed({c: ALIASES.get(n, n) for c, n in low.items()})


def require(raw: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw


def split_signed(amount: Column, kind: Column) -> tuple[Column, Column]:
    """(debit, credit) of one amount column: negative or marked DR is a debit, all else a credit."""
    debit = (amount < 0) | F.upper(F.coalesce(kind, F.lit(""))).startswith("D")
    return F.when(debit, F.abs(amount)).otherwise(0), F.when(debit, 0).otherwise(F.abs(amount))


def with_cheque(description: Column, number: Column) -> Column:
    """The cheque number appended unless the narration has it or there is none."""
    n = F.trim(F.coalesce(number, F.lit("")))
    return F.when((n == "") | F.contains(description, n), description).otherwise(F.concat_ws(" ", description, n))


def leading_date(description: Column) -> tuple[Column, Column]:
    """(date or null, rest) of a narration that begins with a date."""
    head = F.regexp_extract(description, r"^(\d{2}[/-]\d{2}[/-]\d{4})\s", 1)
    return text.parse_date(F.when(head != "", head)), F.trim(F.regexp_replace(description, r"^\d{2}[/-]\d{2}[/-]\d{4}\s+", ""))


def drop_blank(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.na.drop("all", subset=columns)


def clean_statement(raw: DataFrame) -> DataFrame:
    """From text cells (with seq and account_id) to ledger rows: renamed, parsed, junk and undated rows out,
    exact repetitions once, ordered by seq."""
    r = require(rename_columns(raw))
    junk = text.is_junk(F.col("description")) | text.is_noise(F.col("description"))
    r = r.where(~junk).withColumn("d", text.parse_date(F.col("date"))).where("d is not null")
    cents = lambda c, dr=False: (text.clean_numeric(F.col(c), dr) * 100).cast("long")
    r = r.select("account_id", "seq", "d", F.date_format("d", "yyyy-MM").alias("ym"), text.clean_description(F.col("description")).alias("description"), F.abs(cents("debit")).alias("debit_c"), F.abs(cents("credit")).alias("credit_c"), cents("balance", True).alias("balance_c"))
    w = Window.partitionBy("account_id", "d", "description", "debit_c", "credit_c", "balance_c").orderBy("seq")
    return r.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def detect_bank(lines: DataFrame, markers: DataFrame) -> DataFrame:
    """(document, bank): the bank with the greatest weight of markers in a document's lines, else Other.
    markers: (marker, bank, weight), upper case, any number. A line meets the markers that begin with one of its runs
    of characters (as long as the shortest marker), then each is looked for whole."""
    m = markers.where("marker <> ''")
    size = m.agg(F.min(F.length("marker"))).first()[0] or 1
    low = F.upper("line")
    grams = F.when(F.length(low) >= size, F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda i: F.substring(low, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    probes = lines.select("document", low.alias("low"), F.explode(F.array_distinct(grams)).alias("gram"))
    hits = probes.join(m.withColumn("gram", F.substring("marker", 1, size)), "gram").where(F.contains("low", "marker"))
    best = hits.groupBy("document", "bank").agg(F.sum("weight").alias("w")).groupBy("document").agg(F.max_by("bank", F.struct("w", "bank")).alias("bank"))
    return lines.select("document").distinct().join(best, "document", "left").fillna({"bank": "Other"})


def drop_undated(rows: DataFrame, column: str = "date") -> tuple[DataFrame, DataFrame]:
    """(rows with their date in d, one row with the number of those whose date can't be read)."""
    r = rows.withColumn("d", text.parse_date(F.col(column)))
    return r.where("d is not null"), r.agg(F.count_if(F.col("d").isNull()).alias("undated"))


def merge_time(date: Column, time: Column) -> Column:
    """The date's text followed by the clock time that a time cell holds, if it holds one."""
    clock = F.regexp_extract(F.trim(F.coalesce(time, F.lit(""))), r"\b([012]?\d:[0-5]\d(?::[0-5]\d)?(?:\s*[AaPp][Mm])?)\b", 1)
    d = F.trim(F.coalesce(date, F.lit("")))
    return F.when((clock == "") | (d == ""), d).otherwise(F.concat_ws(" ", d, clock))


def number_of(df: DataFrame, column: str) -> Column:
    """A column of any kind as a double: a series (map or array of numbers) is its mean, an envelope (a struct with
    `value`) its value, text is parsed; booleans and what can't be read are null."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    if isinstance(kind, T.StructType):
        return c["value"].try_cast("double") if "value" in kind.names and not isinstance(kind["value"].dataType, T.BooleanType) else F.lit(None).cast("double")
    if isinstance(kind, T.MapType | T.ArrayType):
        values = F.filter(F.transform(F.map_values(c) if isinstance(kind, T.MapType) else c, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    return c.try_cast("double")


def pick(df: DataFrame, *columns: str) -> Column:
    """The first of the columns, those that the frame has, that is a number."""
    return F.coalesce(*[number_of(df, c) for c in columns if c in df.columns], F.lit(None).cast("double"))


def first_value(*columns: Column) -> Column:
    """The first that is not null."""
    return F.coalesce(*columns)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def aa_blocks(lines: DataFrame) -> DataFrame:
    """(document, block, txn, date, kind, amount) of account-aggregator text: a block begins at a line `S` and
    eight digits; its lines hold a date, a kind and an amount."""
    w = Window.partitionBy("document").orderBy("line_no")
    start = F.col("line").rlike(r"^S\d{8}$")
    b = lines.withColumn("block", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("block > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    g = b.groupBy("document", "block").agg(body.alias("body"))
    return g.select("document", "block", F.regexp_extract("body", r"(S\d{8})", 1).alias("txn"), F.to_date(F.nullif(F.regexp_extract("body", r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).alias("d"), F.upper(F.regexp_extract("body", r"(?i)\b(credit|debit)\b", 1)).alias("kind"), F.regexp_extract("body", r"([\d,]+\.\d{2})", 1).alias("amount"))

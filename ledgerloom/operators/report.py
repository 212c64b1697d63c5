"""Report views: one DataFrame for each sheet; drawing files is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

A = "account_id"


def month_summary(ledger: DataFrame) -> DataFrame:
    """Figures by account and month as rows (measure, value): unpivoted from one aggregation."""
    m = ledger.groupBy(A, "ym").agg(
        F.min_by(F.col("balance_c") + F.col("debit_c") - F.col("credit_c"), "seq").alias("opening"), F.max_by("balance_c", "seq").alias("closing"), F.min("balance_c").alias("lowest"), F.max("balance_c").alias("highest"),
        F.sum("credit_c").alias("credits"), F.sum("debit_c").alias("debits"), F.count_if(F.col("credit_c") > 0).alias("n_credits"), F.count_if(F.col("debit_c") > 0).alias("n_debits"),
    )
    names = [c for c in m.columns if c not in (A, "ym")]
    return m.unpivot([A, "ym"], names, "measure", "value")


def category_block(ledger: DataFrame) -> DataFrame:
    """Per account, direction and category: sum, count and share of the direction's total."""
    side = F.when(F.col("credit_c") > 0, "credit").otherwise("debit")
    g = ledger.withColumn("side", side).groupBy(A, "side", "category").agg(F.sum(F.col("credit_c") + F.col("debit_c")).alias("total_c"), F.count("*").alias("n"))
    share = F.col("total_c").cast("double") / F.sum("total_c").over(Window.partitionBy(A, "side"))
    return g.withColumn("share", F.round(share, 4))


def counterparty_block(ledger: DataFrame, n: int = 60) -> DataFrame:
    side = F.when(F.col("credit_c") > 0, "credit").otherwise("debit")
    g = ledger.withColumn("side", side).groupBy(A, "side", "counterparty").agg(F.sum(F.col("credit_c") + F.col("debit_c")).alias("total_c"), F.count("*").alias("n"))
    w = Window.partitionBy(A, "side").orderBy(F.desc("total_c"), "counterparty")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def day_by_month(ledger: DataFrame, months: list[str]) -> DataFrame:
    """The last balance of each day of the month, a column for each month; months are given, so that the pivot
    needs no pass to find them."""
    g = ledger.groupBy(A, F.dayofmonth("d").alias("day")).pivot("ym", months).agg(F.max_by("balance_c", F.struct("d", "seq")))
    return g.select(A, "day", *[F.col(m).alias("m_" + m.replace("-", "_")) for m in months])


def high_value(ledger: DataFrame, n: int = 20) -> DataFrame:
    """The n largest rows of each account and those that tie with the last."""
    w = Window.partitionBy(A).orderBy(F.desc(F.col("debit_c") + F.col("credit_c")))
    return ledger.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= n).select(A, "seq", (F.col("debit_c") + F.col("credit_c")).alias("amount_c"), "rank")


def recurring_sheet(ledger: DataFrame) -> DataFrame:
    return ledger.where("debit_c > 0").groupBy(A, "counterparty").agg(F.count("*").alias("n"), F.sum("debit_c").alias("total_c"), F.min("d").alias("first_d"), F.max("d").alias("last_d")).where("n >= 3")


def focus(ledger: DataFrame, word: str) -> DataFrame:
    """Rows of one sheet: those that hold a word in narration or class."""
    return ledger.where(F.contains(F.lower(F.concat_ws(" ", "description", "category", "subcategory")), F.lit(word.lower())))


def page_of(rows: DataFrame, text: str, search: str, order: list[str], size: int, page: int) -> DataFrame:
    """A page of a search: Spark keeps only offset plus limit rows of each partition."""
    return rows.where(F.contains(F.lower(text), F.lit(search.lower()))).orderBy(*order).offset(size * page).limit(size)

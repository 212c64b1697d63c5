"""Transfers between accounts of one owner, matched one to one, and what is left without them.

Rows are paired by rank: on each day the n-th debit of an amount meets its n-th credit, and rows that are left try the
next day and the day before. So each row is used once, and an amount that is very common gives as many rows as it has,
not their product. Whether a row is paired depends on the few days around it, so all of it is windows over one placing
of the rows by owner, amount and block of days, in which the days around a block stand a second time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.tables import placed

A = "account_id"
#: Days from the debit to the credit, in the order in which they are tried.
OFFSETS = (0, 1, -1)
#: Days of one owner and amount that are placed together.
BLOCK = 64


def marked(rows: DataFrame, offsets: tuple[int, ...] = OFFSETS, size: int = BLOCK) -> DataFrame:
    """rows with amount_c, is_out, used (whether a pair has the row) and, on a debit of a pair, the credit's to_account,
    in_seq and in_d. rows: owner, account_id, seq, d, debit_c, credit_c; (account_id, seq) tells rows apart. Debits are
    ranked by account and number, credits by account from the last and number; a pair of one account is none and both
    rows go on to the next offset. Rows without an owner, a date or one side alone take no part and stay."""
    sided = F.coalesce(F.expr("owner is not null and d is not null and (debit_c > 0) <> (credit_c > 0)"), F.lit(False))
    reach, own = sum(map(abs, offsets)), F.floor(F.unix_date("d") / size)
    near = F.sequence(F.floor((F.unix_date("d") - reach) / size), F.floor((F.unix_date("d") + reach) / size))
    left = rows.select(*rows.columns, F.when(sided, F.col("debit_c") + F.col("credit_c")).alias("amount_c"), (F.col("debit_c") > 0).alias("is_out"), sided.alias("free"), own.alias("home"))
    left = left.withColumn("block", F.explode(F.when(F.col("free"), near).otherwise(F.array(F.pmod(F.xxhash64(A, "seq"), F.lit(1 << 20))))))
    left = placed(left, "owner", "amount_c", "block").withColumns({"paired": F.lit(None).cast(_credit(left)), "own": ~F.col("free") | (F.col("block") == F.col("home"))})
    place = ["owner", "amount_c", "block", "day", "free"]
    for offset in offsets:
        left = left.withColumn("day", F.when(F.col("is_out"), F.date_add("d", offset)).otherwise(F.col("d")))
        order = Window.partitionBy(*place, "is_out").orderBy(F.when(F.col("is_out"), F.col(A)).otherwise(-F.col(A)), "seq")
        met = Window.partitionBy(*place, "n")
        left = left.withColumn("n", F.row_number().over(order))
        left = left.withColumns({"payer": F.max(F.when(F.col("is_out"), F.col(A))).over(met), "credit": F.max(F.when(~F.col("is_out"), F.struct(A, "seq", "d"))).over(met)})
        hit = F.col("free") & F.coalesce(F.col("payer") != F.col(f"credit.{A}"), F.lit(False))
        left = left.withColumns({"paired": F.when(hit, F.col("credit")).otherwise(F.col("paired")), "free": F.col("free") & ~hit})
    credit = F.when(F.col("is_out"), F.col("paired"))
    return left.where("own").select(*rows.columns, "amount_c", "is_out", F.col("paired").isNotNull().alias("used"), credit[A].alias("to_account"), credit["seq"].alias("in_seq"), credit["d"].alias("in_d"))


def _credit(rows: DataFrame) -> str:
    return f"struct<{', '.join(f'{c}: {rows.schema[c].dataType.simpleString()}' for c in (A, 'seq', 'd'))}>"


def match(rows: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """(owner, amount_c, from_account, out_seq, out_d, to_account, in_seq, in_d): debits with the credit of another
    account of their owner of the same amount; see marked."""
    return marked(rows, offsets).where("used and is_out").select("owner", "amount_c", F.col(A).alias("from_account"), F.col("seq").alias("out_seq"), F.col("d").alias("out_d"), "to_account", "in_seq", "in_d")


def without(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows but for those that a pair uses."""
    used = pairs.select(F.col("from_account").alias(A), F.col("out_seq").alias("seq")).unionAll(pairs.select("to_account", "in_seq"))
    return rows.join(used, [A, "seq"], "left_anti").select(*rows.columns)


def _rate(transfers: DataFrame) -> DataFrame:
    return transfers.select("owner", "transfers", "days", F.round(F.col("transfers") / F.col("days"), 6).alias("per_day"))


def _days() -> Column:
    return (F.datediff(F.max("d"), F.min("d")) + 1).cast("long").alias("days")


def velocity(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(owner, transfers, days, per_day): matched transfers a day of an owner's statements, both ends counted."""
    n = pairs.groupBy("owner").agg(F.count("*").alias("n"))
    return _rate(rows.groupBy("owner").agg(_days()).join(n, "owner", "left").withColumn("transfers", F.coalesce("n", F.lit(0))))


def marked_velocity(rows: DataFrame) -> DataFrame:
    """As velocity, of marked rows, in one aggregation."""
    return _rate(rows.groupBy("owner").agg(_days(), F.count_if(F.col("used") & F.col("is_out")).alias("transfers")))


def months(rows: DataFrame) -> DataFrame:
    """(owner, ym, in_c, out_c, accounts): months of all accounts of an owner."""
    return rows.groupBy("owner", F.date_format("d", "yyyy-MM").alias("ym")).agg(F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c"), F.countDistinct(A).alias("accounts"))


def consolidated(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """months without transfers between an owner's accounts."""
    return months(without(rows, pairs))

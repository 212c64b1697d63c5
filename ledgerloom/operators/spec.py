"""Operators that the written specification asks for beyond what was ever implemented."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.joins import _side, within_days

A = "account_id"


def same_day_cash(ledger: DataFrame, least: int = 2) -> DataFrame:
    return ledger.where(F.contains("description", F.lit("CASH WDL"))).groupBy(A, "d").agg(F.count("*").alias("n"), F.sum(F.col("debit_c") + F.col("credit_c")).alias("amount_c")).where(F.col("n") >= least)


def circular_pairs(ledger: DataFrame, days: int = 3) -> DataFrame:
    """Money that goes to a counterparty and comes back within three days at most five percent off."""
    out = _side(ledger.where("debit_c > 0"), "l", "seq", "d", "debit_c", "counterparty")
    back = _side(ledger.where("credit_c > 0"), "r", "seq", "d", "credit_c", "counterparty")
    pairs = within_days(out, back, days).where((F.col("l_counterparty") == F.col("r_counterparty")) & (F.abs(F.col("r_credit_c") - F.col("l_debit_c")) * 20 <= F.col("l_debit_c")))
    return pairs.select(A, F.col("l_seq").alias("out_seq"), F.col("r_seq").alias("in_seq"), F.col("l_debit_c").alias("out_c"), F.col("r_credit_c").alias("in_c"))


def dormancy(ledger: DataFrame, days: int = 30) -> DataFrame:
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy(A).orderBy("seq"))).cast("long")
    return ledger.withColumn("g", gap).where(F.col("g") > days).groupBy(A).agg(F.count("*").alias("gaps"), F.max("g").alias("longest"))


def balance_before_emi(ledger: DataFrame) -> DataFrame:
    before = F.lag("balance_c").over(Window.partitionBy(A).orderBy("seq"))
    return ledger.withColumn("before_c", before).where(F.col("description").startswith("ACH/") & (F.col("debit_c") > 0)).select(A, "seq", "debit_c", "before_c", (F.col("before_c") < F.col("debit_c")).alias("short"))


def missing_months(ledger: DataFrame) -> DataFrame:
    span = ledger.groupBy(A).agg(F.trunc(F.min("d"), "month").alias("lo"), F.trunc(F.max("d"), "month").alias("hi"))
    months = span.select(A, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m")).select(A, F.date_format("m", "yyyy-MM").alias("ym"))
    return months.join(ledger.select(A, "ym").distinct(), [A, "ym"], "left_anti").groupBy(A).agg(F.count("*").alias("missing"))


def relative_high_value(ledger: DataFrame) -> DataFrame:
    """Debits over one and a half times the account's mean debit."""
    w = Window.partitionBy(A)
    return ledger.where("debit_c > 0").withColumns({"s": F.sum("debit_c").over(w), "n": F.count("*").over(w)}).where(F.col("debit_c") * F.col("n") * 2 > F.col("s") * 3).select(A, "seq", "debit_c")


def batch_daily(events: DataFrame) -> DataFrame:
    """What the streaming daily totals come to once all events are in."""
    return events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("amount_c"))


def inter_account(ledger: DataFrame) -> DataFrame:
    """Debits of one account that another takes in with the same amount on the same day or the next: an
    equi-join on amount and day."""
    out = ledger.where("debit_c > 0").select(F.col(A).alias("from_account"), F.col("seq").alias("out_seq"), F.col("debit_c").alias("amount_c"), F.explode(F.array("d", F.date_add("d", 1))).alias("d"))
    back = ledger.where("credit_c > 0").select(F.col(A).alias("to_account"), F.col("seq").alias("in_seq"), F.col("credit_c").alias("amount_c"), "d")
    return out.join(back, ["amount_c", "d"]).where("from_account <> to_account").select("from_account", "out_seq", "to_account", "in_seq", "amount_c")


def inter_account_counts(ledger: DataFrame) -> DataFrame:
    """(amount_c, n): how many pairs inter_account gives of each amount, without making them: debits times credits of an
    amount and day, less those of one account."""
    days = F.when(F.col("debit_c") > 0, F.array("d", F.date_add("d", 1))).otherwise(F.array().cast("array<date>"))
    ends = ledger.where(F.col(A).isNotNull()).select(A, F.explode(F.concat(
        F.transform(days, lambda x: F.struct(F.col("debit_c").alias("amount_c"), x.alias("d"), F.lit(1).alias("outs"), F.lit(0).alias("ins"))),
        F.when(F.col("credit_c") > 0, F.array(F.struct(F.col("credit_c").alias("amount_c"), F.col("d"), F.lit(0).alias("outs"), F.lit(1).alias("ins")))).otherwise(F.array()),
    )).alias("e")).select(A, "e.*").where("d is not null")
    own = ends.groupBy("amount_c", "d", A).agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"))
    every = own.groupBy("amount_c", "d").agg((F.sum("outs") * F.sum("ins") - F.sum(F.col("outs") * F.col("ins"))).alias("n"))
    return every.groupBy("amount_c").agg(F.sum("n").alias("n")).where("n > 0")


def deposit_then_withdrawal(ledger: DataFrame, least_c: int = 5_000_000) -> DataFrame:
    """Large credits with as much or more taken out on the day or the next."""
    big = _side(ledger.where(F.col("credit_c") >= least_c), "l", "seq", "d", "credit_c")
    out = _side(ledger.where("debit_c > 0"), "r", "seq", "d", "debit_c")
    return within_days(big, out, 1).groupBy(A, "l_seq", "l_credit_c").agg(F.sum("r_debit_c").alias("out_c")).where(F.col("out_c") >= F.col("l_credit_c")).select(A, F.col("l_seq").alias("seq"), F.col("l_credit_c").alias("credit_c"), "out_c")


def weekend_rows(ledger: DataFrame, holidays: DataFrame) -> DataFrame:
    """Cheque rows on a Sunday or a listed holiday (d)."""
    marked = ledger.where(F.col("description").startswith("CLG/")).join(holidays.select("d", F.lit(True).alias("holiday")).distinct(), "d", "left")
    return marked.where(F.col("holiday") | (F.dayofweek("d") == 1)).groupBy(A).agg(F.count("*").alias("n"))


def bounce_rates(ledger: DataFrame) -> DataFrame:
    """Bounces against cheques presented, and days since the last bounce."""
    b = F.contains(F.upper("description"), F.lit("RETURN CHARGES"))
    s = ledger.groupBy(A).agg(F.count_if(b).alias("bounces"), F.count_if(F.col("description").startswith("CLG/")).alias("cheques"), F.datediff(F.max("d"), F.max(F.when(b, F.col("d")))).cast("long").alias("days_since"))
    return s.withColumn("rate", F.round(F.try_divide(F.col("bounces").cast("double"), F.col("cheques").cast("double")), 4))


def upi_apps(ledger: DataFrame) -> DataFrame:
    """Rows by the app that a VPA's handle belongs to."""
    handle = F.lower(F.regexp_extract("description", r"@([A-Za-z]+)", 1))
    return ledger.withColumn("handle", handle).where("handle <> ''").groupBy("handle").agg(F.count("*").alias("n"), F.countDistinct(A).alias("accounts"))


def balance_trend(ledger: DataFrame) -> DataFrame:
    """Whether the last month's closing balance is above the first's."""
    m = ledger.groupBy(A, "ym").agg(F.max_by("balance_c", "seq").alias("b")).groupBy(A).agg(F.min_by("b", "ym").alias("first_c"), F.max_by("b", "ym").alias("last_c"))
    return m.withColumn("trend", F.when(F.col("last_c") > F.col("first_c"), "UP").when(F.col("last_c") < F.col("first_c"), "DOWN").otherwise("FLAT"))


def variance_bands(declared: DataFrame, ledger: DataFrame) -> DataFrame:
    """Declared monthly turnover (account_id, ym, declared_c) against credits: within 10 percent MATCH, within
    25 REVIEW, else MISMATCH; a month without a declaration is MISSING."""
    m = ledger.groupBy(A, "ym").agg(F.sum("credit_c").alias("credit_c")).join(declared, [A, "ym"], "left")
    off = F.abs(F.col("credit_c") - F.col("declared_c")) * 100
    return m.select(A, "ym", F.when(F.col("declared_c").isNull(), "MISSING").when(off <= F.col("declared_c") * 10, "MATCH").when(off <= F.col("declared_c") * 25, "REVIEW").otherwise("MISMATCH").alias("band"))


def deposits_then_withdrawal(ledger: DataFrame, least: int = 2, days: int = 3) -> DataFrame:
    """Large debits with two or more credits on their day or the three before that come to as much or more."""
    w = Window.partitionBy(A).orderBy(F.unix_date("d")).rangeBetween(-days, 0)
    r = ledger.withColumns({"n": F.count(F.when(F.col("credit_c") > 0, 1)).over(w), "in_c": F.sum("credit_c").over(w)})
    return r.where((F.col("debit_c") >= 5_000_000) & (F.col("n") >= least) & (F.col("in_c") >= F.col("debit_c"))).select(A, "seq", "debit_c", "in_c")


def high_spending(ledger: DataFrame, share: float = 0.05) -> DataFrame:
    """Debits of over five percent of an account's credits."""
    income = ledger.groupBy(A).agg(F.sum("credit_c").alias("i"))
    return ledger.where("debit_c > 0").join(income, A).where(F.col("debit_c") * 100 > F.col("i") * int(share * 100)).select(A, "seq", "debit_c")


def consolidated(ledger: DataFrame, owners: DataFrame) -> DataFrame:
    """Inflow and outflow per owner and month over all its accounts; owners: (account_id, owner)."""
    return ledger.join(owners, A).groupBy("owner", "ym").agg(F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c"), F.countDistinct(A).alias("accounts"))


def credit_line_use(stretches: DataFrame, limits: DataFrame) -> DataFrame:
    """Use of an overdraft by end-of-day balances: mean and largest use in percent of the limit, days beyond it, and
    the band of the mean. stretches: (account_id, days, balance_c), see timeline. limits: (account_id, limit_c); accounts
    without one are left out. Fixed bounds."""
    used, days = F.greatest(F.lit(0), -F.col("balance_c")), F.col("days")
    s = stretches.join(limits.where("limit_c > 0").hint("merge"), A).groupBy(A, "limit_c").agg(F.sum(used * days).alias("used_c"), F.sum(days).alias("days"), F.max(used).alias("most_c"), F.sum(F.when(used > F.col("limit_c"), days).otherwise(0)).alias("overdrawn_days"))
    mean = F.col("used_c") * 100.0 / F.col("days") / F.col("limit_c")
    most = F.col("most_c") * 100.0 / F.col("limit_c")
    return s.select(A, F.round(mean + 1e-9, 2).alias("mean_pct"), F.round(most + 1e-9, 2).alias("most_pct"), "overdrawn_days", F.when(mean < 30, "HEALTHY").when(mean <= 50, "MODERATE").otherwise("RISKY").alias("band"), (most > 100).alias("beyond"))


def three_hops(transfers: DataFrame, days: int = 3) -> DataFrame:
    """A to B to C and back to A: three transfers between three accounts, each on the day of the one before or up to
    `days` later, within five percent of the first amount. transfers: (id, src, dst, d, amount_c). Each step is an
    equi-join on the account and a bucket of days; no pairs of one account's whole history are made."""
    size = days + 1
    bucket = F.floor(F.unix_date("d") / size)
    t = transfers.select("id", "src", "dst", "d", "amount_c")
    ahead = lambda n: t.select(*[F.col(c).alias(f"{c}{n}") for c in t.columns]).withColumn("__b", F.explode(F.array(F.floor(F.unix_date(f"d{n}") / size), F.floor(F.unix_date(f"d{n}") / size) - 1))).withColumnRenamed(f"src{n}", "__at")
    near = lambda n, before: F.datediff(f"d{n}", before).between(0, days) & (F.abs(F.col(f"amount_c{n}") - F.col("amount_c")) * 20 <= F.col("amount_c"))
    one = t.where("src <> dst").withColumn("__b", bucket).withColumn("__at", F.col("dst"))
    two = one.join(ahead(2), ["__at", "__b"]).where(near(2, "d") & (F.col("dst2") != F.col("src")) & (F.col("dst2") != F.col("dst")) & (F.col("id2") != F.col("id")))
    two = two.withColumn("__b", F.floor(F.unix_date("d2") / size)).withColumn("__at", F.col("dst2"))
    three = two.join(ahead(3), ["__at", "__b"]).where(near(3, "d2") & (F.col("dst3") == F.col("src")))
    return three.select("src", F.col("dst").alias("via"), F.col("dst2").alias("via2"), "id", "id2", F.col("id3"))

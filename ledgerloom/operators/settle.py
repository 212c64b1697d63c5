"""What settles labels after the cascade: learned overrides, needs and wants, cached rules of last resort; and the
salary cycle with its fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import names
from ledgerloom.operators.periods import half_up
from ledgerloom.sources.tables import shared_copy

A = "account_id"
#: Fixed: subcategories that state no purpose and may be overwritten.
UNRESOLVED = ("Bank Transfer In", "Bank Transfer Out", "P2P Transfer In", "P2P Transfer Out", "Merchant Payment (UPI)", "Cheque", "Other Expense", "Other Income", "Other", "Uncategorized", "Unknown")
#: Fixed: the label that each subcategory of spending has, whichever tier found it.
NEEDS_WANTS = {
    "Need": ("Rent", "Home Loan EMI", "Society / Property Tax", "Grocery / Supermarket", "Electricity / Water / Gas", "Internet / Mobile / Broadband", "Fuel", "Metro / Bus / Toll / Parking", "Taxi", "Healthcare", "Insurance", "Education", "Loan / EMI"),
    "Want": ("Food Delivery", "Entertainment", "Shopping", "Travel", "Leisure", "Electronics", "Fashion", "Beauty", "Luxury"),
    "Unknown": ("Credit Card Repayment",),
}


def is_open(subcategory: Column) -> Column:
    """Whether a label states no purpose."""
    return F.coalesce(subcategory.isin(*UNRESOLVED) | (subcategory == ""), F.lit(True))


def overridden(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows with the labels that people gave their counterparties, confidence 0.99, method and rule; only rows whose
    label states no purpose change.

    rows: account_id, key, category, subcategory, needs_wants, confidence, method, rule. overrides: (o_key, o_account,
    o_category, o_subcategory, o_label, updated_at), o_account null for all accounts. A key meets those that equal it,
    begin it or are begun by it (see names). Entries of the account come before those for all, later ones before
    earlier (ties: by subcategory). Keys are matched apart from rows, each distinct key once. rows are written once, as
    they are read often and dear to make; those that can't change aren't joined."""
    rows, given = shared_copy(rows, "rows"), shared_copy(overrides, "overrides")
    open_ = is_open(F.col("subcategory")) & (F.coalesce("key", F.lit("")) != "")
    every = rows.where(open_).select(F.lit(0).alias(A), "key").distinct()
    pairs = shared_copy(names.matching_keys(every, given.select(F.lit(0).alias(A), F.col("o_key").alias("key")).distinct()).select("key", F.col("other").alias("o_key")), "pairs")
    entry = F.struct("updated_at", "o_subcategory", "o_category", "o_label")
    last = pairs.join(given, "o_key").groupBy("key", "o_account").agg(F.max(entry).alias("e"))
    own, everyone = last.where("o_account is not null").select(F.col("key").alias("__key"), F.col("o_account").alias("__account"), F.col("e").alias("__own")), last.where("o_account is null").select(F.col("key").alias("__all_key"), F.col("e").alias("__all"))
    met = rows.where(open_).join(own, (F.col("key") == F.col("__key")) & (F.col(A) == F.col("__account")), "left").join(everyone, F.col("key") == F.col("__all_key"), "left")
    e, hit = F.coalesce("__own", "__all"), F.coalesce("__own", "__all").isNotNull()
    new = {"category": e["o_category"], "subcategory": e["o_subcategory"], "needs_wants": e["o_label"], "confidence": F.lit(0.99), "method": F.lit("counterparty_override"), "rule": F.when(F.col("__own").isNotNull(), "override:applicant").otherwise("override:global")}
    changed = met.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])
    return changed.unionAll(rows.where(~open_))


def needs_wants(category: Column, subcategory: Column, label: Column) -> Column:
    """Not Applicable but for spending; its subcategory's label, else the one it has, else Unknown."""
    out = F.when(category != "Expense", "Not Applicable")
    for name, group in NEEDS_WANTS.items():
        out = out.when(subcategory.isin(*group), name)
    return out.when(F.trim(label).isin("Need", "Want", "Unknown"), F.trim(label)).otherwise("Unknown")


def salary_cycle(credits: DataFrame, is_salary: Column, least_c: int = 500_000) -> DataFrame:
    """(account_id, income_c, detected, source, payee, n, days): from credits over `least_c`, an account's salary by
    keyword (the median); else its payee of two or more credits with the highest median (ties: by name); else the mean
    of all, undetected. days: the salary's dates, ascending. credits: account_id, seq, d, credit_c, payee."""
    own = credits.where(F.col("credit_c") > least_c).withColumn("__salary", F.coalesce(is_salary, F.lit(False)))
    payees = own.where("payee is not null").groupBy(A, "payee").agg(F.count("*").alias("n"), F.median("credit_c").alias("median_c"), F.array_sort(F.collect_list("d")).alias("days")).where("n >= 2")
    best = payees.groupBy(A).agg(F.min_by(F.struct("payee", "n", "median_c", "days"), F.struct(-F.col("median_c"), "payee")).alias("p"))
    paid = F.when(F.col("__salary"), F.col("credit_c"))
    whole = own.groupBy(A).agg(F.count(paid).alias("n"), F.median(paid).alias("median_c"), F.array_sort(F.collect_list(F.when(F.col("__salary"), F.col("d")))).alias("days"), half_up(F.sum("credit_c"), F.count("*")).alias("mean_c"))
    both = whole.join(best, A, "left")
    by_word, by_payee = F.col("n") > 0, F.col("p").isNotNull()
    none = F.array().cast("array<date>")
    return both.select(
        A, F.when(by_word, F.col("median_c")).when(by_payee, F.col("p.median_c")).otherwise(F.col("mean_c").cast("double")).alias("income_c"), (by_word | by_payee).alias("detected"), F.when(by_word, "keyword").when(by_payee, "payee").otherwise("mean").alias("source"),
        F.when(~by_word, F.col("p.payee")).alias("payee"), F.when(by_word, F.col("n")).otherwise(F.coalesce("p.n", F.lit(0))).alias("n"), F.when(by_word, F.col("days")).otherwise(F.coalesce("p.days", none)).alias("days"),
    )


def _digest(version: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(version), F.lit("\x00"), "text"), 256))


def with_labels(rows: DataFrame, path: str, version: str) -> DataFrame:
    """rows with the labels of their column text that cached_labels has put under `path`; rows without one go. Rows meet
    labels by the digest, so no text travels."""
    keyed = rows.where("text is not null").select(*[c for c in rows.columns if c != "text"], _digest(version).alias("digest"))
    return keyed.join(rows.sparkSession.read.parquet(path), "digest").drop("digest")


def cached_labels(spark: SparkSession, texts: DataFrame, path: str, version: str, rule: Column) -> DataFrame:
    """(text, label) of each distinct text, by `rule` over a column text, remembered under `path` by the digest of text
    and version: a run labels only texts that no run before it labelled with that version. A cache that only grows; a
    run that fails leaves no part of its labels."""
    own = texts.select("text").where("text is not null").distinct().withColumn("digest", _digest(version))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else None
    unseen = own if known is None else own.join(known.select("digest"), "digest", "left_anti")
    unseen.select("digest", rule.alias("label")).write.mode("append").parquet(path)
    return own.join(spark.read.parquet(path), "digest").select("text", "label")

"""Narration parsing and classification.

Bank forms are parsed into one struct by native expressions. Classification is a cascade in which the first
tier that knows a row decides; dictionaries are small tables whose size is checked before they are broadcast."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text

A = "account_id"
#: Rows of a dictionary up to which it is broadcast; a larger one is left to Catalyst.
BROADCAST_ROWS = 10_000
BANK_WORDS = r"(?i)(bank|paytm|okaxis|oksbi|okicici|okhdfc|kotak|union|canara|hdfc|icici|axis|sbi)"

#: keyword, category, subcategory, needs or wants, order. Our own dictionary over the words of narrations.
KEYWORDS = [
    ("widget", "Expense", "Household", "Need", 1), ("plate", "Expense", "Kitchen", "Need", 2), ("hot plate", "Expense", "Appliances", "Want", 3), ("ring", "Expense", "Jewellery", "Want", 4),
    ("gizmo", "Expense", "Electronics", "Want", 5), ("bolt", "Expense", "Repairs", "Need", 6), ("rod", "Expense", "Repairs", "Need", 7), ("gear", "Expense", "Transport", "Need", 8),
    ("anvil", "Expense", "Tools", "Want", 9), ("red anvil", "Expense", "Collectibles", "Want", 10), ("salary", "Income", "Salary", "Not Applicable", 11), ("payroll", "Income", "Salary", "Not Applicable", 12),
    ("interest", "Income", "Interest", "Not Applicable", 13), ("refund", "Income", "Refund", "Not Applicable", 14),
]
#: VPA handle part, merchant, category, subcategory; the first in order that a VPA holds decides.
HANDLES = [("s1@", "Alpha Stores", "Expense", "Groceries", 1), ("s2", "Beta Mart", "Expense", "Groceries", 2), ("@okaxis", "Axis Merchant", "Expense", "Shopping", 3), ("@oksbi", "State Merchant", "Expense", "Bills", 4)]


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "keyword string, k_category string, k_subcategory string, k_label string, ord int")


def handles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HANDLES, "handle string, merchant string, h_category string, h_subcategory string, ord int")


def small(table: DataFrame, known: int | None = None) -> DataFrame:
    """A hint to broadcast, for a table of few enough rows."""
    n = known if known is not None else table.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(table) if n <= BROADCAST_ROWS else table


def _part(c: Column, sep: str, i: int) -> Column:
    return F.trim(F.coalesce(F.get(F.split(c, sep), F.lit(i)), F.lit("")))


def _parsed(**fields: Column | str) -> Column:
    names = ("rail", "ref", "payee", "vpa", "remarks", "bank")
    return F.struct(*[(F.lit(v) if isinstance(v := fields.get(n, ""), str) else v).alias(n) for n in names])


def _up(d: Column, prefix: str) -> Column:
    return F.upper(d).startswith(prefix)


def parse_sbi(d: Column) -> Column:
    s = lambda i: _part(d, "/", i)
    return (
        F.when(F.contains(F.upper(d), F.lit("TRANSFER-UPI")), _parsed(rail="UPI", ref=s(2), payee=s(3), vpa=s(5), remarks=s(6)))
        .when(_up(d, "NEFT"), _parsed(rail="NEFT")).when(_up(d, "ECS"), _parsed(rail="ECS"))
        .when(F.contains(F.upper(d), F.lit("IMPS")), _parsed(rail="IMPS")).otherwise(_parsed())
    )


def parse_icici(d: Column) -> Column:
    s, h = (lambda i: _part(d, "/", i)), (lambda i: _part(d, "-", i))
    return (
        F.when(_up(d, "UPI/"), _parsed(rail="UPI", ref=s(1), payee=s(1), remarks=s(2), vpa=s(3)))
        .when(_up(d, "BIL/NEFT/"), _parsed(rail="NEFT", ref=s(2), payee=s(3))).when(_up(d, "MMT/IMPS/"), _parsed(rail="IMPS", ref=s(2), payee=s(3)))
        .when(_up(d, "ACH/"), _parsed(rail="ACH", payee=s(1), ref=s(2))).when(_up(d, "EBA/MFP-"), _parsed(rail="EBA_MF", ref=d)).when(_up(d, "CAM/"), _parsed(rail="ATM"))
        .when(_up(d, "CLG/"), _parsed(rail="CLG", payee=s(1))).when(_up(d, "NEFT-"), _parsed(rail="NEFT", ref=h(1), payee=h(2))).otherwise(_parsed())
    )


def parse_axis(d: Column) -> Column:
    """The slot after the payee holds a bank or a remark, told apart by content."""
    s = lambda i: _part(d, "/", i)
    a, b = s(4), s(5)
    a_bank, b_bank = a.rlike(BANK_WORDS), b.rlike(BANK_WORDS)
    bank = F.when(b_bank & ~a_bank, b).otherwise(a)
    remark = F.when(b_bank & ~a_bank, a).when(a_bank & b_bank, "").otherwise(b)
    return (
        F.when(_up(d, "UPI/P2M/") | _up(d, "UPI/P2A/"), _parsed(rail="UPI", ref=s(2), payee=s(3), bank=bank, remarks=remark))
        .when(_up(d, "UPI/"), _parsed(rail="UPI", ref=s(1), payee=s(2), vpa=s(3))).when(F.contains(F.upper(d), F.lit("ATM")), _parsed(rail="ATM")).otherwise(_parsed())
    )


def parse_boi(d: Column) -> Column:
    s, h = (lambda i: _part(d, "/", i)), (lambda i: _part(d, "-", i))
    return (
        F.when(_up(d, "UPI-"), _parsed(rail="UPI", payee=h(1), vpa=h(2), ref=h(3))).when(_up(d, "UPI/"), _parsed(rail="UPI", ref=s(1), remarks=s(2)))
        .when(_up(d, "ECS/"), _parsed(rail="ECS", payee=s(1))).when(F.contains(F.upper(d), F.lit("CHARGES")), _parsed(rail="CHARGES")).when(F.length(F.trim(d)) <= 30, _parsed(payee=F.trim(d))).otherwise(_parsed())
    )


def parse_union(d: Column) -> Column:
    s, h = (lambda i: _part(d, "/", i)), (lambda i: _part(d, "-", i))
    return (
        F.when(_up(d, "UPI/"), _parsed(rail="UPI", ref=s(1), payee=s(2), remarks=s(3))).when(_up(d, "NEFT-"), _parsed(rail="NEFT", remarks=F.trim(d.substr(F.lit(6), F.length(d)))))
        .when(_up(d, "NACH-"), _parsed(rail="NACH", payee=h(1))).when(F.contains(F.upper(d), F.lit("CHARGES")), _parsed(rail="CHARGES")).otherwise(_parsed())
    )


def parse_bob(d: Column) -> Column:
    s, h = (lambda i: _part(d, "/", i)), (lambda i: _part(d, "-", i))
    vpa = F.coalesce(F.get(F.filter(F.array(s(3), s(4), s(5)), lambda x: F.contains(x, F.lit("@"))), F.lit(0)), F.lit(""))
    return F.when(_up(d, "UPI/"), _parsed(rail="UPI", ref=s(1), vpa=vpa, payee=F.substring_index(vpa, "@", 1))).when(_up(d, "NEFT-") | _up(d, "RTGS-"), _parsed(rail=F.when(_up(d, "NEFT-"), "NEFT").otherwise("RTGS"), ref=h(1), payee=h(2))).otherwise(_parsed())


def parse_tokens(d: Column) -> Column:
    """Any narration: split at its most frequent delimiter; a field with @ is the VPA and the first that looks
    like a name the payee."""
    count = lambda c: F.length(d) - F.length(F.replace(d, F.lit(c), F.lit("")))
    slash, dash, star = count("/"), count("-"), count("*")
    sep = F.when((slash >= dash) & (slash >= star), "/").when(dash >= star, "-").otherwise("*")
    fields = F.transform(F.split(F.when(sep == "/", F.translate(d, "/", "\x01")).when(sep == "-", F.translate(d, "-", "\x01")).otherwise(F.translate(d, "*", "\x01")), "\x01"), lambda x: F.trim(x))
    name = F.filter(fields, lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9 .&]{3,}$") & ~F.upper(x).isin("IMPS", "NEFT", "CASH WDL") & ~x.rlike(BANK_WORDS))
    vpa = F.filter(fields, lambda x: F.contains(x, F.lit("@")))
    return F.struct(F.coalesce(F.get(vpa, F.lit(0)), F.lit("")).alias("vpa"), F.coalesce(F.get(name, F.lit(0)), F.lit("")).alias("payee"))


PARSERS = {"SBI": parse_sbi, "ICICI": parse_icici, "AXIS": parse_axis, "BOI": parse_boi, "UNION": parse_union, "BOB": parse_bob}


def parse(bank: Column, d: Column) -> Column:
    """The bank's parser; fields it leaves blank are filled from the general one."""
    own = F.when(F.lit(False), _parsed())
    for name, parser in PARSERS.items():
        own = own.when(bank == name, parser(d))
    own, other = own.otherwise(_parsed()), parse_tokens(d)
    fill = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return F.struct(own["rail"].alias("rail"), own["ref"].alias("ref"), fill(own["payee"], other["payee"]).alias("payee"), fill(own["vpa"], other["vpa"]).alias("vpa"), own["remarks"].alias("remarks"))


def boundary(text: Column, keyword: Column) -> Column:
    """The keyword stands in the text with no letter or digit beside it."""
    return F.regexp(text, F.concat(F.lit("(^|[^a-z0-9])"), keyword, F.lit("([^a-z0-9]|$)")))


def keyword_of(text: Column, entries: list[tuple] = KEYWORDS) -> Column:
    """The entry (a struct) of the longest keyword that stands in the text (ties: by order), else null."""
    return _keyword_in(F.lower(text), entries)


def _keyword_in(low: Column, entries: list[tuple]) -> Column:
    """keyword_of a text in small letters. The few entries are tried one after another, the longest first; a regular
    expression only runs where the keyword's letters are."""
    ranked = sorted(entries, key=lambda e: (-len(e[0]), e[-1]))
    known = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("keyword", "k_category", "k_subcategory", "k_label", "ord"), e, strict=True)]) for e in ranked])
    at = F.coalesce(*[F.when(F.contains(low, F.lit(e[0])) & boundary(low, F.lit(e[0])), F.lit(i)) for i, e in enumerate(ranked)])
    return F.get(known, at)


def longest_keyword(rows: DataFrame, text: str = "description") -> DataFrame:
    """The keyword, category and subcategory of each row's longest dictionary match (ties: by order)."""
    # A column of its own, as each of the tests would else make small letters for itself.
    low = rows.withColumn("__low", F.lower(text))
    return low.select(*rows.columns, F.inline(F.array(_keyword_in(F.col("__low"), KEYWORDS)))).drop("ord")


def vpa_directory(rows: DataFrame, text: str = "description") -> DataFrame:
    """The first directory entry that a row's VPA holds; a credit from a merchant is its refund."""
    known = F.from_json(F.lit(json.dumps([{"handle": h, "merchant": m, "h_category": c, "h_subcategory": s} for h, m, c, s, _ in sorted(HANDLES, key=lambda x: x[-1])])), "array<struct<handle: string, merchant: string, h_category: string, h_subcategory: string>>")
    vpas = rows.withColumn("vpa", F.lower(F.regexp_extract(text, r"([A-Za-z0-9.]+@[A-Za-z]+)", 1)))
    hit = vpas.withColumn("h", F.get(F.filter(known, lambda e: F.contains(F.col("vpa"), e["handle"])), F.lit(0))).where("h is not null")
    refund = (F.col("credit_c") > 0) & (F.col("h.h_category") == "Expense")
    return hit.select(*rows.columns, "vpa", "h.merchant", F.when(refund, "Income").otherwise(F.col("h.h_category")).alias("category"), F.when(refund, F.concat(F.col("h.merchant"), F.lit(" Refund"))).otherwise(F.col("h.h_subcategory")).alias("subcategory"))


def tier_one(d: Column, debit: Column) -> Column:
    """Bank rules in order; null where none fits."""
    return _tier_one(F.upper(d), debit)


def _tier_one(u: Column, debit: Column) -> Column:
    """tier_one of a narration in capitals."""
    has = lambda s: F.contains(u, F.lit(s))
    out = lambda c, s, p: F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory"), F.lit(p).alias("confidence"))
    return (
        F.when(u.startswith("EBA/MFP-"), out("Investment", "Mutual Fund", 0.99)).when(u.startswith("ACH/") & (debit > 0), out("Banking", "Loan EMI", 0.97)).when(u.startswith("ACH/"), out("Income", "Dividend", 0.95))
        .when(has("CASH WDL"), out("Banking", "Cash Withdrawal", 0.98)).when(has("RETURN CHARGES"), out("Banking", "Bounce Charges", 0.97)).when(u.startswith("CLG/"), out("Transfer", "Cheque", 0.95))
    )


def classify(ledger: DataFrame) -> DataFrame:
    """The ledger with category, subcategory, needs_wants, confidence and method: bank rules, then the longest
    keyword whose direction fits, then the rail, then nothing. Each tier is a column, and `coalesce` takes the
    first that knows the row."""
    k = longest_keyword(ledger).withColumn("__up", F.upper("description"))
    fits = ~((F.col("credit_c") > 0) & (F.col("k_category") == "Expense")) & ~((F.col("debit_c") > 0) & (F.col("k_category") == "Income"))
    u = F.col("__up")
    tier = lambda c, s, label, p, m: F.struct(c.alias("category"), s.alias("subcategory"), label.alias("needs_wants"), F.lit(p).cast("double").alias("confidence") if not isinstance(p, Column) else p.alias("confidence"), F.lit(m).alias("method"))
    t1 = _tier_one(u, F.col("debit_c"))
    one = F.when(t1.isNotNull(), tier(t1["category"], t1["subcategory"], F.lit("Not Applicable"), t1["confidence"], "bank_rule"))
    two = F.when(F.col("keyword").isNotNull() & fits, tier(F.col("k_category"), F.col("k_subcategory"), F.col("k_label"), 0.90, "keyword"))
    by_rail = lambda test, c, s, p: F.when(test, tier(F.lit(c), F.lit(s), F.lit("Unknown" if c == "Expense" else "Not Applicable"), p, "rail"))
    rails = [by_rail(F.contains(u, F.lit("UPI/P2M/")) & (F.col("debit_c") > 0), "Expense", "Merchant", 0.6), by_rail(F.contains(u, F.lit("UPI")), "Transfer", "UPI Transfer", 0.5), by_rail(u.rlike("NEFT|IMPS|RTGS"), "Transfer", "Bank Transfer", 0.5)]
    none = tier(F.lit("Uncategorized"), F.lit("Unknown"), F.lit("Unknown"), 0.0, "none")
    # A generator, as Catalyst would copy a column's expression into each field and filter that uses the label.
    return k.select(*ledger.columns, F.inline(F.array(F.coalesce(one, two, *rails, none))))


def tags(d: Column, subcategory: Column, debit: Column) -> Column:
    """All labels that hold, each once, in fixed order. Marks and their order are fixed values."""
    u = F.upper(d)
    has = lambda *marks: text.holds(u, "|".join(marks))
    upi, is_loan = has("UPI"), has("LOAN") | subcategory.isin("Loan / EMI", "Home Loan EMI", "Personal Loan")
    merchant = has("@BHARATPE", "@RAZORPAY", "@HDFCBANKSMARTPAY", "@PAYTMQR", "@BILLDESK", "P2M")
    person = has("@YBL", "@PAYTM", "@OKSBI", "@OKHDFCBANK", "@OKAXIS", "@OKICICI", "P2P")
    cash_machine = has("ATM", "ATW", "NFS/")
    rules = [
        ("UPI", upi), (F.when(merchant, "UPI/P2M").when(person, "UPI/P2P"), upi), ("NEFT", has("NEFT")), ("IMPS", has("IMPS", "MMT/")), ("RTGS", has("RTGS")), ("NACH", has("NACH")), ("ECS", has("ECS")), ("NACH", has("ECS")),
        ("Cheque", has("CLG", "CHEQUE", "CHQ")), ("ATM", cash_machine), ("Cash", cash_machine | has("CASH DEP", "BY CASH", "CDM")), ("Loan", is_loan), ("EMI", is_loan & ((debit > 0) | has("EMI", "NACH", "ECS"))),
        ("Salary", has("SALARY") | (subcategory == "Salary")), ("Insurance", has("INSURANCE", "LIC") | (subcategory == "Insurance")), ("Tax", has("TAX", "GST", "CBIC")),
        ("Return", has("RETURN", "BOUNCE", "REVERSAL", "RVSL", "INSUFFICIENT FUNDS")), ("Bank Charges", has("CHARGE", "FEE", "MIN BAL", "PENAL", "CHG")),
    ]
    # Nulls and repetitions go at once, without a lambda: what stands inside one is never compiled.
    return F.array_except(F.array(*[F.when(test, F.lit(name) if isinstance(name, str) else name) for name, test in rules]), F.array(F.lit(None).cast("string")))


def counterparty_key(payee: Column, vpa: Column, bank: Column) -> Column:
    """The VPA's local part, else the payee without anything but letters and digits; a short one is joined with
    its bank."""
    squeezed = F.regexp_replace(F.upper(payee), "[^A-Z0-9]", "")
    return F.when(vpa != "", F.upper(F.substring_index(vpa, "@", 1))).when(F.length(squeezed) <= 10, F.concat(squeezed, F.lit("|"), F.upper(F.coalesce(bank, F.lit(""))))).otherwise(squeezed)


#: Fixed: words that are no part of a name.
TITLES = r"\b(MR|MRS|MS|MISS|DR|SHRI|SMT|SRI|PROF)\b"


def name_words(name: Column) -> Column:
    """Words of three letters or more of a name, without titles."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9 ]", " "), TITLES, " "), " +"), lambda x: F.length(x) >= 3)


def self_transfers(rows: DataFrame, holder: Column, payee: Column, vpa: Column | None = None, least: int = 6) -> DataFrame:
    """is_self: the payee's joined words begin the holder's or the other way round (`least` characters), they share
    a word of four letters or more, or the VPA holds such a word of the holder's. Without a holder: false."""
    own, other = name_words(holder), name_words(payee)
    flat, their = F.array_join(own, ""), F.array_join(other, "")
    long = F.filter(own, lambda x: F.length(x) >= 4)
    prefix = (F.length(their) >= least) & (flat.startswith(their) | their.startswith(flat))
    handle = F.upper(F.coalesce(vpa, F.lit(""))) if vpa is not None else F.lit("")
    in_handle = F.exists(long, lambda x: F.contains(F.substring_index(handle, "@", 1), x))
    return rows.withColumn("is_self", (F.size(own) > 0) & (prefix | F.coalesce(F.arrays_overlap(long, other), F.lit(False)) | in_handle))


def known_salary_payers(rows: DataFrame, least: int = 2) -> DataFrame:
    """Payers of `least` or more salary-like credits of an account."""
    return rows.where((F.col("credit_c") > 0) & F.upper("description").rlike("SALARY|PAYROLL")).groupBy(A, F.regexp_extract("description", r"(EMPLOYER \d+)", 1).alias("payer")).agg(F.count("*").alias("n"), F.sum("credit_c").alias("total_c")).where(F.col("n") >= least)


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: str = "counterparty") -> DataFrame:
    """Learned labels: of an account's and the global overrides of a key the account's comes first, then the
    latest. Overrides: (key, o_account, o_category, o_subcategory, updated_at). Only they are ranked; rows look up
    at most one of each kind."""
    w = Window.partitionBy("key", "o_account").orderBy(F.desc("updated_at"), "o_subcategory")
    last = overrides.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    everyone = last.where("o_account is null").select(F.col("key").alias("__key"), F.struct("o_category", "o_subcategory").alias("__all"))
    own = last.where("o_account is not null").select(F.col("key").alias("__key"), F.col("o_account").alias(A), F.struct("o_category", "o_subcategory").alias("__own"))
    keyed = rows.withColumn("__key", F.col(key))
    o = keyed.join(small(own), ["__key", A], "left").join(small(everyone), "__key", "left").withColumn("__o", F.coalesce("__own", "__all"))
    return o.select(*rows.columns, "__o.o_category", "__o.o_subcategory")


def set_override(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with entries of the same key and scope replaced."""
    same = (registry["key"] == new["key"]) & registry["o_account"].eqNullSafe(new["o_account"])
    return registry.join(new, same, "left_anti").unionByName(new)


def needs_wants(category: Column, label: Column) -> Column:
    return F.when(category != "Expense", "Not Applicable").otherwise(F.coalesce(F.when(label.isin("Need", "Want"), label), F.lit("Unknown")))


def lenders(rows: DataFrame) -> DataFrame:
    """The lender of loan payments and whether a credit is a borrowing."""
    name = F.regexp_extract("description", r"ACH/([^/]+)/", 1)
    return rows.where(name != "").withColumn("lender", name).withColumn("is_borrowing", F.col("credit_c") > 0)

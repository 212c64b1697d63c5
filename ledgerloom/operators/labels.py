"""Further label sources: prefixes, fuzzy matches, rails, heuristics and learned recurrence."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.classify import KEYWORDS, keyword_of, keywords, small

A = "account_id"
REMARKS = [("red", "Want"), ("small", "Need"), ("large", "Need"), ("hot pl", "Want"), ("hot", "Need")]
#: Behaviour taxonomy: the first group with a word in the text.
TAXONOMY = (("NEEDS", ("widget", "plate", "rod", "lender")), ("WANTS", ("gizmo", "ring", "anvil")), ("INVESTMENT", ("mfp", "sip")))


def truncated(values: DataFrame, value: str = "value", least: int = 6) -> DataFrame:
    """The longest keyword of which a value of `least` characters or more is the beginning."""
    k = small(keywords(values.sparkSession), len(KEYWORDS)).withColumn("head", F.substring("keyword", 1, least))
    v = values.select(value).distinct().where(F.length(value) >= least).withColumn("head", F.substring(F.lower(value), 1, least))
    hit = v.join(k, "head").where(F.col("keyword").startswith(F.lower(value)))
    return hit.groupBy(value).agg(F.max_by(F.struct("keyword", "k_subcategory"), F.struct(F.length("keyword"), -F.col("ord"))).alias("k")).select(value, "k.*")


def remark_label(remark: Column) -> Column:
    """Need or Want by the longest known beginning of a remark."""
    out = F.lit(None).cast("string")
    for prefix, label in sorted(REMARKS, key=lambda r: len(r[0])):
        out = F.when(F.lower(remark).startswith(prefix), F.lit(label)).otherwise(out)
    return out


#: Beginnings of remarks and the subcategory each group stands for, and remarks that say nothing.
REMARK_SUBCATEGORIES = (
    ("Grocery / Supermarket", ("milk", "curd", "dahi", "oil", "ghee", "butter", "bread", "wheat", "atta", "rice", "dal", "sugar", "salt", "banana", "fruit", "veg", "sabzi", "kirana", "grocer", "chees", "lassi", "paneer", "egg", "masala", "coconu", "olive", "1 kg", "2 kg", "dettol", "soap", "shampo", "towel", "detergen", "det pd", "hand w", "paste", "tissue", "harpic", "phenyl")),
    ("Healthcare", ("medici", "medicin", "tablet", "eye dr", "eye do", "specs", "spectac", "arthre", "arthrel", "doctor", "clinic", "hospit", "pharma", "chemist", "nepa ey", "xray", "scan")),
    ("Taxi", ("taxi", "auto", "rickshaw", "maruti", "parking", "toll")),
    ("Metro / Bus / Toll / Parking", ("railwa", "train", "ticket", "bus", "payvia")),
    ("Fuel", ("petrol", "diesel", "fuel")),
    ("Electricity / Water / Gas", ("cable", "cabale", "electric", "water", "gas cyl")),
    ("Internet / Mobile / Broadband", ("wifi", "broadb", "recharg")),
    ("Society / Property Tax", ("societ", "maint")),
    ("Rent", ("rent",)),
    ("Education", ("fee", "tuition", "school", "colleg", "zerox", "xerox", "print", "photoco", "stationer", "book", "notebook")),
    ("Food Delivery", ("lunch", "dinner", "breakfa", "tea", "coffee", "snack", "sandwic", "bhel", "biryan", "pizza", "burger", "cake", "sweet", "laddu", "icecrea", "ice cr", "juice", "cold dr", "restau", "canteen", "cater", "hotel")),
    ("Fashion", ("shirt", "t shirt", "dress", "sadra", "tailor", "cloth", "jean", "saree", "kurta", "shoe", "chappal", "bag")),
    ("Beauty", ("salon", "parlour", "haircut")),
    ("Entertainment", ("movie", "cinema", "game", "toy", "party", "picnic", "buke", "bouque", "flower", "gift", "lyric")),
)
SAYS_NOTHING = ("upi", "payment", "paymen", "pay", "pay to", "payvia", "transf", "transfe", "transfer", "to", "for", "na", "n/a", "-", "cash", "amount", "amt", "money", "send", "sent", "recv", "received", "self", "test")


def remark_subcategory(remark: Column) -> Column:
    """The subcategory of the longest known beginning of a remark (ties: the group that comes first); else null."""
    r = F.lower(F.trim(remark))
    prefixes = sorted((p for _, group in REMARK_SUBCATEGORIES for p in group), key=len, reverse=True)
    known = F.from_json(F.lit(json.dumps({p: name for name, group in REMARK_SUBCATEGORIES for p in group})), "map<string, string>")
    found = F.regexp_extract(r, f"^(?:{'|'.join(map(re.escape, prefixes))})", 0)
    return F.when((r != "") & ~r.isin(*SAYS_NOTHING), F.try_element_at(known, found))


#: Fixed: the order in which groups of keywords are looked through.
GROUPS = ("Need", "Want", "Investment", "Income", "Banking")


def keyword_category(keyword: Column, entries: list[tuple] = KEYWORDS) -> Column:
    """(category, subcategory, label) of a keyword, whatever its case, from the first group that has it: needs, wants,
    investments, income, banking; else (Expense, Other, N/A). entries: as KEYWORDS."""
    found: dict[str, dict] = {}
    for word, category, subcategory, label, _ in sorted(entries, key=lambda e: GROUPS.index(e[3] if e[1] == "Expense" else e[1])):
        found.setdefault(word.upper(), {"category": category, "subcategory": subcategory, "label": label if category == "Expense" else "N/A"})
    known = F.from_json(F.lit(json.dumps(found)), "map<string, struct<category: string, subcategory: string, label: string>>")
    none = F.struct(F.lit("Expense").alias("category"), F.lit("Other").alias("subcategory"), F.lit("N/A").alias("label"))
    return F.coalesce(F.try_element_at(known, F.upper(keyword)), none)


def merchant_entity(text: Column, merchants: dict[str, str]) -> Column:
    """The canonical name of the longest merchant key that stands in the text; else null. merchants: a dictionary of
    bounded size."""
    return keyword_of(text, [(k.lower(), name, "", "", i) for i, (k, name) in enumerate(merchants.items())])["k_category"]


def fuzzy_top(texts: DataFrame, names: DataFrame, least: float = 0.5, text: str = "description") -> DataFrame:
    """The name most similar to each distinct text by shared words over the fewer words of the two; candidates
    share a word. names: (name), a dictionary."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) > 1))
    t = texts.select(text).distinct().withColumn("tw", words(F.col(text)))
    n = names.select("name").distinct().withColumn("nw", words(F.col("name")))
    pairs = t.withColumn("w", F.explode("tw")).join(small(n.withColumn("w", F.explode("nw"))), "w").dropDuplicates([text, "name"])
    score = F.size(F.array_intersect("tw", "nw")) / F.least(F.size("tw"), F.size("nw"))
    return pairs.withColumn("score", F.round(score, 4)).where(F.col("score") >= least).groupBy(text).agg(F.max_by(F.struct("name", "score"), F.struct("score", F.length("name"), "name")).alias("m")).select(text, "m.*")


def taxonomy(description: Column) -> Column:
    out = F.when(F.contains(F.upper(description), F.lit("CASH WDL")), "CASH")
    for name, words in TAXONOMY:
        out = out.when(F.lower(description).rlike("|".join(words)), name)
    return out.otherwise("OTHER")


def heuristic(description: Column, debit: Column) -> Column:
    """Rules of last resort, in order."""
    u = F.upper(description)
    return F.when(u.rlike("EMI|LOAN|LENDER") & (debit > 0), "Loan EMI").when(u.rlike("CHARGES|FEE"), "Banking Charges").when(u.rlike("SALARY|PAYROLL"), "Salary").when(u.rlike("CASH"), "Cash").otherwise("Other")


def relabel_recurring(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Unresolved rows of fixed, cadenced counterparties become recurring payments."""
    known = groups.where("fixed and cadence <> 'IRREGULAR'").select(A, "counterparty", F.lit(True).alias("recurring"))
    j = rows.join(known, [A, "counterparty"], "left")
    hit = F.col("recurring") & F.col("subcategory").isin("Unknown", "UPI Transfer", "Bank Transfer")
    return j.withColumn("subcategory", F.when(hit, "Recurring Payment").otherwise(F.col("subcategory"))).drop("recurring")

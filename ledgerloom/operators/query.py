"""A question about a ledger is parsed into a small immutable plan, and the plan is compiled to one DataFrame.
Words for prose are not made here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import token_matches

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
STOP = frozenset("a all am and any are at average balance by can count credit credited credits debit debited debits payment payments did do does each earn for from give got have highest how i in is it largest least list lowest many max maximum me min minimum month monthly months most much my of on or paid pay per profile receive received show smallest spend spending spent sum tell the this time times to top total transaction transactions transfer transfers was were what when which who whom with year".split())
#: Subjects that mean a class of rows, not a name: matched against the classes only.
SUBJECTS = {"salary": "salary", "income": "income", "refund": "refund", "refunds": "refund"}


@dataclass(frozen=True)
class Question:
    """intent: balance_max, balance_min, by_month, profile, count, average, total, max, min or list."""

    intent: str
    direction: str | None = None
    months: tuple[int, ...] = ()
    years: tuple[int, ...] = ()
    tokens: tuple[str, ...] = ()
    subject: str | None = None
    top_n: int = 5
    extreme: str | None = None
    words: tuple[str, ...] = field(default=(), compare=False)


def parse(text: str) -> Question:
    """The plan of a question. Order of intents: balance, month, profile, count, average, total, extremes, list."""
    low = text.lower()
    words = re.findall(r"[a-z0-9]+", low)
    has = lambda *w: any(x in words for x in w)
    top = re.search(r"(?:top|largest|highest)\s+(\d+)", low)
    if "balance" in words and has("highest", "maximum", "max", "lowest", "minimum", "min"):
        intent = "balance_min" if has("lowest", "minimum", "min") else "balance_max"
    elif re.search(r"(by|each|per|which) month|monthly", low):
        intent = "by_month"
    elif re.search(r"\bwho (is|are)\b|\bprofile\b|tell me about", low):
        intent = "profile"
    elif re.search(r"how many|number of|\bcount\b", low):
        intent = "count"
    elif has("average", "mean"):
        intent = "average"
    elif re.search(r"how much|\btotal\b|\bsum\b", low):
        intent = "total"
    elif has("largest", "highest", "biggest", "maximum", "max", "top"):
        intent = "max"
    elif has("smallest", "lowest", "minimum", "min"):
        intent = "min"
    else:
        intent = "list"
    direction = "credit" if has("credit", "credits", "credited", "received", "receive", "income", "earn") else "debit" if has("debit", "debits", "debited", "spent", "spend", "paid", "pay", "spending") else None
    months = tuple(i + 1 for i, m in enumerate(MONTHS) if m in words or (m != "may" and m[:3] in words))
    years = tuple(int(w) for w in words if re.fullmatch(r"(19|20)\d\d", w))
    subject = next((SUBJECTS[w] for w in words if w in SUBJECTS), None)
    names = tuple(w for w in dict.fromkeys(words) if len(w) >= 3 and w not in STOP and w not in SUBJECTS and not w.isdigit() and w not in MONTHS and w not in {m[:3] for m in MONTHS} and w not in ("biggest", "mean", "number", "about"))
    return Question(intent, direction, months, years, names, subject, max(1, min(25, int(top[1]))) if top else 5, "max" if has("highest", "most", "maximum", "max", "largest", "biggest") else "min" if has("lowest", "least", "minimum", "min", "smallest") else None, tuple(words))


def predicate(q: Question) -> Column:
    """All conditions of a question as one filter, which Catalyst can push down."""
    parts: list[Column] = []
    if q.direction:
        parts.append(F.col(f"{q.direction}_c") > 0)
    if q.months:
        parts.append(F.month("d").isin(*q.months))
    if q.years:
        parts.append(F.year("d").isin(*q.years))
    if q.subject:
        parts.append(F.contains(F.lower(F.concat_ws(" ", "category", "subcategory")), F.lit(q.subject)))
    parts += [token_matches(F.concat_ws(" ", "description", "category", "subcategory"), t) for t in q.tokens]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def known_tokens(ledger: DataFrame, q: Question) -> tuple[str, ...]:
    """The forms of a question's tokens (as they are, else without a final s) that occur in the ledger, looked for in
    one aggregation; words that occur nowhere are prose."""
    if not q.tokens:
        return ()
    whole = F.concat_ws(" ", "description", "category", "subcategory")
    forms = {t: [t, t[:-1]] if t.endswith("s") and len(t) > 3 else [t] for t in q.tokens}
    every = list(dict.fromkeys(f for fs in forms.values() for f in fs))
    row = ledger.agg(*[F.max(token_matches(whole, t)).alias(f"t{i}") for i, t in enumerate(every)]).first()
    there = {t for i, t in enumerate(every) if row[i]}
    return tuple(dict.fromkeys(f for f in (next((f for f in fs if f in there), None) for fs in forms.values()) if f))


def ask(ledger: DataFrame, text: str) -> DataFrame:
    """A question put to a ledger as people ask: it is routed, its words are held against the ledger, and what is left
    is resolved. Small talk and refusals read no row; a question of no use to the ledger tells what can be asked."""
    way = route(text)
    if way in ("small_talk", "refusal"):
        return ledger.limit(0).select("account_id")
    if way == "capability":
        return capability(ledger)
    q = parse(text)
    return resolve(ledger, replace(q, tokens=known_tokens(ledger, q)))


def context_rows(ledger: DataFrame, text: str, limit: int = 12) -> DataFrame:
    """The rows a question is about, the largest first, `limit` of each account; all rows stand in where none match."""
    q = parse(text)
    q = replace(q, tokens=known_tokens(ledger, q))
    hit = predicate(q) if q.tokens or q.subject or q.direction or q.months or q.years else F.lit(False)
    amount = F.col("debit_c") + F.col("credit_c")
    some = F.max(hit.cast("int")).over(Window.partitionBy("account_id"))
    rows = ledger.withColumn("__hit", hit).withColumn("__some", some).where(F.col("__hit") | (F.col("__some") == 0))
    return rows.withColumn("rank", ranked(amount)).where(F.col("rank") <= limit).select("account_id", "rank", "seq", "d", "description", "debit_c", "credit_c", "category", "subcategory")


def resolve(ledger: DataFrame, question: str | Question) -> DataFrame:
    """The answer's rows, per account. An answer with no row says that nothing matched."""
    q = parse(question) if isinstance(question, str) else question
    rows = ledger.where(predicate(q))
    amount = F.col("debit_c") + F.col("credit_c")
    if q.intent in ("balance_max", "balance_min"):
        by = F.struct(F.col("balance_c") if q.intent == "balance_max" else -F.col("balance_c"), -F.col("seq"))
        return rows.where("balance_c <> 0").groupBy("account_id").agg(F.max_by(F.struct("d", "balance_c"), by).alias("x")).select("account_id", "x.*")
    if q.intent == "by_month" and q.extreme:
        months = rows.groupBy("account_id", "ym").agg(F.sum(amount).alias("month_c"), F.count("*").alias("n"))
        order = F.col("month_c") if q.extreme == "min" else -F.col("month_c")
        best = months.groupBy("account_id").agg(F.min_by(F.struct("ym", "month_c", "n"), F.struct(order.alias("o"), "ym")).alias("m")).select("account_id", "m.*")
        return rows.join(best, ["account_id", "ym"]).withColumn("rank", ranked(amount)).where("rank <= 3").select("account_id", "ym", "month_c", "n", "rank", "seq", amount.alias("amount_c"))
    if q.intent == "by_month":
        return rows.groupBy("account_id", "ym").agg(F.sum(amount).alias("amount_c"), F.count("*").alias("n"))
    if q.intent == "profile":
        return rows.groupBy("account_id").agg(F.count("*").alias("n"), F.count_if(F.col("credit_c") > 0).alias("credits"), F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c"), F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.min(amount).alias("least_c"), F.max(amount).alias("most_c"))
    if q.intent in ("count", "average", "total"):
        return rows.groupBy("account_id").agg(F.count("*").alias("n"), F.sum(amount).alias("total_c"), F.round(F.sum(amount) / F.count("*")).cast("long").alias("average_c"))
    # The n best of each account come from an aggregation that keeps n rows per key on the map side.
    sign = -1 if q.intent == "min" else 1
    by = ranked(amount * sign if q.intent != "list" else -F.col("seq"))
    return rows.withColumn("rank", by).where(F.col("rank") <= q.top_n).select("account_id", "rank", "seq", "d", "description", amount.alias("amount_c"))


def ranked(value: Column) -> Column:
    return F.row_number().over(Window.partitionBy("account_id").orderBy(value.desc(), "seq")).cast("long")


def capability(ledger: DataFrame) -> DataFrame:
    """What can be asked about: rows, totals and period of each account."""
    return ledger.groupBy("account_id").agg(F.count("*").alias("n"), F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


SMALL_TALK = frozenset(("hi", "hello", "hey", "thanks", "thank", "bye"))
REFUSED = ("ignore previous", "system prompt", "approve the loan", "change the score", "delete")


def route(text: str) -> str:
    """Where a question goes: small_talk, refusal, ledger or capability. A refusal comes before anything that
    would read rows."""
    low = text.lower().strip()
    words = re.findall(r"[a-z]+", low)
    if words and len(words) <= 3 and all(w in SMALL_TALK or w in ("there", "you") for w in words):
        return "small_talk"
    if any(r in low for r in REFUSED):
        return "refusal"
    q = parse(low)
    return "ledger" if q.tokens or q.subject or q.months or q.years or q.direction or q.intent not in ("list",) else "capability"

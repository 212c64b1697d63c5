"""The multi-pattern dictionary against keyword by keyword regular expressions."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.operators import dictionary
from pyspark.sql import functions as F


def stands(d, entry, text):
    kw = entry[0].strip()
    if not kw:
        return False
    up = text.upper()
    if any(x.upper() in up for x in d.excluded.get(kw.upper(), ())):
        return False
    need = d.required.get(kw.upper())
    if need and not any(x in up for x in need):
        return False
    left, right = r"(?<![A-Za-z0-9])" if kw[0].isalnum() else "", r"(?![A-Za-z0-9])" if kw[-1].isalnum() else ""
    if re.search(left + re.escape(kw) + right, text, re.I | re.A):
        return True
    return " " in kw and bool(re.search(r"(?<![A-Za-z0-9])" + re.escape(kw.replace(" ", "")), re.sub(r"[\s\-_.]", "", text), re.I | re.A))


def plain(d, text):
    out, seen = [], set()
    for i in sorted(range(len(d.entries)), key=lambda i: (-len(d.entries[i][0]), i)):
        if d.entries[i][1] not in seen and stands(d, d.entries[i], text):
            seen.add(d.entries[i][1])
            out.append(i)
    return out


_WORDS = ["A", "AB", "ABC", "A B", "B C", "BAB", "C-B", "B/", "AB C A", "CA"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(_WORDS), st.sampled_from(["Expense", "Income", "Banking"])), min_size=1, max_size=8), st.lists(st.text("abcABC -/._1", max_size=20), min_size=1, max_size=6), st.booleans())
def test_any_dictionary(entries, texts, guarded):
    guards = ({"AB": ["CA"], "A B": ["/"]}, {"ABC": ["B/", "1"], "A": ["C"]}) if guarded else ({}, {})
    d = dictionary.Dictionary([(k, c, "s", "Need") for k, c in entries], *guards)
    assert d.best(texts) == [plain(d, t) for t in texts]


def test_fifty_thousand_keywords(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randrange(3, 9)))
    entries = [(" ".join(word() for _ in range(rng.randrange(1, 3))), rng.choice(["Expense", "Income", "Investment"]), f"s{i % 40}", "Want") for i in range(50_000)]
    d = dictionary.Dictionary(entries)
    texts = []
    for i in range(4000):
        k = rng.choice(entries)[0] if i % 2 else word()
        texts.append(f"UPI/{i}/{k.replace(' ', '') + '@ybl' if i % 7 == 0 else k.lower()}/{word()} {'x' if i % 11 == 0 else ''}{rng.choice(entries)[0]}")
    df = spark.createDataFrame([(i, t, i % 3 * 100, i % 2 * 50) for i, t in enumerate(texts)] + [(9999, None, 1, 0)], "id long, t string, debit_c int, credit_c int")
    got = df.withColumn("m", dictionary.matches(spark, d, F.col("t"))).withColumn("k", dictionary.allowed(F.col("m"), F.col("debit_c"), F.col("credit_c")))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.id: r for r in got.collect()}
    assert rows[9999].m == [] and rows[9999].k is None
    few = rng.sample(range(4000), 60)
    sample = {i: d.entries[i] for i in rng.sample(range(50_000), 400)}
    for i in few:
        said = {m.k_category: m.keyword for m in rows[i].m}
        assert said == {d.entries[e][1]: d.entries[e][0] for e in [*plain_few(d, texts[i])]}
        assert not any(stands(d, e, texts[i]) and len(e[0]) > len(said.get(e[1], "")) for e in sample.values())
    assert sum(bool(r.m) for r in rows.values()) > 3000


def plain_few(d, text):
    """As plain, over keywords whose letters stand in the text at all."""
    up = text.upper() + re.sub(r"[\s\-_.]", "", text).upper()
    near = [i for i, e in enumerate(d.entries) if e[0].strip().upper() in up or e[0].replace(" ", "").upper() in up]
    out, seen = [], set()
    for i in sorted(near, key=lambda i: (-len(d.entries[i][0]), i)):
        if d.entries[i][1] not in seen and stands(d, d.entries[i], text):
            seen.add(d.entries[i][1])
            out.append(i)
    return out


def test_truncated(spark):
    d = dictionary.Dictionary([("GOOGLE INDIA", "Expense", "Apps", "Want"), ("GOOGLE INDIA PRIVATE", "Expense", "Apps", "Want"), ("V V TRADERS", "Expense", "Shop", "Want")])
    df = spark.createDataFrame([("Google I",), ("v v trade",), ("Goog",), (None,), ("V V TRADERS X",)], "v string")
    got = [r.k.keyword if r.k else None for r in df.select(dictionary.truncated_match(spark, d, F.col("v")).alias("k")).collect()]
    assert got == ["GOOGLE INDIA PRIVATE", "V V TRADERS", None, None, None]


def test_too_large(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="too many"):
        dictionary.Dictionary([("ABCDEF", "Expense", "s", "Want")])
    monkeypatch.setattr(dictionary, "MOST_ENTRIES", 3)
    with pytest.raises(ValueError, match="at most"):
        dictionary.of_table(spark.range(5).selectExpr("cast(id as string) keyword", "'a' category", "'b' subcategory", "'c' label", "id ord"))

"""Similar names against all pairs, and scores against plain dynamic programming."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.operators import fuzzy
from ledgerloom.plans import registry
from pyspark.sql import functions as F


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd ", max_size=30), st.text("abcd ", max_size=30))
def test_common(a, b):
    assert fuzzy.common(a, b) == plain_common(a, b)


def test_scores():
    s = lambda a, b: fuzzy.score(fuzzy.words(a), fuzzy.words(b))
    assert s("UPI/402/ZOMATO LTD/zomato@ybl", "Zomato") == 100.0 and s("", "x") == 0.0 and s("abc", "abc") == 100.0
    assert abs(s("fuzzy was a bear", "fuzzy fuzzy was a bear") - 100.0) < 1e-9
    assert abs(s("abcd", "abce") - 75.0) < 1e-9
    assert abs(s("red ring", "red rung") - max(100 - 100 * 2 / 16, 100 - 100 * 5 / 11)) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=14), min_size=1, max_size=12, unique=True), st.text("abc /", max_size=20), st.sampled_from([50.0, 70.0, 80.0, 95.0]))
def test_no_name_is_lost(names, text, least):
    index, ws = fuzzy.Index(names), fuzzy.words(text)
    scores = [fuzzy.score(ws, w) for w in index.words]
    best = max(scores)
    assert index.best(text, least) == ((scores.index(best), best) if best >= least else None)
    assert {i for i, s in enumerate(scores) if s >= least} <= index.candidates(ws, least)


def test_equals_all_pairs_on_the_tables(spark, sf_dir):
    """All distinct narrations against all names, at two thresholds; few names are scored."""
    texts = [r[0] for r in registry.ledger_items(spark, sf_dir).select("description").distinct().limit(800).collect()]
    rng = random.Random(3)
    names = sorted({r[0] for r in registry.read(spark, sf_dir, "part").select("p_name").distinct().collect()}) + [f"LENDER {i} FINANCE" for i in range(9)] + ["".join(rng.choice("abcdefghij ") for _ in range(14)) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    for least in (70.0, 85.0):
        got = {r.t: (r.m.name, r.m.score) if r.m else None for r in df.withColumn("m", fuzzy.best_name(spark, names, F.col("t"), F.lit(least))).collect()}
        index, scored = fuzzy.Index(names), 0
        for t in texts:
            ws = fuzzy.words(t)
            scores = [fuzzy.score(ws, w) for w in index.words]
            best = max(scores)
            assert got[t] == ((names[scores.index(best)], best) if best >= least else None)
            scored += len(index.candidates(ws, least))
        assert got[None] is None and got[""] is None and scored < 0.6 * len(texts) * len(names)


def test_thresholds(spark):
    df = spark.createDataFrame([("SBI", 80.0), ("Union", 90.0), ("Axis", 100.0), (None, 80.0)], "b string, s double")
    got = df.select(fuzzy.threshold(F.col("b"), {"Axis": 75}).alias("t"), "s").select("t", fuzzy.confidence(F.col("s"), F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(80.0, 0.7), (70.0, 0.85), (75.0, 0.85), (80.0, 0.7)]

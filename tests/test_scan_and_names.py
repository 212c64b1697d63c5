"""Segmented scans against plain windows on an account with a third of all rows, and families of names."""

import random
from datetime import date, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerloom.operators import engines, joins, names, scan, timeline
from ledgerloom.plans import registry
from pyspark.sql import Window
from pyspark.sql import functions as F

A = "account_id"


def hot_ledger(spark, n=6000):
    """A third of n rows in account 0, with gaps in days, nulls and a balance."""
    rng = random.Random(1)
    rows, seq, balance, day = [], {}, {}, {}
    for i in range(n):
        a = 0 if i % 3 == 0 else rng.randrange(1, 300)
        seq[a], day[a] = seq.get(a, 0) + 1, day.get(a, date(2020, 1, 1)) + timedelta(days=rng.choice((0, 0, 0, 1, 4)) if a else rng.random() < 0.4)
        x = rng.randrange(1, 10**6) * rng.choice((1, -1))
        balance[a] = balance.get(a, 0) + x
        rows.append((a, seq[a], day[a], max(-x, 0), max(x, 0), balance[a] + 100 * (rng.random() < 0.05), None if rng.random() < 0.7 else f"v{i}", rng.random() < 0.02))
    return spark.createDataFrame(rows, f"{A} long, seq long, d date, debit_c long, credit_c long, balance_c long, note string, paid boolean")


def as_set(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_scans_equal_windows(spark):
    l = hot_ledger(spark)  # noqa: E741
    w = Window.partitionBy(A).orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = l.withColumns({"n": F.row_number().over(w).cast("long"), "s": F.sum("credit_c").over(upto), "k": F.last("note", True).over(upto), "p": F.lag("note").over(w)})
    for piece in (scan.by_number("seq", 100), scan.by_number("seq", 1), F.col("d")):
        got = scan.scanned(l, piece, ["seq"], {"n": F.lit(1).cast("long"), "s": F.col("credit_c")}, {"k": F.col("note")}, {"p": F.col("note")})
        assert as_set(got) == as_set(plain)
    assert scan.scanned(l.limit(0), F.col("d"), ["seq"], {"n": F.lit(1)}).count() == 0


def test_timeline_on_a_hot_account(spark):
    l = hot_ledger(spark)  # noqa: E741
    w = Window.partitionBy(A).orderBy("seq")
    off = l.withColumn("off_c", F.col("balance_c") - (F.lag("balance_c").over(w) - F.col("debit_c") + F.col("credit_c"))).where("abs(off_c) > 50")
    assert as_set(timeline.chain_mismatches(l, size=64)) == as_set(off) and off.count() > 100
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    assert as_set(timeline.carry_forward(l, "note", size=64).select(*l.columns)) == as_set(l.withColumn("note", F.last("note", True).over(upto)).select(*l.columns))
    by_d = Window.partitionBy(A).orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    assert as_set(timeline.as_of(l, F.col("paid"))) == as_set(l.withColumn("anchor_d", F.max(F.when(F.col("paid"), F.col("d"))).over(by_d)))
    assert joins.salary_phase(l, F.col("paid")).agg(F.sum("n")).first()[0] == l.count()
    run = l.withColumn("spent", F.sum("debit_c").over(upto)).withColumn("income", F.sum("credit_c").over(Window.partitionBy(A)))
    want = {r[0]: r[1] for r in run.groupBy(A).agg(F.greatest(F.coalesce(F.datediff(F.min(F.when((F.col("income") > 0) & (F.col("spent") * 10 >= F.col("income") * 8), F.col("d"))), F.min("d")), F.lit(25)), F.lit(1))).collect()}
    assert {r[0]: r[1] for r in timeline.exhaustion_day(l).collect()} == want
    assert engines.opening_closing(l).count() == l.select(A).distinct().count()


def test_a_hot_account_is_many_tasks(spark):
    """No task has more than twice the rows of the median one, with a third of all rows in one account."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = scan.scanned(hot_ledger(spark, 20_000), scan.by_number("seq", 256), ["seq"], {"s": F.col("credit_c")})
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_ledgers_with_pieces_equal_plain_ones(spark, sf_dir):
    for plain, pieces in ((registry.ledger_items(spark, sf_dir), registry.ledger_items(spark, sf_dir, pieces=True)), (registry.ledger_events(spark, sf_dir), registry.ledger_events(spark, sf_dir, pieces=True))):
        assert pieces.dtypes == plain.dtypes and pieces.exceptAll(plain).count() == plain.exceptAll(pieces).count() == 0


def greedy(keys):
    kept = {}
    flat = lambda k: k.split("|")[0].replace(" ", "")
    for k in sorted(set(keys), key=lambda k: (-len(k), k)):
        x = flat(k)
        kept[k] = next((e for e in kept.values() if flat(e) == x or (min(len(flat(e)), len(x)) >= 6 and (flat(e).startswith(x) or x.startswith(flat(e))))), k)
    return kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["AAAAAA", "AAAAAB", "AAA"]), st.text("AB ", max_size=7), st.sampled_from(["", "|BANK", "|X", "|LONG BANK NAME"])), min_size=1, max_size=25))
def test_canonical_is_the_greedy_rule(parts):
    keys = sorted({"".join(p) for p in parts})
    families = {}
    for k in keys:
        f = k.split("|")[0].replace(" ", "")
        root = next((r for r in families if len(r) >= 6 and f.startswith(r)), None)
        families.setdefault(root or f, [])
    flats = sorted({k.split("|")[0].replace(" ", "") for k in keys})
    roots = [f for i, f in enumerate(flats) if names.open_prefixes(flats)[i] < 0]
    got = {}
    for r in roots:
        own = [(k, f) for k in keys for f in [k.split("|")[0].replace(" ", "")] if f == r or (len(r) >= 6 and f.startswith(r))]
        got.update(zip([k for k, _ in own], names.canonical(own), strict=True))
    assert got == greedy(keys)


def test_canonical_keys(spark):
    rng = random.Random(2)
    rows = []
    for a in range(5):
        for _ in range(200):
            base = "".join(rng.choice("AB") for _ in range(rng.randrange(2, 12)))
            rows.append((a, (base[:3] + " " + base[3:]) + rng.choice(["", "", "|BANK"])))
    rows += [(9, None), (9, ""), (9, "ONE NAME"), (9, "ONE NAME")]
    got = {}
    for r in names.canonical_keys(spark.createDataFrame(rows, f"{A} long, key string")).collect():
        got.setdefault(r[0], {})[r.key] = r.canonical
    assert got == {a: greedy([k for b, k in rows if b == a and k]) for a in (0, 1, 2, 3, 4, 9)}


def test_a_block_of_many_keys(spark):
    """100,000 keys that share their first letters, nested and apart."""
    import time

    df = spark.range(100_000).select(F.lit(1).alias(A), F.concat(F.lit("SUPPLIER"), F.lpad(F.hex("id"), 6, "0"), F.when(F.col("id") % 3 == 0, "EXTRA").otherwise("")).alias("key"))
    df = df.union(df.where("id % 5 = 0" if "id" in df.columns else "length(key) = 14").select(A, F.expr("substring(key, 1, 13)")))
    began = time.perf_counter()
    assert names.canonical_keys(df).count() == df.distinct().count()
    assert time.perf_counter() - began < 60


def test_matching_keys(spark):
    left, right = ["ABCDEFGH", "ABCDEF", "ABC", "XYZXYZ 1"], ["ABCDEFG|B", "ABC", "ABCD", "XYZ XYZ12", "ABCDEFGH"]
    make = lambda ks: spark.createDataFrame([(1, k) for k in ks], f"{A} long, key string")
    got = {(r.key, r.other) for r in names.matching_keys(make(left), make(right)).collect()}
    assert got == {("ABCDEFGH", "ABCDEFG|B"), ("ABCDEFGH", "ABCDEFGH"), ("ABCDEF", "ABCDEFG|B"), ("ABCDEF", "ABCDEFGH"), ("ABC", "ABC"), ("XYZXYZ 1", "XYZ XYZ12")}


def test_missing_ranges(spark):
    df = spark.createDataFrame([(1, 3), (1, 4), (1, 9), (1, 10**12), (2, 5)], f"{A} long, n long")
    assert {tuple(r) for r in joins.missing_ranges(df, "n").collect()} == {(1, 5, 8), (1, 10, 10**12 - 1)}

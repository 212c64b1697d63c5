"""Placings whose parts don't grow with the tables, and counts of pairs that are never made."""

from datetime import date

from ledgerloom.operators import joins, spec
from ledgerloom.plans import catalog
from ledgerloom.sources import tables
from pyspark.sql import functions as F

from test_stretches import plan


def test_parts_follow_the_files(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") % 7)
    size = tables.file_bytes(rows)
    assert size > 50_000 and tables.parts(rows) == 4 and tables.parts(rows, size // 20) in (20, 21)
    assert tables.placed(rows, "k", share=size // 20).rdd.getNumPartitions() in (20, 21)


def test_tasks_stay_small(spark, sf_dir, monkeypatch):
    """With more files than a share, every placing of these queries has more parts than the session's."""
    monkeypatch.setattr(tables, "SMALL", 0)
    monkeypatch.setattr(tables.parts, "__defaults__", (1 << 14,))
    for name in ("w14_day_clusters", "u1_union_promoted", "u4_only_credit"):
        df = catalog.QUERIES[name](spark, sf_dir)
        text = df._jdf.queryExecution().executedPlan().toString()
        most = max(int(x.split(")")[0].split(", ")[-1]) for x in text.split("hashpartitioning(")[1:])
        assert most > 4, name
        assert df.count() > 0


def test_surplus_is_except_all(spark):
    rows = [(1, "a", 5, 0), (1, "a", 5, 0), (1, "a", 0, 5), (1, "b", 0, 5), (2, None, 5, 0), (2, "c", 5, 0), (2, "c", 0, 1), (None, "d", 1, 0)]
    df = spark.createDataFrame(rows, "account_id long, counterparty string, credit_c long, debit_c long")
    got = sorted(map(str, joins.surplus(df, ["account_id", "counterparty"], F.col("credit_c") > 0, F.col("debit_c") > 0).collect()))
    side = lambda c: df.where(f"{c} > 0").select("account_id", "counterparty")
    want = side("credit_c").exceptAll(side("debit_c")).groupBy("account_id", "counterparty").agg(F.count("*").alias("copies"))
    assert got == sorted(map(str, want.collect())) and len(got) == 3


def test_pairs_are_counted_without_a_join(spark):
    rows = [(a, s, date(2024, 1, 1 + (a + s) % 4), *((0, x) if (a * s) % 3 else (x, 0))) for a in (1, 2, 3) for s in range(30) for x in (s % 3,)]
    rows += [(None, 1, date(2024, 1, 1), 1, 0), (1, 99, None, 1, 0), (2, 98, date(2024, 1, 2), 1, 1)]
    df = spark.createDataFrame(rows, "account_id long, seq long, d date, debit_c long, credit_c long")
    counts = spec.inter_account_counts(df)
    want = spec.inter_account(df).groupBy("amount_c").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect())) and counts.count() == 2
    assert "Join" not in plan(counts)

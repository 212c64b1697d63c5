"""Account states of a stream, with late rows, against the same rows in order."""

import random
from datetime import datetime, timedelta, timezone

from ledgerloom.streaming import accounts
from pyspark.sql import functions as F

SCHEMA = "account_id long, ts timestamp, seq long, moved_c long"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows):
    out = {}
    for a, ts, _, x in sorted(rows, key=lambda r: (r[1], r[2])):
        s = out.setdefault(a, {"n": 0, "b": 0, "last": None, "gap": 0, "bursts": 0, "all": []})
        if s["last"]:
            s["gap"] = max(s["gap"], (ts.date() - s["last"].date()).days)
        s["bursts"] += sum(ts - t <= timedelta(days=7) for t in s["all"]) >= 2
        s["all"].append(ts)
        s["n"], s["b"], s["last"] = s["n"] + 1, s["b"] + x, ts
    return {a: (s["n"], s["b"], s["gap"], s["bursts"]) for a, s in out.items()}


def test_late_rows_change_nothing(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(6), START + timedelta(hours=rng.randrange(24 * 90), minutes=rng.randrange(60)), i, rng.randrange(-500, 500)) for i in range(300)]
    last = START + timedelta(days=400)
    # Files in order of time, but each row up to a day late; rows far in the future let the watermark pass all others.
    order = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.randrange(24)))
    parts = [order[i : i + 60] for i in range(0, 300, 60)] + [[(99, last, 999, 1)], [(99, last + timedelta(days=3), 1000, 1)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/p{i:02d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {r.account_id: (r.n, r.balance_c, r.longest_gap, r.bursts) for r in accounts.run_once(spark, stream, "2 days").collect()}
    want = plain(rows)
    assert {a: s for a, s in got.items() if a != 99} == want and got[99] == (2, 2, 3, 0)


def test_query_on_events(spark, sf_dir):
    from ledgerloom.plans import catalog

    got = catalog.QUERIES["st1_account_states"](spark, sf_dir)
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()

"""Balances as stretches of days: no day is shuffled, and sums over stretches are sums over days."""

import math
import random
import statistics
from datetime import date, timedelta

from ledgerloom.operators import engines, timeline

SCHEMA = "account_id long, seq long, d date, balance_c long"


def planted():
    rng = random.Random(5)
    rows = []
    for account in range(1, 13):
        d = date(2019, 12, 1) + timedelta(rng.randrange(60))
        for seq in range(rng.randrange(1, 40)):
            rows.append((account, seq, d, rng.randrange(-50_000, 400_000)))
            d += timedelta(rng.choice((0, 0, 1, 3, 40, 200)))
    return rows


def by_day(rows):
    out = {}
    for account in {r[0] for r in rows}:
        last = {d: b for a, _, d, b in rows if a == account}
        days, d, b = [], min(last), None
        while d <= max(last):
            b = last.get(d, b)
            days.append((d, b))
            d += timedelta(1)
        out[account] = days
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_balance_and_its_summary(spark):
    rows = planted()
    df, days = spark.createDataFrame(rows, SCHEMA), by_day(rows)
    daily = timeline.daily_balance(df)
    got = {}
    for r in daily.collect():
        got.setdefault(r.account_id, []).append((r.d, r.balance_c))
    assert {a: sorted(x) for a, x in got.items()} == days
    for r in engines.balance_summary(timeline.stretches(df), 10_000).collect():
        b = [x for _, x in days[r.account_id]]
        marked = [x for d, x in days[r.account_id] if d.day in (1, 14, 28, 29, 30, 31)]
        assert (r.days, r.sum_c, r.median_c, r.min_c, r.max_c) == (len(b), sum(b), statistics.median(b), min(b), max(b))
        assert (r.negative_days, r.low_days, r.abb_sum_c, r.abb_days) == (sum(x < 0 for x in b), sum(x < 10_000 for x in b), sum(marked) if marked else None, len(marked))
        mean = sum(b) / len(b)
        want = 1.0 if mean <= 0 else min(max((statistics.stdev(b) if len(b) > 1 else 0.0) / mean, 0.0), 1.0)
        assert math.isclose(r.volatility, want, abs_tol=6e-5)


def test_days_are_not_joined(spark):
    assert "Join" not in plan(timeline.daily_balance(spark.createDataFrame(planted(), SCHEMA)))

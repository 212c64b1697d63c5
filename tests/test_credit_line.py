"""Use of an overdraft over stretches of days."""

import math

from ledgerloom.operators import spec, timeline

from test_stretches import SCHEMA, by_day, planted


def test_credit_line_counts_days(spark):
    rows = planted()
    days, limit = by_day(rows), 20_000
    limits = spark.createDataFrame([(a, limit) for a in days], "account_id long, limit_c long")
    for r in spec.credit_line_use(timeline.stretches(spark.createDataFrame(rows, SCHEMA)), limits).collect():
        used = [max(0, -x) for _, x in days[r.account_id]]
        assert r.overdrawn_days == sum(x > limit for x in used) and math.isclose(r.mean_pct, 100 * sum(used) / len(used) / limit, abs_tol=6e-3)

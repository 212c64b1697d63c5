"""Transfers matched one to one."""

from datetime import date

from ledgerloom.operators import transfers


def table(spark, rows):
    return spark.createDataFrame([(o, a, s, date(2024, 1, d), x, y) for o, a, s, d, x, y in rows], "owner long, account_id long, seq long, d date, debit_c long, credit_c long")


def pairs(spark, rows):
    return {((r.from_account, r.out_seq), (r.to_account, r.in_seq)) for r in transfers.match(table(spark, rows)).collect()}


def test_each_row_is_used_once(spark):
    rows = [(1, 1, 1, 5, 100, 0), (1, 1, 2, 5, 100, 0), (1, 2, 1, 5, 0, 100), (1, 3, 1, 6, 0, 100), (1, 3, 2, 4, 0, 100), (1, 2, 9, 8, 0, 100)]
    assert pairs(spark, rows) == {((1, 1), (2, 1)), ((1, 2), (3, 1))}


def test_owners_accounts_and_days(spark):
    rows = [(1, 1, 1, 5, 100, 0), (2, 2, 1, 5, 0, 100), (1, 1, 2, 5, 0, 100), (1, 4, 1, 7, 0, 100), (3, 5, 1, 5, 70, 0), (3, 6, 1, 4, 0, 70), (None, 7, 1, 5, 9, 0), (None, 8, 1, 5, 0, 9), (4, 9, 1, 5, 0, 0)]
    assert pairs(spark, rows) == {((5, 1), (6, 1))}


def test_a_common_amount_stays_linear(spark):
    rows = [(1, i % 50, i, 1 + i % 3, 500, 0) for i in range(600)] + [(1, 100 + i % 50, i, 1 + i % 3, 0, 500) for i in range(600)]
    df = table(spark, rows)
    found = transfers.match(df)
    assert found.count() == 600 and found.select("from_account", "out_seq").distinct().count() == 600 == found.select("to_account", "in_seq").distinct().count()
    assert transfers.consolidated(df, found).count() == 0 and transfers.velocity(df, found).first().transfers == 600
    assert transfers.match(df.limit(0)).count() == 0


def test_one_placing_gives_what_the_rules_say(spark):
    """Random rows near the bounds of blocks against the rules in Python; all of it stands on one exchange."""
    import random

    rnd = random.Random(5)
    rows = [(1, rnd.randrange(4), i, rnd.randrange(1, 29), *rnd.choice([(7, 0), (0, 7), (0, 7), (9, 0), (0, 9)])) for i in range(400)]
    left, want = list(rows), set()
    for offset in transfers.OFFSETS:
        sides = {}
        for r in left:
            out = r[4] > 0
            sides.setdefault((r[4] + r[5], r[3] + offset * out), {True: [], False: []})[out].append(r)
        for s in sides.values():
            for x, y in zip(sorted(s[True], key=lambda r: (r[1], r[2])), sorted(s[False], key=lambda r: (-r[1], r[2]))):
                if x[1] != y[1]:
                    want.add(((x[1], x[2]), (y[1], y[2])))
        used = {k for p in want for k in p}
        left = [r for r in left if (r[1], r[2]) not in used]
    df = table(spark, rows)
    for size in (1, 3, 64):
        marks = transfers.marked(df, size=size)
        assert {((r.account_id, r.seq), (r.to_account, r.in_seq)) for r in marks.where("used and is_out").collect()} == want
        assert marks.count() == 400 and marks.where("used").count() == 2 * len(want)
    kept = [tuple(r) for r in transfers.months(marks.where("not used")).collect()]
    assert kept == [tuple(r) for r in transfers.consolidated(df, transfers.match(df)).collect()] and tuple(transfers.marked_velocity(marks).first()) == tuple(transfers.velocity(df, transfers.match(df)).first())
    text = marks._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text

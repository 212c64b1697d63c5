"""Repeating payments: cadence, piecewise constant amounts, revisions, missed payments.

Amounts are whole cents and medians are kept doubled, so every comparison is of whole numbers."""

from __future__ import annotations

from bisect import insort
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import clamp
from ledgerloom.operators.streams import walk_groups

A = "account_id"
#: An amount belongs to a run within 50.00 or 5 percent of its median; a run of fewer payments than
#: MIN_RUN is folded; a fixed amount has MAX_RUNS runs at most; a revision is a shift of 1 percent between sides
#: that are each within 1 percent.
FLOOR_C, PERCENT, MIN_RUN, MAX_RUNS, SHIFT_PERCENT = 5_000, 5, 2, 3, 1


def _twice_median(ordered: list[int]) -> int:
    n = len(ordered)
    return ordered[(n - 1) // 2] + ordered[n // 2]


def segment(amounts: list[int]) -> list[list[int]]:
    """Runs of near-constant amounts, each sorted: an amount opens a new run where it is further than the tolerance
    from the median of the run so far. Short runs go to the run before them, unless most runs are short."""
    runs: list[list[int]] = []
    for v in amounts:
        middle = _twice_median(runs[-1]) if runs else 0
        if runs and abs(2 * v - middle) * 100 <= max(200 * FLOOR_C, PERCENT * middle):
            insort(runs[-1], v)
        else:
            runs.append([v])
    if 2 * sum(len(r) < MIN_RUN for r in runs) > len(runs):
        return runs
    folded: list[list[int]] = []
    for r in runs:
        if folded and len(r) < MIN_RUN:
            for v in r:
                insort(folded[-1], v)
        else:
            folded.append(r)
    return folded


def consistent(run: list[int]) -> bool:
    return (run[-1] - run[0]) * 200 <= max(200 * FLOOR_C, PERCENT * _twice_median(run))


def level_shift(amounts: list[int]) -> tuple[int, int] | None:
    """The doubled medians on both sides of the first lasting change of level; None where there is none."""
    n = len(amounts)
    if n < 4:
        return None

    def sides(values: list[int]) -> list[tuple[bool, int]]:
        """Whether the first k values are tight, and their doubled median, for each k."""
        ordered: list[int] = []
        out = []
        for v in values:
            insort(ordered, v)
            middle = _twice_median(ordered)
            out.append((middle > 0 and (ordered[-1] - ordered[0]) * 200 <= SHIFT_PERCENT * middle, middle))
        return out

    left, right = sides(amounts), sides(amounts[::-1])[::-1]
    for cut in range(2, n - 1):
        (tight, low), (also, high) = left[cut - 1], right[cut]
        if tight and also and abs(high - low) * 100 >= SHIFT_PERCENT * low:
            return low, high
    return None


def constant_runs(rows: DataFrame, amount: str = "debit_c", key: str = "counterparty") -> DataFrame:
    """(account_id, key, run, n, total_c, low_c, high_c): the runs of each group's amounts, as in `segment`."""
    own = rows.where(F.col(amount) > 0).select(A, key, F.unix_date("d").alias("day"), F.col("seq").cast("long").alias("seq"), F.col(amount).alias("v"))
    runs = lambda held: ((i, len(r), sum(r), r[0], r[-1]) for i, r in enumerate(segment([x[2] for x in held])))
    return walk_groups(own, [A, key], ["day", "seq"], runs, {"run": "int", "n": "long", "total_c": "long", "low_c": "long", "high_c": "long"})


def level_shifts(rows: DataFrame, amount: str = "debit_c", key: str = "counterparty") -> DataFrame:
    """(account_id, key, from_c, to_c) of the groups with a lasting change of level."""
    own = rows.where(F.col(amount) > 0).select(A, key, F.unix_date("d").alias("day"), F.col("seq").cast("long").alias("seq"), F.col(amount).alias("v"))

    def shift(held: list[tuple]) -> list[tuple]:
        found = level_shift([x[2] for x in held])
        return [(found[0] / 2, found[1] / 2)] if found else []

    return walk_groups(own, [A, key], ["day", "seq"], shift, {"from_c": "double", "to_c": "double"})


def cadence_of(gap: Column) -> Column:
    """Fixed bounds of days."""
    return F.when(gap.between(5, 9), "WEEKLY").when(gap.between(25, 35), "MONTHLY").when(gap.between(80, 100), "QUARTERLY").otherwise("IRREGULAR")


def recurring_groups(rows: DataFrame, amount: str, key: str = "counterparty", least: int = 3) -> DataFrame:
    """Groups of `least` or more payments (two at least) with cadence (by the median gap), runs of constant amount,
    whether the amount is fixed (few runs, each consistent), a revision of a fixed amount, expected and missed
    payments, regularity and confidence. Rows without a key are left out."""
    own = rows.where((F.col(amount) > 0) & (F.trim(key) != "")).select(A, key, F.unix_date("d").alias("day"), F.col("seq").cast("long").alias("seq"), F.col(amount).alias("v"))

    def describe(held: list[tuple]) -> list[tuple]:
        n = len(held)
        if n < max(least, 2):
            return []
        days, amounts = [x[0] for x in held], [x[2] for x in held]
        runs = segment(amounts)
        fixed = len(runs) <= MAX_RUNS and all(map(consistent, runs))
        step = level_shift(amounts) if fixed else None
        gap = _twice_median(sorted(b - a for a, b in zip(days, days[1:], strict=False))) / 2
        low, high = (step[0] / 2, step[1] / 2) if step else (None, None)
        return [(n, list(accumulate(amounts))[-1], _twice_median(sorted(amounts)) / 2, gap, days[-1] - days[0], len(runs), fixed, low, high)]

    g = walk_groups(own, [A, key], ["day", "seq"], describe, {"n": "long", "total_c": "long", "median_c": "double", "gap": "double", "span": "int", "runs": "long", "fixed": "boolean", "from_c": "double", "to_c": "double"})
    g = g.withColumn("cadence", cadence_of(F.col("gap")))
    per = F.when(F.col("cadence") == "MONTHLY", F.lit(30.0)).otherwise(F.col("gap"))
    expected = F.greatest(F.when((F.col("span") > 0) & (per > 0), F.bround(F.col("span") / per).cast("long") + 1).otherwise(F.col("n")), F.col("n"))
    g = g.withColumn("expected", expected).withColumn("missed", F.col("expected") - F.col("n")).withColumn("regularity", F.round(F.col("n") * 100.0 / F.col("expected") + 1e-9, 2))
    sure = (F.least(F.lit(1.0), 0.35 + 0.08 * F.col("n")) + F.when(F.col("fixed"), 0.15).otherwise(0.0) + F.when(F.col("cadence") != "IRREGULAR", 0.10).otherwise(0.0)) * F.col("regularity") / 100.0
    return g.withColumn("confidence", F.round(clamp(sure, 0, 0.95) + 1e-9, 2)).drop("span")


def summary(groups: DataFrame) -> DataFrame:
    """What an account's groups come to."""
    return groups.groupBy(A).agg(F.count("*").alias("groups"), F.count_if("fixed").alias("fixed_groups"), F.count_if(F.col("cadence") != "IRREGULAR").alias("cadenced"), F.count_if(F.col("from_c").isNotNull()).alias("revised"), F.sum("missed").alias("missed"), F.sum("total_c").alias("total_c"))

"""Queries of repeating payments and loans, over the ledger and over planted series that meet the default bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import classify, debt, engines, fraud, labels, recurrence
from ledgerloom.plans.registry import CLASSIFIED_SQL, add
from ledgerloom.sources.tables import LEDGER_SQL, ledger_items, read

#: Twelve months of payments for each customer, of six kinds by its key: constant, revised by two percent, with an
#: outlier, with two months missing, of changing amounts, and drifting by three percent of the first.
PLANTED_SQL = """pl as (select account_id, seq, d, strftime(d, '%Y-%m') as ym, 'ACH/PLANTED ' || kind || ' FINANCE/' || seq || '/EMI' as description, v as debit_c, 0::bigint as credit_c, 'PLANTED ' || kind as counterparty from (
select c_custkey as account_id, i as seq, c_custkey % 6 as kind, (date '1997-01-05' + to_months(i::int))::date as d, (b * case c_custkey % 6 when 1 then case when i >= 6 then 102 else 100 end when 2 then case when i = 4 then 300 else 100 end when 4 then 100 + 90 * (i * 7 % 5) when 5 then 100 + 3 * i else 100 end) // 100 as v
from (select c_custkey, 250000 + c_custkey * 100 as b, unnest(range(0, 12)) as i from customer) where not (c_custkey % 6 = 3 and i in (3, 4))))"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    kind, i, base = F.col("account_id") % 6, F.col("i"), F.lit(250_000) + F.col("account_id") * 100
    share = F.when(kind == 1, F.when(i >= 6, 102).otherwise(100)).when(kind == 2, F.when(i == 4, 300).otherwise(100)).when(kind == 4, 100 + 90 * (i * 7 % 5)).when(kind == 5, 100 + 3 * i).otherwise(100)
    rows = c.where(~((kind == 3) & i.isin(3, 4))).select("account_id", i.cast("long").alias("seq"), kind.alias("kind"), F.add_months(F.lit("1997-01-05").cast("date"), i).alias("d"), F.floor(base * share / 100).cast("long").alias("debit_c"))
    name = F.concat(F.lit("PLANTED "), F.col("kind").cast("string"))
    return rows.select("account_id", "seq", "d", F.date_format("d", "yyyy-MM").alias("ym"), F.concat(F.lit("ACH/"), name, F.lit(" FINANCE/"), F.col("seq").cast("string"), F.lit("/EMI")).alias("description"), "debit_c", F.lit(0).cast("long").alias("credit_c"), name.alias("counterparty"))


_M2 = "(list_sort({0})[(len({0}) + 1) // 2] + list_sort({0})[len({0}) // 2 + 1])"


def _tight(x: str) -> str:
    return f"(({_M2.format(x)}) > 0 and (list_max({x}) - list_min({x})) * 200 <= {_M2.format(x)})"


def groups_sql(table: str, amount: str, key: str, least: int) -> str:
    """CTEs up to `rg`, the recurring groups of rows of `table`; needs `with recursive`."""
    left, right = "a[1:c]", "a[c+1:]"
    return f"""g0 as (select account_id, {key} as k, list(v order by d, seq) as a, list(d order by d, seq) as ds from (select account_id, {key}, d, seq, {amount} as v from {table} where {amount} > 0 and trim({key}) <> '') group by 1, 2 having count(*) >= {least}),
seg as (select account_id, k, 1 as i, a, [[a[1]]] as runs from g0 union all
select account_id, k, i + 1, a, case when abs(2 * a[i + 1] - m2) * 100 <= greatest(1000000, 5 * m2) then list_append(runs[:-2], list_append(runs[-1], a[i + 1])) else list_append(runs, [a[i + 1]]) end from (select *, {_M2.format('runs[-1]')} as m2 from seg where i < len(a))),
done as (select account_id, k, runs, 2 * len(list_filter(runs, lambda x: len(x) < 2)) > len(runs) as noisy from seg where i = len(a)),
part as (select account_id, k, sum((j = 1 or len(x) >= 2 or noisy)::int) over (partition by account_id, k order by j) as f, x from (select account_id, k, noisy, unnest(range(1, len(runs) + 1)) as j, unnest(runs) as x from done)),
fold as (select account_id, k, f, list_sort(flatten(list(x))) as x from part group by 1, 2, 3),
rs as (select account_id, k, count(*) as runs, count(*) <= 3 and bool_and((x[-1] - x[1]) * 200 <= greatest(1000000, 5 * {_M2.format('x')})) as fixed from fold group by 1, 2),
st as (select account_id, k, case when len(a) >= 4 then list_filter(range(2, len(a) - 1), lambda c: {_tight(left)} and {_tight(right)} and abs({_M2.format(right)} - {_M2.format(left)}) * 100 >= {_M2.format(left)})[1] end as c, a, ds from g0),
ga as (select st.account_id, st.k, fixed, runs, len(a) as n, list_sum(a)::bigint as total_c, {_M2.format('a')} / 2 as median_c, list_median(list_transform(range(1, len(ds)), lambda i: date_diff('day', ds[i], ds[i + 1])))::double as gap, date_diff('day', ds[1], ds[-1]) as span,
case when fixed then {_M2.format(left)} / 2 end as f0, case when fixed then {_M2.format(right)} / 2 end as f1, c from st join rs using (account_id, k)),
gb as (select *, case when gap between 5 and 9 then 'WEEKLY' when gap between 25 and 35 then 'MONTHLY' when gap between 80 and 100 then 'QUARTERLY' else 'IRREGULAR' end as cadence from ga),
gc as (select *, greatest(n, case when span > 0 and (cadence = 'MONTHLY' or gap > 0) then round_even(span / case when cadence = 'MONTHLY' then 30.0::double else gap end, 0)::bigint + 1 else n end) as expected from gb),
gd as (select *, expected - n as missed, round(n * 100.0::double / expected + 1e-9, 2) as regularity from gc),
rg as (select account_id, k as {key}, n, total_c, median_c, gap, runs, fixed, case when c is not null then f0 end as from_c, case when c is not null then f1 end as to_c, cadence, expected, missed, regularity,
round(greatest(0, least(0.95, (least(1.0::double, 0.35::double + 0.08::double * n) + case when fixed then 0.15::double else 0 end + case when cadence <> 'IRREGULAR' then 0.10::double else 0 end) * regularity / 100.0::double)) + 1e-9, 2) as confidence from gd)"""


def _on(name: str, rows: Callable[[SparkSession, str], DataFrame], op: Callable[[DataFrame], DataFrame], ctes: str, sql: str) -> None:
    add(name, lambda s, d: op(rows(s, d)), f"with recursive {ctes} {sql}")


_LEDGER = LEDGER_SQL + ", " + groups_sql("ledger", "debit_c", "counterparty", 3)
_PLANTED = PLANTED_SQL + ", " + groups_sql("pl", "debit_c", "counterparty", 3)
_slim = lambda s, d: ledger_items(s, d, narration=False, balance=False)
_GROUPS = "select account_id, counterparty, n, total_c, median_c, gap, runs, fixed, from_c, to_c, cadence, expected, missed, regularity, confidence from rg"
_on("a20_recurring_groups", _slim, lambda l: recurrence.recurring_groups(l, "debit_c"), _LEDGER, _GROUPS)
_on("a20b_recurring_planted", planted, lambda l: recurrence.recurring_groups(l, "debit_c"), _PLANTED, _GROUPS)
_SUMMARY = "select account_id, count(*) as groups, count(*) filter (where fixed) as fixed_groups, count(*) filter (where cadence <> 'IRREGULAR') as cadenced, count(from_c) as revised, sum(missed)::bigint as missed, sum(total_c)::bigint as total_c from rg group by 1"
_on("a21_recurrence_summary", planted, lambda l: recurrence.summary(recurrence.recurring_groups(l, "debit_c")), _PLANTED, _SUMMARY)
_on("w12_constant_runs", planted, recurrence.constant_runs, _PLANTED, "select account_id, k as counterparty, (f - 1)::int as run, len(x) as n, list_sum(x)::bigint as total_c, x[1] as low_c, x[-1] as high_c from (select account_id, k, dense_rank() over (partition by account_id, k order by f) as f, x from fold)")
_on("w13_level_shift", planted, recurrence.level_shifts, _PLANTED, f"select account_id, k as counterparty, {_M2.format('a[1:c]')} / 2 as from_c, {_M2.format('a[c+1:]')} / 2 as to_c from st where c is not null")
add("c31_recurring_labels", lambda s, d: (lambda c: labels.relabel_recurring(c, recurrence.recurring_groups(c, "debit_c", least=2)).groupBy("subcategory").agg(F.count("*").alias("n")))(classify.classify(ledger_items(s, d))),
    f"with recursive {CLASSIFIED_SQL}, {groups_sql('cl', 'debit_c', 'counterparty', 2)} select case when r.fixed and r.cadence <> 'IRREGULAR' and subcategory in ('Unknown', 'UPI Transfer', 'Bank Transfer') then 'Recurring Payment' else subcategory end as subcategory, count(*) as n from cl left join rg r using (account_id, counterparty) group by 1")

# Loans ---------------------------------------------------------------------------------------------------


def loan_sql(table: str, filter_: str) -> str:
    """CTEs up to `ln`, the loans of lender payments in `table` (with end dates of all its rows); recursive."""
    return f"""pay as (select account_id, string_split(description, '/')[2] as lender, d, seq, debit_c as v, row_number() over (partition by account_id, string_split(description, '/')[2] order by d, seq) as i from {table} where {filter_} and description like 'ACH/%' and debit_c > 0),
fac as (select account_id, lender, d, seq, v, i, [v] as firsts, 0 as facility from pay where i = 1 union all
select account_id, lender, d, seq, v, i, case when hit is null then list_append(firsts, v) else firsts end, coalesce(hit - 1, len(firsts))::int from (select p.*, firsts, list_filter(range(1, len(firsts) + 1), lambda j: abs(p.v - firsts[j]) * 100 <= greatest(1000000, 2 * firsts[j]))[1] as hit from fac join pay p on p.account_id = fac.account_id and p.lender = fac.lender and p.i = fac.i + 1)),
lf as (select account_id, lender, facility, count(*) as n, round(sum(v)::double / count(*))::bigint as emi_c, min(d) as first_d, max(d) as last_d, list(d order by d) as ds from fac group by 1, 2, 3 having count(*) >= 2),
lg as (select *, list_transform(range(1, len(ds)), lambda i: date_diff('day', ds[i], ds[i + 1])) as gaps, case when regexp_matches(upper(lender), 'HL|HOUSING') or emi_c > 2000000 then 'HOME_LOAN' when regexp_matches(upper(lender), 'AUTO|VEHICLE') then 'VEHICLE_LOAN' when regexp_matches(upper(lender), 'MUTHOOT|MANAPPURAM') then 'GOLD_LOAN' else 'PERSONAL_LOAN' end as loan_type from lf),
lh as (select *, len(list_filter(gaps, lambda x: x between 27 and 33)) as q1, len(list_filter(gaps, lambda x: x < 27)) as q2, len(list_filter(gaps, lambda x: x > 33 and x <= 40)) as q3, len(list_filter(gaps, lambda x: x > 40)) as q4 from lg),
ln as (select account_id, lender, facility, n, emi_c, loan_type, loan_type <> 'PERSONAL_LOAN' as secured, case when date_diff('day', last_d, end_d) <= 35 then 'Active' when date_diff('day', last_d, end_d) <= 65 then 'Grace' when date_diff('day', last_d, end_d) <= 95 then 'Missed EMI' else 'Overdue / Closed' end as status,
case when q1 >= greatest(q2, q3, q4) then 'On-Time' when q2 >= greatest(q3, q4) then 'Early' when q3 >= q4 then 'Late' else 'Skipped/Irregular' end as regularity, greatest(n, round_even(date_diff('day', first_d, last_d) / 30.0::double, 0)::bigint + 1) - n as missed, first_d, last_d from lh join (select account_id, max(d) as end_d from {table} group by 1) using (account_id))"""


def _loans(rows: DataFrame) -> DataFrame:
    own = classify.lenders(rows)
    return debt.loans(own.where("debit_c > 0"), rows.groupBy("account_id").agg(F.max("d").alias("end_d")), own.where("credit_c > 0"))


def _income(rows: DataFrame) -> DataFrame:
    return rows.groupBy("account_id").agg((F.sum("credit_c") / F.countDistinct("ym")).alias("monthly_c"))


_LEDGER_LOANS = LEDGER_SQL + ", " + loan_sql("ledger", "true")
_PLANTED_LOANS = PLANTED_SQL + ", " + loan_sql("pl", "true")
_FULL = "select account_id, lender, facility, n, emi_c, loan_type, secured, status, regularity, missed, first_d, last_d, strftime(last_d + interval 30 day, '%Y-%m-%d') || ',' || strftime(last_d + interval 60 day, '%Y-%m-%d') || ',' || strftime(last_d + interval 90 day, '%Y-%m-%d') as next_d, exists (select 1 from {t} x where x.account_id = ln.account_id and x.credit_c > 0 and x.description like 'ACH/' || ln.lender || '/%') as top_up from ln"
_dated = lambda l: l.withColumn("next_d", F.array_join(F.transform("next_d", lambda x: F.date_format(x, "yyyy-MM-dd")), ","))
_on("a24_loan_facilities", ledger_items, lambda l: debt.facility_rows(classify.lenders(l)).groupBy("account_id", "lender", "facility").agg(F.count("*").alias("n"), F.sum("v").alias("paid_c")), _LEDGER_LOANS, "select account_id, lender, facility, count(*) as n, sum(v)::bigint as paid_c from fac group by 1, 2, 3")
_on("a25_loan_status", ledger_items, lambda l: _dated(_loans(l)), _LEDGER_LOANS, _FULL.format(t="ledger"))
_on("a25b_loans_planted", planted, lambda l: _dated(_loans(l)), _PLANTED_LOANS, _FULL.format(t="pl"))
_on("j16_top_up", ledger_items, lambda l: _loans(l).groupBy("account_id").agg(F.count_if("top_up").alias("top_ups")), _LEDGER_LOANS, "select account_id, count(*) filter (where (account_id, lender) in (select account_id, string_split(description, '/')[2] from ledger where credit_c > 0 and description like 'ACH/%')) as top_ups from ln group by 1")
_PORTFOLIO = """select account_id, loans, active, lenders, emi_c, round(emi_c::double / m + 1e-9, 4) as foir, round(emi_c::double / m + 1e-9, 4) as dti, round(coalesce(top_c::double / nullif(emi_c, 0), 0) + 1e-9, 4) as concentration, round(secured::double / loans + 1e-9, 2) as secured_share, recent, recent >= 2 as stacking, missed_loans
from (select account_id, count(*) as loans, count(*) filter (where status in ('Active', 'Grace')) as active, count(distinct lender) as lenders, sum(case when status in ('Active', 'Grace') then emi_c else 0 end)::bigint as emi_c, max(emi_c) filter (where status in ('Active', 'Grace')) as top_c, count(*) filter (where secured) as secured, count(*) filter (where status = 'Active' and n <= 3) as recent, count(*) filter (where status = 'Missed EMI') as missed_loans from ln group by 1)
left join (select account_id, case when sum(credit_c) > 0 then sum(credit_c)::double / count(distinct ym) end as m from {t} group by 1) using (account_id)"""
_on("a26_portfolio", ledger_items, lambda l: debt.portfolio(_loans(l), _income(l)), _LEDGER_LOANS, _PORTFOLIO.format(t="ledger"))
_DISCIPLINE = "select account_id, paid, missed, pct, case when pct >= 90 then 'GOOD' when pct >= 70 then 'FAIR' else 'POOR' end as band from (select *, round(paid * 100.0::double / (paid + missed) + 1e-9, 2) as pct from (select account_id, sum(n)::bigint as paid, sum(missed)::bigint as missed from ln group by 1))"
_on("a28_emi_discipline", planted, lambda l: debt.discipline(_loans(l)), _PLANTED_LOANS, _DISCIPLINE)
_PROFILES = "select lender, count(*) filter (where status in ('Active', 'Grace')) as active, count(*) filter (where status not in ('Active', 'Grace')) as closed, sum(case when status in ('Active', 'Grace') then emi_c else 0 end)::bigint as emi_c, array_to_string(list_sort(list(distinct loan_type)), ',') as types from ln group by 1"
_on("a30_lender_profiles", ledger_items, lambda l: debt.lender_profiles(_loans(l)), _LEDGER_LOANS, _PROFILES)
_on("a30b_emi_schedule", planted, lambda l: debt.schedule(_loans(l)), _PLANTED_LOANS, "select account_id, lender, facility, loan_type, emi_c, (last_d + to_days(unnest([30, 60, 90])))::date as expected_d from ln where status in ('Active', 'Grace')")

# Detectors at their default bounds -----------------------------------------------------------------------
_credits = lambda l: l.select("account_id", "seq", "d", "ym", "counterparty", (F.col("debit_c") * 4).alias("credit_c"))
_on("a12_recurring_income", planted, lambda l: engines.recurring_income(_credits(l)), PLANTED_SQL,
    """select account_id, counterparty, n, total_c, gap from (select account_id, counterparty, count(*) as n, sum(v)::bigint as total_c, avg(v) as mean, stddev_pop(v) as s, median(g) as gap from (select account_id, counterparty, debit_c * 4 as v, date_diff('day', lag(d) over (partition by account_id order by d, seq), d)::double as g from pl) group by 1, 2) where n >= 3 and mean >= 500000 and s <= 0.25 * mean and gap between 24 and 36""")
_on("a19_sip_plans", planted, engines.sip_clusters, PLANTED_SQL, "select account_id, debit_c, 0::bigint as cluster, count(distinct ym) as months, count(*) as n from pl group by 1, 2 having count(distinct ym) >= 3")
#: Twelve debits a customer near one amount, three of them thirty times as large for odd keys; of odd keys divisible by
#: three these are payments into investments, and of keys divisible by four the payee is a bank.
_SPREAD_SQL = """sp as (select c_custkey as account_id, i as seq, case when i >= 9 and c_custkey % 2 = 1 then 3000000 else 100000 + 1000 * i end::bigint as debit_c, case when i >= 9 and c_custkey % 3 = 0 then 'Investment' else 'Expense' end as category, 'Other' as subcategory, case when c_custkey % 4 = 0 then 'HDFC CARD' when i % 3 = 0 then 'SHOP' else 'LANDLORD' end as counterparty from (select c_custkey, unnest(range(0, 12)) as i from customer))"""


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    late, k = F.col("i") >= 9, F.col("account_id")
    amount = F.when(late & (k % 2 == 1), F.lit(3_000_000)).otherwise(100_000 + 1000 * F.col("i")).cast("long")
    return c.select("account_id", F.col("i").cast("long").alias("seq"), amount.alias("debit_c"), F.when(late & (k % 3 == 0), "Investment").otherwise("Expense").alias("category"), F.lit("Other").alias("subcategory"), F.when(k % 4 == 0, "HDFC CARD").when(F.col("i") % 3 == 0, "SHOP").otherwise("LANDLORD").alias("counterparty"))


_on("a35_mad_outliers", _spread, fraud.mad_outliers, _SPREAD_SQL, "select account_id, seq, debit_c from (select *, median(dev) over (partition by account_id) as mad from (select *, abs(debit_c - med) as dev from (select *, median(debit_c) over (partition by account_id) as med from sp))) where mad > 0 and 0.6745 * dev > 6.0 * mad and category <> 'Investment'")
_on("a36_concentration", _spread, fraud.concentration, _SPREAD_SQL, "select account_id, top, amount_c from (select account_id, arg_max(counterparty, (v, counterparty)) as top, max(v) as amount_c, sum(v) as t from (select account_id, counterparty, sum(debit_c)::bigint as v from sp group by 1, 2) group by 1) where amount_c * 100 > t * 45 and top not like '%HDFC%'")

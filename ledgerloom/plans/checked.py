"""Queries of printed facts, focused sheets, cheques and specification scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import checks, timeline
from ledgerloom.plans.registry import DAILY_SQL, add, on_classified, on_events, on_ledger, on_slim
from ledgerloom.sources.tables import EVENTS_SQL, LEDGER_SQL, ledger_items, read

_KIND = "mod(account_id, 11)"


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each account's statement prints, read off the tables and not the ledger, and where it is wrong or missing."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x, credit = cents("l_extendedprice"), F.col("l_linestatus") == "F"
    s = rows.groupBy(F.col("o_custkey").alias("account_id")).agg(F.sum(F.when(~credit, x).otherwise(0)).alias("out_c"), F.sum(F.when(credit, x).otherwise(0)).alias("in_c"), F.count("*").alias("rows"), F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi"))
    s = s.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), cents("c_acctbal").alias("opening_c")), "account_id").withColumn("k", F.col("account_id") % 11)
    known, k = ~F.col("k").isin(4, 7, 10), F.col("k")
    when = lambda c: F.when(known, c)
    return s.select(
        "account_id", when(F.col("opening_c")).alias("opening_c"), when(F.col("opening_c") - F.col("out_c") + F.col("in_c") + F.when(k == 2, 5000).otherwise(0)).alias("closing_c"), when(F.when(k == 1, F.col("in_c")).otherwise(-F.col("out_c"))).alias("debits_c"),
        when(F.when(k == 1, F.col("out_c")).otherwise(F.col("in_c"))).alias("credits_c"), when(F.col("rows") + (k == 3).cast("int")).alias("rows"), F.when(k == 5, 2).alias("serial_gaps"), F.col("lo").alias("period_start"), F.date_sub("hi", F.when(k == 9, 1).otherwise(0)).alias("period_end"),
        F.when(k == 6, 9).otherwise(8).alias("pages_declared"), F.lit(8).alias("pages_actual"), (k.isin(7, 0)).alias("template_fallback"), F.when(k == 8, F.array(F.lit(7))).when(k == 10, F.array(F.lit(2), F.lit(3))).alias("empty_pages"), F.lit(8).alias("pages_total"),
    )


def _broken(rows: DataFrame) -> DataFrame:
    """The ledger with a balance that doesn't follow in some accounts."""
    return rows.withColumn("balance_c", F.col("balance_c") + F.when((F.col("account_id") % 13 == 0) & (F.col("seq") == 2), 1000).otherwise(0))


_FAILS = f"""list_filter([case when {_KIND} = 1 and in_c <> out_c and abs(in_c - out_c) > 100 then 'debits_match_printed_total' end, case when {_KIND} = 1 and abs(in_c - out_c) > 100 then 'credits_match_printed_total' end, case when {_KIND} = 2 or ({_KIND} not in (4, 7, 10) and off_last) then 'closing_matches_printed' end,
case when ({_KIND} = 1 and abs(in_c - out_c) * 2 > 100) or {_KIND} = 2 then 'printed_figures_are_self_consistent' end, case when {_KIND} = 3 then 'row_count_matches_statement' end, case when {_KIND} = 5 then 'serial_run_unbroken' end, case when {_KIND} = 9 then 'dates_within_printed_period' end, case when {_KIND} = 6 then 'page_count_matches_declared' end,
case when off then 'balance_chain_intact' end], lambda x: x is not null)"""
add("a55b_fidelity_checks", lambda s, d: checks.fidelity(_broken(ledger_items(s, d)), _printed(s, d)).select("account_id", "status", F.col("anchors_found").cast("long").alias("anchors_found"), F.col("failed").cast("long").alias("failed"), F.array_join(F.transform(F.filter("checks", lambda x: ~x["passed"]), lambda x: x["check"]), ",").alias("named"), F.size("checks").cast("long").alias("made")),
    f"""with {LEDGER_SQL}, s as (select account_id, sum(debit_c)::bigint as out_c, sum(credit_c)::bigint as in_c, count(*) as n, account_id % 13 = 0 and count(*) >= 2 as off, account_id % 13 = 0 and count(*) = 2 as off_last from ledger group by 1), f as (select *, {_FAILS} as facts from s),
g as (select account_id, case when {_KIND} in (4, 7, 10) then 0 else 5 end as anchors_found, facts || case when {_KIND} = 7 or ({_KIND} = 0 and len(facts) > 0) then ['bank_template_available'] else [] end || case when {_KIND} = 10 then ['every_page_yielded_rows'] else [] end as named, case when {_KIND} in (4, 7, 10) then 3 else 9 end + case when {_KIND} = 5 then 1 else 0 end + case when {_KIND} in (7, 0) then 1 else 0 end + case when {_KIND} in (8, 10) then 1 else 0 end as made from f)
select account_id, case when len(named) > 0 then 'FAILED' when anchors_found > 0 then 'VERIFIED' else 'UNVERIFIED' end as status, anchors_found::bigint as anchors_found, len(named)::bigint as failed, array_to_string(named, ',') as named, made::bigint as made from g""")  # fmt: skip

_SELF = "case when seq % 17 = 0 then 'Self Transfer' else subcategory end"
on_classified("f13b_focus_sheets", lambda c: checks.sheet_totals(checks.sheets(c.withColumn("subcategory", F.when(F.col("seq") % 17 == 0, "Self Transfer").otherwise(F.col("subcategory"))), text.rail(F.col("description")))),
    f"""select account_id, sheet, count(*) as n, sum(debit_c)::bigint as out_c, sum(credit_c)::bigint as in_c from (select *, unnest(list_filter([case when contains(sub, 'salary') then 'Salary Txns' end, case when contains(sub, 'cash') then 'Cash Txns' end, case when contains(sub, 'cheque') then 'Cheque Txns' end, case when contains(upper(description), 'UPI') then 'UPI Txns' end,
case when contains(sub, 'self transfer') then 'Self Txns' end, case when contains(sub, 'emi') or contains(sub, 'loan') then 'Loans & EMI' end], lambda x: x is not null)) as sheet from (select *, lower({_SELF}) as sub from cl)) group by 1, 2""")  # fmt: skip

_TRADE = ", ".join(f"'{b}'" for b in (*checks.BUSINESS, "Groceries", "Rent"))
on_slim("a9b_business", lambda l: checks.business(l.withColumn("subcategory", F.element_at(F.array(*[F.lit(b) for b in (*checks.BUSINESS, "Groceries", "Rent")]), (F.col("seq") % 7 + 1).cast("int")))),
    "select account_id, sum(case when seq % 7 < 5 then credit_c else 0 end)::bigint as in_c, sum(case when seq % 7 < 5 then debit_c else 0 end)::bigint as out_c, coalesce(round(sum(case when seq % 7 < 5 then credit_c else 0 end)::bigint * 100::double / nullif(sum(credit_c)::bigint, 0), 2), 0) as in_pct, coalesce(round(sum(case when seq % 7 < 5 then debit_c else 0 end)::bigint * 100::double / nullif(sum(debit_c)::bigint, 0), 2), 0) as out_pct from ledger group by 1")

_C = "case when starts_with(description, 'CLG/') and seq % 5 = 0 then description || ' RETURN' else description end"
_CHEQUES = f"ch as (select account_id, d, credit_c > 0 as paid_in, contains({_C}, 'CLG') as ch, contains({_C}, 'CLG') and contains({_C}, 'RETURN') as back from ledger), dy as (select account_id, d, count(*) filter (where ch) as total, count(*) filter (where back and paid_in) as inward, count(*) filter (where back and not paid_in) as outward from ch group by 1, 2), chq as (select account_id, sum(total)::bigint as total, sum(inward + outward)::bigint as bounced, sum(inward)::bigint as inward_bounced, sum(outward)::bigint as outward_bounced, sum(case when date_diff('day', d, last_d) <= 90 then inward + outward else 0 end)::bigint as recent_bounces, sum(case when total > 1 then inward + outward else 0 end)::bigint as same_day, min(date_diff('day', d, last_d)) filter (where inward + outward > 0) as days_since from (select *, max(d) over (partition by account_id) as last_d from dy) group by 1)"


def _cheques(l: DataFrame) -> DataFrame:  # noqa: E741
    t = l.withColumn("description", F.when(F.col("description").startswith("CLG/") & (F.col("seq") % 5 == 0), F.concat("description", F.lit(" RETURN"))).otherwise(F.col("description")))
    return checks.cheques(t, F.contains("description", F.lit("CLG")), F.contains("description", F.lit("RETURN")))


on_ledger("x11b_cheques", _cheques, "select account_id, total, bounced, round(coalesce(bounced * 100::double / nullif(total, 0), 0), 2) as rate_pct, coalesce(bounced * 100::double / nullif(total, 0), 0) > 10 as red_flag, inward_bounced, outward_bounced, recent_bounces, same_day, days_since from chq", _CHEQUES)


def _discipline(l: DataFrame) -> DataFrame:  # noqa: E741
    fee = F.contains("description", F.lit("RETURN CHARGES"))
    s = l.groupBy("account_id").agg(F.count_if(fee).alias("penalties"), F.sum(F.when(fee, F.col("debit_c")).otherwise(0)).alias("charges_c"), F.floor(F.sum("balance_c") / F.count("*")).alias("mean_balance_c"))
    return checks.discipline(s.join(_cheques(l).select("account_id", F.col("rate_pct").alias("bounce_pct")), "account_id").withColumns({"emi_score": F.col("account_id") % 101, "delay_days": F.col("account_id") % 45}))


on_ledger("x12b_discipline", _discipline,
    "select account_id, greatest(0, 100 - case when account_id % 101 < 70 then 30 when account_id % 101 < 90 then 15 else 0 end - case when r > 10 then 25 when r > 5 then 15 when r > 1 then 5 else 0 end - least(p * 3, 20) - case when b > 0 and c * 20 > b then 10 else 0 end - case when account_id % 45 > 30 then 10 when account_id % 45 > 7 then 5 else 0 end)::bigint as score from (select account_id, round(coalesce(bounced * 100::double / nullif(total, 0), 0), 2) as r from chq) join (select account_id, count(*) filter (where contains(description, 'RETURN CHARGES')) as p, coalesce(sum(debit_c) filter (where contains(description, 'RETURN CHARGES')), 0) as c, floor(sum(balance_c)::double / count(*)) as b from ledger group by 1) using (account_id)", _CHEQUES)
on_events("x9b_laundering_score", lambda l: checks.laundering(timeline.daily_balance(l), l, l.where("debit_c > 20000").groupBy("account_id").agg((F.count("*") % 5).alias("n"))),
    """select account_id, least(100, case when sum_c > 0 then case when gap > sum_c * 5 then 20 when gap > sum_c * 3 then 15 when gap > sum_c then 10 else 0 end + case when busy > sum_c * 10 then 15 when busy > sum_c * 5 then 10 else 0 end else 0 end + case when apart <= 3 then 15 when apart <= 7 then 10 when apart <= 14 then 5 else 0 end + case when dormant > 30 then 10 when dormant > 15 then 5 else 0 end + 5 * coalesce(n, 0))::bigint as score
from (select account_id, sum(balance_c) as sum_c, (max(balance_c) - min(balance_c)) * count(*) as gap, count(*) as days, abs(date_diff('day', (arg_max(d, (balance_c, -epoch(d)))), (arg_min(d, (balance_c, epoch(d)))))) as apart from daily group by 1) join (select account_id, sum(k) as n_rows, coalesce(max(g), 0) as dormant from (select *, date_diff('day', lag(d) over (partition by account_id order by d), d) as g from (select account_id, d, count(*) as k from ev group by 1, 2)) group by 1) using (account_id)
left join (select account_id, count(*) % 5 as n from ev where debit_c > 20000 group by 1) using (account_id), lateral (select n_rows * days * 1000000 as busy)""", DAILY_SQL.format(t="ev"))  # fmt: skip

"""Further registered queries: cleaning, labels, risk, report and specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import classify, cleaning, engines, fraud, joins, labels, query, report, risk, score, spec, timeline
from ledgerloom.plans.registry import DAILY_SQL, INCOME, KEYWORDS_SQL, MONTHLY_SQL, add, on_classified, on_events, on_ledger, on_shared, on_slim, raw_cells
from ledgerloom.sources import scans
from ledgerloom.sources.tables import LEDGER_SQL, ledger_items, merge_statements, read


# Cleaning ------------------------------------------------------------------------------------------------
on_slim("p6_signed_split", lambda l: l.withColumn("amount", F.col("credit_c") - F.col("debit_c")).select("account_id", "seq", *[c.cast("long").alias(n) for c, n in zip(cleaning.split_signed(F.col("amount"), F.lit(None).cast("string")), ("debit", "credit"), strict=True)]),
    "select account_id, seq, debit_c as debit, credit_c as credit from ledger")
on_ledger("p7_cheque_merge", lambda l: l.select("account_id", "seq", cleaning.with_cheque(F.col("description"), F.when(F.col("seq") % 2 == 0, F.col("seq").cast("string"))).alias("description")),
    "select account_id, seq, case when seq % 2 = 0 and not contains(description, cast(seq as string)) then description || ' ' || seq else description end as description from ledger")
on_ledger("p8_clean_description", lambda l: l.select("account_id", "seq", text.clean_description(F.concat(F.lit("  "), F.replace("description", F.lit(" "), F.lit("\t  ")), F.lit(" - x "))).alias("description")),
    "select account_id, seq, regexp_replace(trim(regexp_replace(replace(description, ' ', '   ') || ' - x ', ' *- *', '-', 'g')), ' {2,}', ' ', 'g') as description from ledger")
on_ledger("p9b_leading_date", lambda l: l.withColumn("cell", F.when(F.col("seq") % 2 == 0, F.concat(F.date_format("d", "dd/MM/yyyy"), F.lit("  "), F.col("description"))).otherwise(F.col("description"))).select("account_id", "seq", *[c.alias(n) for c, n in zip(cleaning.leading_date(F.col("cell")), ("d", "rest"), strict=True)]),
    "select account_id, seq, case when seq % 2 = 0 then d end as d, trim(description) as rest from ledger")
add("p3b_signed_balance", lambda s, d: raw_cells(s, d).groupBy("l_suppkey").agg(F.sum((text.clean_numeric(F.col("cell"), True) * 100).cast("long")).alias("sum_c")),
    "select l_suppkey, sum(case mod(l_orderkey + l_partkey, 7) when 5 then 0 when 1 then -1 when 2 then -1 when 3 then -1 else 1 end * cast(round(l_extendedprice * 100) as bigint))::bigint as sum_c from lineitem group by 1")
add("f3_blank_rows", lambda s, d: cleaning.drop_blank(read(s, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("a"), F.when(F.col("l_linenumber") > 4, F.col("l_tax")).alias("b")), ["a", "b"]).agg(F.count("*").alias("n")), "select count(*) as n from lineitem where l_linenumber > 2")
on_classified("f8_true_turnover_rows", lambda c: c.where(~(F.col("subcategory").isin("Loan EMI") | F.col("is_return"))).groupBy("account_id").agg(F.sum("credit_c").alias("credit_c"), F.sum("debit_c").alias("debit_c")), "select account_id, sum(credit_c)::bigint as credit_c, sum(debit_c)::bigint as debit_c from cl where subcategory <> 'Loan EMI' and not is_return group by 1")
on_classified("f9_income_rows", lambda c: c.where(INCOME).select("account_id", "seq", "credit_c"), f"select account_id, seq, credit_c from cl where {INCOME}")
on_ledger("f10_cash_rows", lambda l: l.where((text.rail(F.col("description")) == "ATM_CASH") | F.lower("description").rlike("cash")).select("account_id", "seq"), "select account_id, seq from ledger where contains(lower(description), 'cash')")
on_ledger("f11_reversals", lambda l: l.where(F.upper("description").rlike("RVSL|REVERSAL|REFUND|RETURN")).groupBy("account_id").agg(F.count("*").alias("n")), "select account_id, count(*) as n from ledger where contains(upper(description), 'RETURN') group by 1")
on_classified("f13_focus_sheet", lambda c: report.focus(c, "Cheque").select("account_id", "seq"), "select account_id, seq from cl where contains(lower(concat_ws(' ', description, category, subcategory)), 'cheque')")
on_ledger("f15_token_predicate", lambda l: l.agg(*[F.count_if(text.token_matches(F.col("description"), t)).alias(t) for t in ("emi", "ring", "supplier")]),
    "select count(*) filter (where regexp_matches(lower(description), '(^|[^a-z0-9])emi([^a-z0-9]|$)')) as emi, count(*) filter (where regexp_matches(lower(description), '(^|[^a-z0-9])ring([^a-z0-9]|$)')) as ring, count(*) filter (where contains(lower(description), 'supplier')) as supplier from ledger")
add("s10_merge_statements", lambda s, d: _merged(ledger_items(s, d)), f"with {LEDGER_SQL} select account_id, case when credit_c > 0 then 0 else 1 end as source_no, count(*) as n from (select distinct account_id, d, description, debit_c, credit_c, balance_c from ledger) group by 1, 2")


def _merged(l: DataFrame) -> DataFrame:
    """Two overlapping statements of each account merged."""
    rows = l.select("account_id", "seq", F.col("d").alias("date"), "description", (F.col("debit_c") / 100).cast("decimal(18,2)").alias("debit"), (F.col("credit_c") / 100).cast("decimal(18,2)").alias("credit"), (F.col("balance_c") / 100).cast("decimal(18,2)").alias("balance"))
    m = merge_statements([rows.where("credit > 0"), rows])
    return m.groupBy("account_id", "source_no").agg(F.count("*").alias("n"))


add("s11_bank_detection", lambda s, d: cleaning.detect_bank(read(s, d, "supplier").select(F.col("s_suppkey").alias("document"), F.concat(F.lit("IFSC "), F.when(F.col("s_nationkey") % 3 == 0, "HDFC0001 SBIN").when(F.col("s_nationkey") % 3 == 1, "SBIN0002").otherwise("none")).alias("line")), s.createDataFrame([("HDFC0", "HDFC", 3), ("SBIN", "SBI", 2)], "marker string, bank string, weight int")),
    "select s_suppkey as document, case s_nationkey % 3 when 0 then 'HDFC' when 1 then 'SBI' else 'Other' end as bank from supplier")
add("s9_aggregator_text", lambda s, d: cleaning.aa_blocks(_aa_lines(read(s, d, "orders"))),
    "select o_custkey as document, row_number() over (partition by o_custkey order by o_orderkey) as block, 'S' || lpad(cast(o_orderkey as string), 8, '0') as txn, cast(o_orderdate as date) as d, case when o_orderstatus = 'F' then 'CREDIT' else 'DEBIT' end as kind, cast(cast(o_totalprice as decimal(18,2)) as string) as amount from orders")


def _aa_lines(orders: DataFrame) -> DataFrame:
    parts = F.array(F.concat(F.lit("S"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(F.col("o_orderstatus") == "F", "Credit").otherwise("debit"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return orders.select(F.col("o_custkey").alias("document"), "o_orderkey", F.posexplode(parts).alias("i", "line")).select("document", (F.col("o_orderkey") * 4 + F.col("i")).alias("line_no"), "line")


# Labels --------------------------------------------------------------------------------------------------
on_ledger("c12_truncated_match", lambda l: labels.truncated(l.select(F.substring(F.element_at(F.split("description", "/"), -1), 1, 6).alias("value"))),
    "select value, k.keyword as keyword, k.ks as k_subcategory from (select value, arg_max(kw, length(kw.keyword) * 1000 - kw.ord) as k from (select distinct substring(string_split(description, '/')[-1], 1, 6) as value from ledger) join kw on length(value) >= 6 and starts_with(keyword, lower(value)) group by value)", f"kw(keyword, kc, ks, kl, ord) as (values {KEYWORDS_SQL})")
on_ledger("c13_remark_label", lambda l: l.withColumn("label", labels.remark_label(F.element_at(F.split("description", "/"), -1))).groupBy("label").agg(F.count("*").alias("n")),
    "select case when r like 'hot pl%' then 'Want' when r like 'small%' or r like 'large%' or r like 'hot%' then 'Need' when r like 'red%' then 'Want' end as label, count(*) as n from (select lower(string_split(description, '/')[-1]) as r from ledger) group by 1")
on_ledger("c19_fuzzy_top1", lambda l: labels.fuzzy_top(l, l.sparkSession.createDataFrame([("red widget shop",), ("hot ring",), ("employer payroll services",)], "name string")).groupBy("name", "score").agg(F.count("*").alias("n")))
on_ledger("c34_taxonomy", lambda l: l.groupBy(labels.taxonomy(F.col("description")).alias("taxonomy")).agg(F.count("*").alias("n"), F.sum("debit_c").alias("spent_c")),
    "select case when contains(upper(description), 'CASH WDL') then 'CASH' when regexp_matches(t, 'widget|plate|rod|lender') then 'NEEDS' when regexp_matches(t, 'gizmo|ring|anvil') then 'WANTS' when regexp_matches(t, 'mfp|sip') then 'INVESTMENT' else 'OTHER' end as taxonomy, count(*) as n, sum(debit_c)::bigint as spent_c from (select *, lower(description) as t from ledger) group by 1")
on_ledger("c24_heuristics", lambda l: l.groupBy(labels.heuristic(F.col("description"), F.col("debit_c")).alias("label")).agg(F.count("*").alias("n")),
    "select case when regexp_matches(u, 'EMI|LOAN|LENDER') and debit_c > 0 then 'Loan EMI' when regexp_matches(u, 'CHARGES|FEE') then 'Banking Charges' when regexp_matches(u, 'SALARY|PAYROLL') then 'Salary' when contains(u, 'CASH') then 'Cash' else 'Other' end as label, count(*) as n from (select *, upper(description) as u from ledger) group by 1")
on_classified("c22_rail_fallback", lambda c: c.where("method = 'rail'").groupBy("category", "subcategory", "confidence").agg(F.count("*").alias("n")), "select category, subcategory, confidence, count(*) as n from cl where method = 'rail' group by 1, 2, 3")

# Joins and sets ------------------------------------------------------------------------------------------
on_slim("j11_anti_override", lambda l: l.join(l.where("counterparty like '%1'").select("account_id", "counterparty").distinct(), ["account_id", "counterparty"], "left_anti").groupBy("account_id").agg(F.count("*").alias("n")), "select account_id, count(*) as n from ledger where counterparty not like '%1' group by 1")
on_events("j13_date_spine", lambda l: timeline.daily_balance(l).join(l.select("account_id", "d").distinct(), ["account_id", "d"], "left_anti"), "select account_id, d, balance_c from daily where (account_id, d) not in (select account_id, d from ev)", DAILY_SQL.format(t="ev"))
on_slim("j15_month_alignment", lambda l: l.where("credit_c > 0").groupBy("account_id", "ym").agg(F.sum("credit_c").alias("a")).join(l.where("debit_c > 0").groupBy("account_id", "ym").agg(F.sum("debit_c").alias("b")), ["account_id", "ym"], "full_outer").select("account_id", "ym", F.coalesce("a", F.lit(0)).alias("in_c"), F.coalesce("b", F.lit(0)).alias("out_c")), "select account_id, ym, inflow_c as in_c, outflow_c as out_c from m", MONTHLY_SQL)
on_ledger("u1_union_promoted", lambda l: l.select("account_id", F.explode(F.array_compact(F.array(F.when(F.col("credit_c") > 9_000_000, 1), F.when(F.col("description").startswith("SALARY"), 2)))).alias("promoted")).groupBy("account_id").agg(F.count("*").alias("n")), "select account_id, count(*) as n from (select account_id from ledger where credit_c > 9000000 union all select account_id from ledger where description like 'SALARY%') group by 1", place=True)
on_slim("u5_distinct_parties", lambda l: l.select("account_id", "counterparty").distinct().groupBy("account_id").agg(F.count("*").alias("n")), "select account_id, count(distinct counterparty) as n from ledger group by 1")
on_slim("t3_topn_amount", lambda l: l.select("account_id", "seq", (F.col("debit_c") + F.col("credit_c")).alias("amount_c")).orderBy(F.desc("amount_c"), "account_id", "seq").limit(25), "select account_id, seq, debit_c + credit_c as amount_c from ledger order by 3 desc, 1, 2 limit 25")
on_ledger("t7_evidence_first_five", lambda l: l.where("balance_c < 0").groupBy("account_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("seq")), 1, 5), lambda x: x.cast("string")), ",").alias("evidence")),
    "select account_id, array_to_string(list_slice(list_sort(list(seq)), 1, 5), ',') as evidence from ledger where balance_c < 0 group by 1")

# Aggregations --------------------------------------------------------------------------------------------
on_slim("a2_global_sums", lambda l: l.agg(F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c"), F.sum(F.col("credit_c") - F.col("debit_c")).alias("net_c")), "select sum(credit_c)::bigint as in_c, sum(debit_c)::bigint as out_c, sum(credit_c - debit_c)::bigint as net_c from ledger")
on_classified("a9_business_breakdown", lambda c: c.groupBy("account_id").agg(*[F.sum(F.when(F.col("subcategory") == s, F.col("debit_c") + F.col("credit_c")).otherwise(0)).alias(n) for s, n in (("Cheque", "cheque_c"), ("Merchant", "merchant_c"), ("UPI Transfer", "upi_c"))]),
    "select account_id, sum(case when subcategory = 'Cheque' then debit_c + credit_c else 0 end)::bigint as cheque_c, sum(case when subcategory = 'Merchant' then debit_c + credit_c else 0 end)::bigint as merchant_c, sum(case when subcategory = 'UPI Transfer' then debit_c + credit_c else 0 end)::bigint as upi_c from cl group by 1")
_BEHAVE = "select account_id, sum(debit_c)::bigint as o, sum(credit_c)::bigint as i, sum(case when contains(upper(description), 'CASH WDL') then debit_c else 0 end)::double as c, sum(case when dayofweek(d) in (0, 6) then debit_c else 0 end)::double as w, sum(case when needs_wants = 'Want' then debit_c else 0 end)::double as n, count(*) filter (where balance_c < 300000) as low_rows, count(distinct counterparty) as payees from cl group by 1"
on_classified("a32_behaviour", risk.behaviour,
    f"""select account_id, payees, low_rows, round(cash, 4) as cash, round(weekend, 4) as weekend, round(want, 4) as want, round(saved, 4) as saved, case when low_rows > 15 then 'Financial Stress' when cash > 0.35 then 'Cash Dependent' when want > 0.6 or weekend > 0.4 then 'Impulsive' when saved < -0.05 then 'Depleting Balance' when want > 0.4 then 'Lifestyle Inflation' when want < 0.2 and low_rows = 0 and saved > 0 then 'High Saver' else 'Stable' end as state
from (select account_id, payees, low_rows, coalesce(c / nullif(o, 0), 0) as cash, coalesce(w / nullif(o, 0), 0) as weekend, coalesce(n / nullif(o, 0), 0) as want, coalesce((i - o)::double / nullif(i, 0), 0) as saved from ({_BEHAVE}))""")
on_slim("a33_monthly_trend", risk.monthly_trend, "select account_id, outflow_c as v, b as before, case when outflow_c * 100 > b * 115 then 'RISING' when outflow_c * 100 < b * 85 then 'FALLING' else 'STEADY' end as trend from (select *, row_number() over (partition by account_id order by ym desc) as r, lag(outflow_c) over (partition by account_id order by ym) as b from m) where r = 1 and b is not null", MONTHLY_SQL)
on_ledger("a39_cash_vs_salary", fraud.cash_against_salary, "select account_id, cash_c, salary_c from (select account_id, sum(case when contains(description, 'CASH WDL') then credit_c else 0 end)::bigint as cash_c, sum(case when description like 'SALARY%' then credit_c else 0 end)::bigint as salary_c from ledger group by 1) where salary_c > 0 and cash_c * 2 > salary_c * 3")
on_classified("a48_true_turnover", lambda c: risk.true_turnover(c, joins.two_sided(c)),
    "select account_id, greatest(0, clean - coalesce(mir, 0))::bigint as turnover_c from (select account_id, sum(case when subcategory = 'Loan EMI' or is_return then 0 else credit_c end) as clean from cl group by 1) left join (select account_id, sum(2 * least(i, o)) as mir from (select account_id, counterparty, sum(credit_c) as i, sum(debit_c) as o from cl group by 1, 2) where i > 1000000 and o > 1000000 and abs(i - o) * 100 <= greatest(i, o) * 15 group by 1) using (account_id)")
on_ledger("a52_business_profile", lambda l: risk.business_profile(l, {"metal": "rod|bolt|gear|anvil", "home": "plate|widget|ring|gizmo"}),
    "select account_id, n, case when (m, 'metal') > (h, 'home') then 'metal' else 'home' end as sector, greatest(m, h)::bigint as hits, case when greatest(m, h)::double / n >= 0.4 then 'FORMAL' when greatest(m, h)::double / n >= 0.15 then 'MIXED' else 'INFORMAL' end as profile from (select account_id, count(*) as n, count(*) filter (where regexp_matches(lower(description), 'rod|bolt|gear|anvil')) as m, count(*) filter (where regexp_matches(lower(description), 'plate|widget|ring|gizmo')) as h from ledger group by 1)")
on_ledger("a53_credit_audit", risk.audit,
    "select account_id, bounces, cleared, bounces - cleared as confirmed, employer from (select account_id, count(*) filter (where contains(description, 'RETURN CHARGES')) as bounces, count(*) filter (where contains(description, 'RETURN CHARGES') and exists (select 1 from ledger x where x.account_id = l.account_id and x.description like 'ACH/%' and x.debit_c > 0 and x.d between l.d and l.d + interval 7 day)) as cleared, arg_min(description, seq) filter (where description like 'SALARY%' and credit_c > 0) as employer from ledger l group by 1)")
on_shared("a56_result_gate", lambda c: score.gate(score.composite(score.features(c)), score.ledger_checks(c)))
on_ledger("a60_cashflow_sheet", lambda l: l.groupBy("account_id", "ym").agg(F.sum("credit_c").alias("in_c"), F.sum("debit_c").alias("out_c"), F.count_if(F.col("credit_c") > 0).alias("n_in"), F.count_if(F.col("debit_c") > 0).alias("n_out"), F.sum("balance_c").alias("balance_sum_c")), "select account_id, ym, sum(credit_c)::bigint as in_c, sum(debit_c)::bigint as out_c, count(*) filter (where credit_c > 0) as n_in, count(*) filter (where debit_c > 0) as n_out, sum(balance_c)::bigint as balance_sum_c from ledger group by 1, 2")
on_ledger("w3_printed_balance", lambda l: risk.printed_balance_breaks(l.withColumn("balance_c", F.col("balance_c") * F.when(F.col("seq") % 11 == 0, 2).otherwise(1))), "select account_id, seq, off_c from (select account_id, seq, b, abs(lag(b) over (partition by account_id order by seq) - debit_c + credit_c - b) as off_c from (select *, balance_c * case when seq % 11 = 0 then 2 else 1 end as b from ledger)) where b <> 0 and off_c > 0.02::double * abs(b)")

# Questions -----------------------------------------------------------------------------------------------
for _name, _q, _sql in [
    ("q7_average", "average of widget debits in 1997", "select account_id, count(*) as n, sum(debit_c + credit_c)::bigint as total_c, round(sum(debit_c + credit_c) / count(*))::bigint as average_c from cl where debit_c > 0 and year(d) = 1997 and contains(lower(concat_ws(' ', description, category, subcategory)), 'widget') group by 1"),
    ("q8_smallest", "smallest credits in june", "select account_id, rank, seq, d, description, amount_c from (select *, debit_c + credit_c as amount_c, row_number() over (partition by account_id order by debit_c + credit_c, seq) as rank from cl where credit_c > 0 and month(d) = 6) where rank <= 5"),
    ("q8_list", "list gizmo", "select account_id, rank, seq, d, description, debit_c + credit_c as amount_c from (select *, row_number() over (partition by account_id order by seq) as rank from cl where contains(lower(concat_ws(' ', description, category, subcategory)), 'gizmo')) where rank <= 5"),
    ("q9_no_match", "how much did I pay to zzyzx corp", "select account_id, count(*) as n, sum(debit_c)::bigint as total_c, sum(debit_c)::bigint as average_c from cl where false group by 1"),
    ("q12_large_debits", None, "select account_id, seq, debit_c from cl where debit_c >= 5000000"),
]:
    on_classified(_name, (lambda c, q=_q: query.resolve(c, q) if q else c.where("debit_c >= 5000000").select("account_id", "seq", "debit_c")), _sql)

# Specified, not in the reference's code ------------------------------------------------------------------
on_ledger("x1_deposit_withdrawal", spec.deposit_then_withdrawal, "select c.account_id, c.seq, c.credit_c, sum(x.debit_c)::bigint as out_c from ledger c join ledger x on x.account_id = c.account_id and x.d between c.d and c.d + interval 1 day and x.debit_c > 0 where c.credit_c >= 5000000 group by 1, 2, 3 having sum(x.debit_c) >= c.credit_c")
on_ledger("x5_international", lambda l: l.where(F.upper("description").rlike("SWIFT|FOREX|USD|(^|[^A-Z])INTL([^A-Z]|$)|PLATE")).groupBy("account_id").agg(F.count("*").alias("n")), "select account_id, count(*) as n from ledger where regexp_matches(upper(description), 'SWIFT|FOREX|USD|(^|[^A-Z])INTL([^A-Z]|$)|PLATE') group by 1")
on_slim("x8_inter_account", lambda l: spec.inter_account_counts(l.withColumns({"debit_c": F.floor(F.col("debit_c") / 1_000_000).cast("long"), "credit_c": F.floor(F.col("credit_c") / 1_000_000).cast("long")})), "select a.debit_c // 1000000 as amount_c, count(*) as n from ledger a join ledger b on b.account_id <> a.account_id and b.credit_c // 1000000 = a.debit_c // 1000000 and b.d between a.d and a.d + interval 1 day where a.debit_c >= 1000000 and b.credit_c >= 1000000 group by 1")
on_ledger("x11_bounce_rates", spec.bounce_rates, "select account_id, b as bounces, c as cheques, date_diff('day', lb, last_d) as days_since, round(b::double / nullif(c, 0), 4) as rate from (select account_id, count(*) filter (where contains(description, 'RETURN CHARGES')) as b, count(*) filter (where description like 'CLG/%') as c, max(d) filter (where contains(description, 'RETURN CHARGES')) as lb, max(d) as last_d from ledger group by 1)")
on_ledger("x12_discipline_score", risk.discipline_score, "select account_id, greatest(0, least(100, 100 - least(40, 10 * b) - least(30, n) - case when o > i then 20 else 0 end))::bigint as points from (select account_id, count(*) filter (where contains(description, 'RETURN CHARGES')) as b, count(*) filter (where balance_c < 0) as n, sum(credit_c) as i, sum(debit_c) as o from ledger group by 1)")
on_ledger("x14_holiday_cheques", lambda l: spec.weekend_rows(l, l.sparkSession.sql("select date'1998-01-26' as d union all select date'1999-08-15'")), "select account_id, count(*) as n from ledger where description like 'CLG/%' and (d in (date '1998-01-26', date '1999-08-15') or dayofweek(d) = 0) group by 1")
on_ledger("x15_balance_trend", spec.balance_trend, "select account_id, f as first_c, l as last_c, case when l > f then 'UP' when l < f then 'DOWN' else 'FLAT' end as trend from (select account_id, arg_min(b, ym) as f, arg_max(b, ym) as l from (select account_id, ym, arg_max(balance_c, seq) as b from ledger group by 1, 2) group by 1)")
on_ledger("x19_upi_apps", spec.upi_apps, "select lower(regexp_extract(description, '@([A-Za-z]+)', 1)) as handle, count(*) as n, count(distinct account_id) as accounts from ledger where contains(description, '@') group by 1")
on_slim("x20_variance_bands", lambda l: spec.variance_bands(l.groupBy("account_id", "ym").agg(F.when(F.count("*") > 1, F.sum("credit_c") + F.max("debit_c")).alias("declared_c")), l), "select account_id, ym, case when n < 2 then 'MISSING' when x * 100 <= (i + x) * 10 then 'MATCH' when x * 100 <= (i + x) * 25 then 'REVIEW' else 'MISMATCH' end as band from (select account_id, ym, sum(credit_c) as i, max(debit_c) as x, count(*) as n from ledger group by 1, 2)")


# Scans and further measures ------------------------------------------------------------------------------


def _lines(customers: DataFrame) -> DataFrame:
    """Statement heads made from customers."""
    money = F.format_number(F.abs("c_acctbal"), 2)
    texts = F.array(
        F.lit("Some Bank - Statement"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Account Holder: "), F.col("c_name"))).otherwise("Branch 7"), F.when(F.col("c_custkey") % 3 == 1, F.lit("Asha Verma")).otherwise(F.lit("IFSC HDFC0001234")),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Opening Balance: "), money, F.when(F.col("c_acctbal") < 0, " Dr").otherwise(" Cr"))).otherwise("-"), F.concat(F.lit("Debit count: "), (F.col("c_custkey") % 50).cast("string")),
    )
    return customers.select(F.col("c_custkey").alias("document"), F.posexplode(texts).alias("line_no", "line"))


add("s12_holder_scan", lambda s, d: scans.holder(_lines(read(s, d, "customer"))), "select c_custkey as document, case c_custkey % 3 when 0 then c_name when 1 then 'Asha Verma' end as holder from customer")
add("s14_anchor_scan", lambda s, d: scans.anchors(_lines(read(s, d, "customer"))).select("document", "opening_c", "closing_c", "debit_count", "ifsc"),
    "select c_custkey as document, case when c_custkey % 2 = 0 then cast(round(c_acctbal * 100) as bigint) end as opening_c, cast(null as bigint) as closing_c, c_custkey % 50 as debit_count, case when c_custkey % 3 <> 1 then 'HDFC0001234' end as ifsc from customer")
add("s18_point_lookup", lambda s, d: read(s, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus"), "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 7")
add("s17_scan_by_key", lambda s, d: read(s, d, "orders").where("o_custkey = 5").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey"), "select o_orderkey, o_orderdate from orders where o_custkey = 5")
on_ledger("a29_facilities", risk.facilities, "select account_id, count(*) filter (where credit_c > 0) as drawn, count(*) filter (where debit_c > 0) as repaid, sum(credit_c)::bigint as drawn_c, sum(debit_c)::bigint as repaid_c from ledger where regexp_matches(upper(description), 'EMI|FINANCE|LENDER') group by 1")
on_ledger("a34_salary_cycle", risk.salary_cycle, "select account_id, count(*) as n, median(day(d))::double as day, median(credit_c)::double as median_c from ledger where credit_c > 0 and regexp_matches(upper(description), 'SALARY|PAYROLL') group by 1")
on_shared("a44_aml_score", lambda c: risk.aml_score(fraud.fraud_score(fraud.all_flags(c))).select("account_id", "aml_score", "aml_band"))
on_slim("x2_deposits_withdrawal", spec.deposits_then_withdrawal, "select account_id, seq, debit_c, in_c::bigint as in_c from (select *, count(*) filter (where credit_c > 0) over w as n, sum(credit_c) over w as in_c from ledger window w as (partition by account_id order by d range between interval 3 day preceding and current row)) where debit_c >= 5000000 and n >= 2 and in_c >= debit_c")
on_slim("x4_high_spending", spec.high_spending, "select account_id, seq, debit_c from ledger join (select account_id, sum(credit_c) as i from ledger group by 1) using (account_id) where debit_c > 0 and debit_c * 100 > i * 5")
add("x16_consolidation", lambda s, d: spec.consolidated(ledger_items(s, d, False, False), read(s, d, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("owner"))),
    f"with {LEDGER_SQL} select c_nationkey as owner, ym, sum(credit_c)::bigint as in_c, sum(debit_c)::bigint as out_c, count(distinct account_id) as accounts from ledger join customer on c_custkey = account_id group by 1, 2")
on_slim("u6_concat_distinct", lambda l: l.where("credit_c > 9000000").select("account_id", "seq").union(l.where("debit_c > 9000000 or credit_c > 10000000").select("account_id", "seq")).distinct().groupBy("account_id").agg(F.count("*").alias("n")), "select account_id, count(*) as n from ledger where credit_c > 9000000 or debit_c > 9000000 group by 1")
on_classified("p16_report_projection", lambda c: c.select("account_id", "seq", "d", "description", (F.col("debit_c") / 100).cast("decimal(18,2)").alias("debit"), (F.col("credit_c") / 100).cast("decimal(18,2)").alias("credit"), "category", "subcategory", "method"),
    "select account_id, seq, d, description, (debit_c / 100.0)::decimal(18,2) as debit, (credit_c / 100.0)::decimal(18,2) as credit, category, subcategory, method from cl")
on_slim("t8_groups_by_total", lambda l: l.groupBy("counterparty").agg(F.sum("debit_c").alias("total_c")).orderBy(F.desc("total_c")), "select counterparty, sum(debit_c)::bigint as total_c from ledger group by 1")

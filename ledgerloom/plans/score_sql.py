"""SQL of the score layer: flags, features and the score, for the queries a43 to a50 and a56."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import score
from ledgerloom.plans import registry
from ledgerloom.plans.recurring import loan_sql
from ledgerloom.plans.registry import CLASSIFIED_SQL, DAILY_SQL, SQL, _DETECTORS, _FLAG, add
from ledgerloom.sources.tables import read

_ONE = "select account_id, '{0}' as detector, '{1}' as severity, {2}::double as confidence, {3} as hits, {4}::bigint as amount_c from "
RAPID_SQL = """side as (select account_id, seq, d, debit_c, credit_c, counterparty, category, upper(subcategory) as sub, regexp_matches(upper(description), 'CAM/|CASH WDL|CWDR|ATW') and not regexp_matches(upper(description), 'UPI|ACH|NEFT|IMPS|RTGS') as cash from cl where not regexp_matches(upper(subcategory || ' ' || description), 'RVSL|REVERSAL|REFUND|RETURN')),
rapid as (select account_id, credit_seq, debit_seq, credit_c, debit_c from (select c.account_id, c.seq as credit_seq, x.seq as debit_seq, c.credit_c, x.debit_c, row_number() over (partition by c.account_id, c.seq order by x.d, x.seq) as r from side c join side x on x.account_id = c.account_id and x.d between c.d and c.d + interval 1 day and x.debit_c > 0 and x.debit_c * 100 between c.credit_c * 85 and c.credit_c * 105 and x.counterparty <> c.counterparty and not (c.cash and x.cash)
and x.category <> 'Investment' and not regexp_matches(x.sub, 'EMI|SIP|MUTUAL FUND|INSURANCE|PPF|NPS|FD|RD|LOAN|RENT|CREDIT CARD|SECURITIES|TRADING|DIRECT|TAX') and not regexp_matches(x.counterparty, 'EBA_|PPF') where c.credit_c >= 2000000) where r = 1)"""
FLAGS_SQL = (
    RAPID_SQL + ", fl as (" + " union all ".join(_FLAG.format(*x) for x in _DETECTORS)
    + " union all " + _ONE.format("round_amounts", "LOW", 0.65, "h", "a") + "(select account_id, count(*) as n, count(*) filter (where debit_c > 1000000 and debit_c % 100000 = 0) as h, sum(case when debit_c > 1000000 and debit_c % 100000 = 0 then debit_c else 0 end) as a from ledger group by 1) where h >= 5 and h * 4 > n"
    + " union all " + _ONE.format("mad_outlier", "MEDIUM", 0.80, "count(*)", "sum(debit_c)") + "(select *, median(dev) over (partition by account_id) as mad from (select *, abs(debit_c - med) as dev from (select *, median(debit_c) over (partition by account_id) as med, count(*) over (partition by account_id) as n from cl where debit_c > 0))) where n >= 10 and mad > 0 and 0.6745 * dev > 6.0 * mad and not regexp_matches(lower(category), 'investment|debt|loan|tax|insurance|savings|transfer') and not regexp_matches(lower(subcategory), 'loan|emi|sip|mutual|nps|ppf|tax|insurance|direct|card|securities|trading') group by 1 having count(*) >= 3"
    + " union all " + _ONE.format("rapid_pass_through", "HIGH", 0.88, "count(*)", "sum(x)") + "(select account_id, debit_c as x from rapid) group by 1"
    + " union all " + _ONE.format("circular_mirroring", "HIGH", 0.90, "count(*)", "sum(2 * least(i, o))") + "(select account_id, counterparty, sum(credit_c) as i, sum(debit_c) as o from ledger group by 1, 2) where i > 1000000 and o > 1000000 and abs(i - o) * 100 <= greatest(i, o) * 15 group by 1"
    + " union all " + _ONE.format("atm_velocity", "MEDIUM", 0.85, "count(*)", "sum(debit_c)") + "(select *, lead(d, 2) over (partition by account_id order by d, seq) as u from ledger where contains(description, 'CASH WDL') and debit_c >= 2000000) where date_diff('day', d, u) <= 7 group by 1"
    + " union all " + _ONE.format("concentration", "MEDIUM", 0.72, "1", "m") + "(select account_id, max(v) as m, sum(v) as t from (select account_id, counterparty, sum(debit_c) as v from ledger where debit_c > 0 group by 1, 2) group by 1) where m * 100 > t * 45"
    + " union all " + _ONE.format("cash_vs_salary", "MEDIUM", 0.80, "1", "c") + "(select account_id, sum(case when contains(description, 'CASH WDL') then credit_c else 0 end) as c, sum(case when description like 'SALARY%' then credit_c else 0 end) as s from ledger group by 1) where s > 0 and c * 2 > s * 3"
    + " union all " + _ONE.format("equal_flows", "LOW", 0.75, "1", "i") + "(select account_id, count(*) as n, sum(credit_c) as i, sum(debit_c) as o from ledger group by 1) where n >= 15 and i > 10000000 and abs(i - o) * 50 < i),"
    + """ fs as (select account_id, least(100.0, sum(case severity when 'LOW' then 2.5 when 'MEDIUM' then 6 when 'HIGH' then 15 else 35 end * confidence))::double as raw, sum(case severity when 'LOW' then 15 when 'MEDIUM' then 40 when 'HIGH' then 85 else 200 end)::double as points, count(*) filter (where severity in ('HIGH', 'CRITICAL')) as high_flags, count(*) as flags from fl group by 1),
fr as (select account_id, round(raw, 3) as fraud_score, case when raw >= 65 then 'CRITICAL' when raw >= 40 then 'HIGH' when raw >= 20 then 'MEDIUM' else 'LOW' end as risk, round(points * case when high_flags >= 3 then 1.25 else 1.0 end)::bigint as penalty_points, high_flags, flags from fs)"""
)
INCOME_TEST = "category = 'Income' and subcategory <> 'Refund' and not is_return"
FEATURES_SQL = (
    CLASSIFIED_SQL + ", " + FLAGS_SQL + ", " + DAILY_SQL.format(t="ledger") + ", " + loan_sql("ledger", "true")
    + f""", ba as (select account_id, neg as negative_days, round(case when a <= 0 then 1.0 else least(greatest(coalesce(s, 0) / a, 0), 1) end::double, 4) as volatility, round(t::double / days)::bigint as mean_balance_c from (select account_id, count(*) as days, sum(balance_c) as t, count(*) filter (where balance_c < 0) as neg, stddev_samp(balance_c) as s, avg(balance_c) as a from daily group by 1)),
mo as (select account_id, ym, sum(credit_c - debit_c) as raw, sum(case when contains(lower(category), 'investment') or regexp_matches(lower(subcategory), 'sip|mutual|nps|ppf|securities|trading') then debit_c else 0 end) as put from cl group by 1, 2),
mv as (select account_id, ym, raw + case when sum(put) over (partition by account_id) > 0 then put else 0 end as net_c from mo),
tr as (select account_id, case when n < 2 then 'STABLE' when s > 50000 and late = 0 then 'POSITIVE' when s < -50000 or late >= 2 then 'NEGATIVE' else 'STABLE' end as trajectory from (select account_id, count(*) as n, coalesce(regr_slope(net_c, x), 0) as s, count(*) filter (where r <= 2 and net_c < 0) as late from (select *, row_number() over (partition by account_id order by ym) - 1 as x, row_number() over (partition by account_id order by ym desc) as r from mv) group by 1)),
inv as (select account_id, debit_c, dayofmonth(d) as dom, ym, subcategory, sum(case when dayofmonth(d) - lag_dom > 3 then 1 else 0 end) over (partition by account_id, debit_c order by dayofmonth(d), seq) as cluster from (select *, lag(dayofmonth(d)) over (partition by account_id, debit_c order by dayofmonth(d), seq) as lag_dom from cl where category = 'Investment' and debit_c > 0)),
sp as (select account_id, count(*) as sip_count from (select account_id, debit_c, cluster from inv group by 1, 2, 3 having count(distinct ym) >= 3) group by 1),
lt as (select account_id, round((sum(case subcategory when 'Dividend' then 3 else 3 end * debit_c)::double / sum(debit_c)) / 10, 4) as long_term from inv group by 1),
di as (select account_id, round(sum(n) * 100.0::double / (sum(n) + sum(missed)) + 1e-9, 2) as discipline_pct from ln group by 1),
am as (select account_id, case when x <= 25 then 'LOW' when x <= 50 then 'MODERATE' when x <= 75 then 'HIGH' else 'CRITICAL' end as aml_band from (select account_id, round(least(100, 0.85::double * fraud_score + 15 * c + 10 * s) + 1e-9, 2) as x from fr join (select account_id, count(*) filter (where detector = 'circular_mirroring') as c, count(*) filter (where detector in ('structuring', 'high_structuring')) as s from fl group by 1) using (account_id))),
fe as (select b.*, negative_days, volatility, mean_balance_c, trajectory, coalesce(fraud_score, 0) as fraud_score, coalesce(penalty_points, 0) as penalty_points, coalesce(high_flags, 0) as high_flags, coalesce(sip_count, 0) as sip_count, coalesce(long_term, 0) as long_term, coalesce(discipline_pct, 100) as discipline_pct, coalesce(aml_band, 'LOW') as aml_band, 0.0::double as bounce_rate
from (select account_id, date_diff('day', min(d), max(d)) as history_days, count(*) filter (where contains(description, 'RETURN CHARGES')) as bounces, sum(case when category = 'Investment' then debit_c else 0 end)::bigint as invested_c, sum(credit_c)::bigint as turnover_c, sum(case when {INCOME_TEST} then credit_c else 0 end)::bigint as income_c, sum(case when {INCOME_TEST} and subcategory = 'Salary' then credit_c else 0 end)::bigint as salary_c, count(distinct ym) filter (where {INCOME_TEST}) as income_months,
round(sum(case when subcategory = 'Loan EMI' then debit_c else 0 end)::double / nullif(sum(case when category <> 'Transfer' and not is_return then credit_c else 0 end), 0), 4) as foir from cl group by 1) b join ba using (account_id) join tr using (account_id) left join fr using (account_id) left join sp using (account_id) left join lt using (account_id) left join di using (account_id) left join am using (account_id))"""
)
_STEPS = {
    "discipline": "case when discipline_pct < 70 then -250 when discipline_pct < 90 then -100 else 0 end",
    "foir": "case when foir > 0.75 then -180 when foir > 0.60 then -90 when foir > 0.45 then -40 else 0 end",
    "volatility": "case when volatility >= 0.90 then case when mean_balance_c >= 10000000 then -140 else -160 end when volatility > 0.70 then case when mean_balance_c >= 10000000 then -80 else -120 end when volatility > 0.45 then case when mean_balance_c >= 10000000 then -30 else -60 end when volatility > 0.20 then case when mean_balance_c >= 10000000 then -10 else -20 end else 0 end",
    "penalties": "-(least(greatest(penalty_points, 0), 700) + case when high_flags >= 3 then 100 else 0 end)",
    "negative_days": "case when negative_days > 0 then -least(150, 60 + 20 * negative_days) else 0 end",
    "bounces": "case when bounces >= 2 or bounce_rate > 10 then -150 when bounces = 1 then -60 else 0 end",
    "trajectory": "case trajectory when 'POSITIVE' then 20 when 'NEGATIVE' then -40 else 0 end",
    "investments": "case when invested_c >= 20000000 or (income_c > 0 and invested_c::double / nullif(income_c, 0) >= 0.15) then 50 when invested_c >= 5000000 or sip_count >= 3 or long_term >= 0.5 then 30 else 0 end",
}
DECISION_SQL = (
    "st as (select *, " + ", ".join(f"({sql})::bigint as s{i}" for i, sql in enumerate(_STEPS.values(), 1)) + " from fe), sw as (select *, 1000 + " + " + ".join(f"s{i}" for i in range(1, len(_STEPS) + 1)) + " as t from st)"
    + """, sc as (select *, greatest(0, least(1000, case when history_days < 90 then least(t, 720) else t end))::bigint as raw from sw),
de as (select *, case when aml_band = 'CRITICAL' or fraud_score >= 50 then 'REJECT_FRAUD_DETECTED' when aml_band = 'HIGH' then 'REJECT_HIGH_AML_RISK' when bounces >= 2 then 'REJECT_REPAYMENT_DEFAULT' when high_flags >= 3 then 'REJECT_MULTIPLE_IRREGULARITIES' when raw >= 800 then 'APPROVE_FAST_TRACK' when raw >= 650 then 'APPROVE_STANDARD' when raw >= 500 then 'MANUAL_REVIEW' when raw >= 300 then 'REJECT' else 'DECLINE' end as decision from sc),
dd as (select *, case decision when 'REJECT_FRAUD_DETECTED' then null when 'REJECT_HIGH_AML_RISK' then least(raw, 450) when 'REJECT_REPAYMENT_DEFAULT' then least(raw, 450) when 'REJECT_MULTIPLE_IRREGULARITIES' then least(raw, 480) else raw end as score,
case decision when 'REJECT_FRAUD_DETECTED' then 'CRITICAL_FRAUD_RISK' when 'APPROVE_FAST_TRACK' then 'VERY_LOW_RISK' when 'APPROVE_STANDARD' then 'LOW_RISK' when 'MANUAL_REVIEW' then 'MODERATE_RISK' when 'DECLINE' then 'VERY_HIGH_RISK' else 'HIGH_RISK' end as band from de)"""
)
_PV = "(case when {0} > 0 then round({0} * (1 - pow(1 + {1} / 1200, -{2})) / ({1} / 1200)) else 0 end)"
_EMI = "(case when {0} > 0 then round({0} * ({1} / 1200) * pow(1 + {1} / 1200, {2}) / (pow(1 + {1} / 1200, {2}) - 1)) else 0 end)"
_TEN = "(round_even(({0}) / 1000000, 0) * 1000000)"
#: From `el0`: the inputs of the sizing with decision and score.
ELIGIBILITY_SQL = f"""e1 as (select *, coalesce(income_c::double / nullif(income_months, 0), 0) as monthly, greatest(coalesce(foir, 0), 0)::double as owed, income_c > 0 and salary_c * 2 >= income_c as salaried, decision like 'REJECT%' or decision like 'DECLINE%' as no, coalesce(score, 750) as sco from el0),
e2 as (select *, case when salaried then case when monthly >= 10000000 then 0.60::double else 0.50::double end else 0.65::double end as cap, case when salaried then 12.0::double else 13.5::double end as rate0, case when not salaried and volatility_band in ('HIGH', 'SEVERE') then 36 else 48 end as months, greatest(turnover_c * 0.18::double, mean_balance_c * 3.0::double) as trade from e1),
e3 as (select *, monthly * greatest(cap - owed, 0) as room from e2),
e4 as (select *, {_TEN.format("case when salaried then " + _PV.format("room", "12.0::double", "48") + " else trade end")} as base, {_TEN.format("case when salaried then " + _PV.format("room", "12.0::double", "60") + " else trade * 1.25::double end")} as lim from e3),
e5 as (select *, case when base > 0 and liquid_c >= base * 1.5::double then 'STRONG' when base > 0 and liquid_c >= base * 0.5::double then 'MODERATE' else 'LIMITED' end as cushion from e4),
e6 as (select *, greatest(9.5, rate0 - case cushion when 'STRONG' then 0.5 when 'MODERATE' then 0.25 else 0 end)::double as rate, {_TEN.format("base * (1.0::double + case cushion when 'STRONG' then 15.0::double when 'MODERATE' then 5.0::double else 0 end / 100.0::double)")} as raised, greatest(case when bounces >= 2 then 80 when bounces = 1 then 20 else 0 end, case when sco < 500 then 70 when sco < 650 then 25 else 0 end)::double as cut from e5),
e7 as (select *, {_TEN.format("raised * (1.0::double - cut / 100.0::double)")} as o1, greatest(monthly, turnover_c / 12.0::double, 100) as earning from e6),
e8 as (select *, least(o1, case when bounces >= 2 then 5000000 else o1 end, case when requested_c > 0 then {_TEN.format("requested_c")} else o1 end) as offer, greatest(0, (cap - owed) * earning) as spare from e7),
e9 as (select *, case when offer > 0 and {_EMI.format("offer", "rate", "months")} > spare then least(offer, {_TEN.format(_PV.format("spare", "rate", "months"))}) else offer end as fin from e8),
el as (select account_id, case when no then 'NO_FACILITY' when fin > 0 then 'SIZED' else 'NO_HEADROOM' end as status, case when no then 'Not assessed' when salaried then 'Salaried' else 'MSME_Self_Employed' end as borrower, case when no then 0 else fin end::bigint as offer_c, case when no then 0 else greatest(lim, fin) end::bigint as limit_c, case when no then null else months end::bigint as months,
case when no then 0 else {_EMI.format("fin", "rate", "months")} end::bigint as emi_c, case when no then null else rate end as rate, case when no or fin <= 0 then 'No facility recommended' when salaried then 'Unsecured Personal Loan' when volatility_band = 'LOW' then 'MSME Working Capital Dropline Overdraft' else 'MSME Business Term Loan' end as product,
case when no then null else cushion end as cushion, case when no then null else cut end as cut_pct, case when no then null else round(owed + {_EMI.format("fin", "rate", "months")} / earning + 1e-9, 4) end as foir_after from e9)"""
_SCORED = "select account_id, raw, score, decision, band from dd"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) > 1))"
SQL["c19_fuzzy_top1"] = f"""with {registry.LEDGER_SQL}, n as (select name, {_WORDS.format("name")} as nw from (values ('red widget shop'), ('hot ring'), ('employer payroll services')) v(name)),
t as (select distinct description, {_WORDS.format("description")} as tw from ledger),
p as (select description, name, round(len(list_intersect(tw, nw))::double / least(len(tw), len(nw)), 4) as score from t join n on list_has_any(tw, nw)),
m as (select description, arg_max((name, score), (score, length(name), name)) as m from p where score >= 0.5 group by 1)
select m[1] as name, m[2]::double as score, count(*) as n from m group by 1, 2"""

SQL["j2_rapid_transfer"] = f"with {CLASSIFIED_SQL}, {RAPID_SQL} select * from rapid"
SQL["a43_fraud_score"] = f"with {CLASSIFIED_SQL}, {FLAGS_SQL} select * from fr"
SQL["a44_aml_score"] = f"with {CLASSIFIED_SQL}, {FLAGS_SQL}, sx as (select account_id, round(least(100, 0.85::double * fraud_score + 15 * c + 10 * s) + 1e-9, 2)::double as aml_score from fr join (select account_id, count(*) filter (where detector = 'circular_mirroring') as c, count(*) filter (where detector in ('structuring', 'high_structuring')) as s from fl group by 1) using (account_id)) select *, case when aml_score <= 25 then 'LOW' when aml_score <= 50 then 'MODERATE' when aml_score <= 75 then 'HIGH' else 'CRITICAL' end as aml_band from sx"
SQL["a47_composite_score"] = f"with recursive {FEATURES_SQL}, {DECISION_SQL} {_SCORED}"
SQL["a49_itemised_score"] = f"with recursive {FEATURES_SQL}, {DECISION_SQL} " + " union all ".join(f"select account_id, '{n}' as step, s{i} as points from st" for i, n in enumerate(_STEPS, 1))
SQL["a50_eligibility"] = f"with recursive {FEATURES_SQL}, {DECISION_SQL}, el0 as (select *, case when volatility < 0.15 then 'LOW' when volatility < 0.40 then 'MODERATE' when volatility < 0.70 then 'HIGH' else 'VERY_HIGH' end as volatility_band, invested_c as liquid_c, null::bigint as requested_c from dd), {ELIGIBILITY_SQL} select * from el"
SQL["a56_result_gate"] = f"with recursive {FEATURES_SQL}, {DECISION_SQL}, bad as (select account_id, count(*) filter (where (debit_c > 0) = (credit_c > 0)) as n from ledger group by 1) select account_id, case when n = 0 then score end as score, case when n = 0 then decision else 'INTEGRITY_REVIEW' end as decision from dd join bad using (account_id)"

#: Inputs of the score for each customer that reach every rung; valid in Spark and in DuckDB.
CASES = """select k as account_id, cast(case k % 4 when 0 then 100 when 1 then 95 when 2 then 80 else 60 end as double) as discipline_pct, cast(k * 7 % 90 as double) / 100 as foir, cast(k * 13 % 100 as double) / 100 as volatility, k * 310007 % 20000000 as mean_balance_c, case when k % 3 = 0 then k * 17 % 800 else 0 end as penalty_points, case when k % 7 = 0 then 4 else k % 3 end as high_flags,
case when k % 11 = 0 then k % 7 else 0 end as negative_days, case k % 13 when 0 then 2 when 1 then 1 else 0 end as bounces, cast(case when k % 17 = 0 then 12.5 else 0 end as double) as bounce_rate, case k % 3 when 0 then 'POSITIVE' when 1 then 'NEGATIVE' else 'STABLE' end as trajectory, (k * 997 % 300) * 100000 as invested_c, (k * 331 % 900) * 2000000 as income_c, (k * 331 % 900) * (k % 4) * 500000 as salary_c,
1 + k % 12 as income_months, k % 6 as sip_count, cast(k % 10 as double) / 10 as long_term, k * 3 % 400 as history_days, cast(case when k % 19 = 0 then 55 else k % 50 end as double) as fraud_score, case when k % 10 = 0 then 'HIGH' when k % 20 = 1 then 'CRITICAL' else 'LOW' end as aml_band, (k * 613 % 5000) * 100000 as turnover_c,
case k % 5 when 0 then 'LOW' when 1 then 'MODERATE' when 2 then 'HIGH' when 3 then 'SEVERE' else 'MODERATE' end as volatility_band, (k * 71 % 700) * 1000000 as liquid_c, case when k % 5 = 0 then (k % 9) * 10000000 end as requested_c from (select c_custkey as k from customer)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CASES.replace("from customer", "from {customer}"), customer=read(spark, sf_dir, "customer"))


def _sized(f: DataFrame) -> DataFrame:
    return score.eligibility(f.join(score.composite(f).select("account_id", "score", "decision"), "account_id"))


add("a47b_score_rules", lambda s, d: score.composite(cases(s, d)).drop("items"), f"with fe as ({CASES}), {DECISION_SQL} {_SCORED}")
add("a49b_score_items", lambda s, d: score.itemised(score.composite(cases(s, d))), f"with fe as ({CASES}), {DECISION_SQL} " + " union all ".join(f"select account_id, '{n}' as step, s{i} as points from st" for i, n in enumerate(_STEPS, 1)))
add("a50b_eligibility_rules", lambda s, d: _sized(cases(s, d)), f"with fe as ({CASES}), {DECISION_SQL}, el0 as (select * from dd), {ELIGIBILITY_SQL} select * from el")

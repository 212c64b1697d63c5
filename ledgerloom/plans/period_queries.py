"""Queries of the month sheet and of trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import labels, periods
from ledgerloom.plans.registry import add, ledger_events, on_classified, on_ledger
from ledgerloom.sources.tables import EVENTS_SQL

_HALF = lambda t, n: f"(2 * {t} + {n} - ((2 * {t} + {n}) % (2 * {n}) + 2 * {n}) % (2 * {n})) // (2 * {n})"
_SHEET = {
    "opening": "arg_min(balance_c + debit_c - credit_c, seq)", "closing": "arg_max(balance_c, seq)", "debits": "sum(debit_c)", "credits": "sum(credit_c)", "n_debits": "count(*) filter (where debit_c > 0)", "n_credits": "count(*) filter (where credit_c > 0)", "net": "sum(credit_c) - sum(debit_c)",
    "lowest": "min(balance_c)", "highest": "max(balance_c)", "average": _HALF("sum(balance_c)::bigint", "count(*)"), "salary": "sum(case when contains(subcategory, 'Salary') then credit_c else 0 end)", "obligations": "sum(case when contains(subcategory, 'EMI') or contains(subcategory, 'Loan') then debit_c else 0 end)",
    "investments": "sum(case when category = 'Investment' then debit_c else 0 end)", "cash_in": "sum(case when contains(subcategory, 'Cash') then credit_c else 0 end)", "cash_out": "sum(case when contains(subcategory, 'Cash') then debit_c else 0 end)",
    "n_cash_in": "count(*) filter (where contains(subcategory, 'Cash') and credit_c > 0)", "n_cash_out": "count(*) filter (where contains(subcategory, 'Cash') and debit_c > 0)", "cheque_in": "sum(case when contains(subcategory, 'Cheque') then credit_c else 0 end)",
    "cheque_out": "sum(case when contains(subcategory, 'Cheque') then debit_c else 0 end)", "n_self": "count(*) filter (where contains(subcategory, 'Self Transfer'))", "interest_in": "sum(case when contains(subcategory, 'Interest') then credit_c else 0 end)", "interest_out": "sum(case when contains(subcategory, 'Interest') then debit_c else 0 end)",
}
_MONTHS = "select account_id, ym, " + ", ".join(f"({v})::bigint as {k}" for k, v in _SHEET.items()) + " from cl group by account_id, ym"
_TOTALS = "select cl.account_id, 'Total' as ym, " + ", ".join(f"({'any_value(mean_c)' if k == 'average' else v})::bigint as {k}" for k, v in _SHEET.items()) + f" from cl join (select account_id, {_HALF('sum(average)::bigint', 'count(*)')} as mean_c from mo group by 1) using (account_id) group by 1"
on_classified("a57b_month_sheet", periods.month_sheet, f"unpivot (select * from mo union all {_TOTALS}) on {', '.join(_SHEET)} into name measure value value", f"mo as ({_MONTHS})")

_KIND = "case when contains(upper(description), 'CASH WDL') then 'CASH' " + " ".join(f"when regexp_matches(lower(description), '{'|'.join(ws)}') then '{n}'" for n, ws in labels.TAXONOMY) + " else 'OTHER' end"
_R = "round(coalesce({}::double / nullif({}, 0), 0), 4)"


def _windows_sql(rows: str, night: str, days: tuple[int, ...] = periods.DAYS) -> str:
    """rows: a relation with account_id, d, debit_c, credit_c, kind, is_cash and is_night."""
    one = lambda n: f"""select account_id, {n} as days, sum(debit_c)::bigint as out_c, sum(credit_c)::bigint as in_c, sum(case when kind = 'WANTS' then debit_c else 0 end)::bigint as wants_c, sum(case when kind = 'NEEDS' then debit_c else 0 end)::bigint as needs_c,
sum(case when kind = 'INVESTMENT' then debit_c else 0 end)::bigint as invested_c, {_R.format("sum(case when dayofweek(d) in (0, 6) then debit_c else 0 end)", "sum(debit_c)")} as weekend_ratio, {night} as night_ratio, {_R.format("sum(case when is_cash then debit_c else 0 end)", "sum(debit_c)")} as cash_ratio,
{_R.format("sum(case when kind = 'WANTS' then debit_c else 0 end)", "sum(case when kind = 'NEEDS' then debit_c else 0 end)")} as wants_to_needs, (sum(credit_c) - sum(debit_c))::bigint as saved_c from (select *, max(d) over (partition by account_id) as last_d from {rows}) where date_diff('day', d, last_d) <= {n} group by account_id"""  # noqa: E731
    return " union all ".join(one(n) for n in days)


_BEHAVED = f"bh as (select account_id, d, ym, debit_c, credit_c, {_KIND} as kind, regexp_matches(upper(description), 'CAM/|CASH WDL|CWDR|ATW') as is_cash, false as is_night from ledger), wi as ({_windows_sql('bh', 'null::double')})"
_NIGHT = "case when sum(debit_c) > 0 then round(sum(case when is_night then debit_c else 0 end)::double / sum(debit_c), 4) end"
_DRIFT = "select account_id, (max(wants_c) filter (where days = 30) - max(wants_c) filter (where days = 365))::bigint as wants_drift_c, round(max(weekend_ratio) filter (where days = 30) - max(weekend_ratio) filter (where days = 365), 4) as weekend_drift, round(max(night_ratio) filter (where days = 30) - max(night_ratio) filter (where days = 365), 4) as night_drift, (max(saved_c) filter (where days = 30) - max(saved_c) filter (where days = 365))::bigint as saved_drift_c from wi group by 1"


def _on_ledger(rows: DataFrame) -> DataFrame:
    return periods.trailing(rows, labels.taxonomy(F.col("description")), text.rail(F.col("description")) == "ATM_CASH")


def _on_events(rows: DataFrame) -> DataFrame:
    """Nights are from nine in the evening to five in the morning."""
    kind = F.when(F.col("kind") == "view", "WANTS").when(F.col("kind") == "click", "NEEDS").otherwise("OTHER")
    return periods.trailing(rows, kind, F.col("kind") == "view", (F.hour("ts") >= 21) | (F.hour("ts") < 5), (7, 30, 365))


_EV = "bh as (select account_id, d, debit_c, credit_c, case kind when 'view' then 'WANTS' when 'click' then 'NEEDS' else 'OTHER' end as kind, kind = 'view' as is_cash, hour(ts) >= 21 or hour(ts) < 5 as is_night from ev)"
on_ledger("a31b_trailing_windows", _on_ledger, "select * from wi", _BEHAVED)
on_ledger("a33b_drift", lambda l: periods.drift(_on_ledger(l)), _DRIFT, _BEHAVED)
add("a31c_windows_with_nights", lambda s, d: _on_events(ledger_events(s, d)), f"with {EVENTS_SQL}, {_EV} {_windows_sql('bh', _NIGHT, (7, 30, 365))}")
on_ledger("a33c_wants_trend", lambda l: periods.wants_trend(l.groupBy("account_id", "ym").agg(F.sum(F.when(labels.taxonomy(F.col("description")) == "WANTS", F.col("debit_c")).otherwise(0)).alias("wants_c"))),
    "select account_id, round(g, 4) as growth, case when g > 0.15 then 'INCREASING' when g < -0.15 then 'DECREASING' else 'STABLE' end as trend from (select account_id, case when max(w) filter (where n = 2) > 0 then (max(w) filter (where n = 1) - max(w) filter (where n = 2))::double / max(w) filter (where n = 2) else 0.0 end as g from (select *, row_number() over (partition by account_id order by ym desc) as n from (select account_id, ym, sum(case when kind = 'WANTS' then debit_c else 0 end)::bigint as w from bh group by 1, 2)) where n <= 2 group by 1)", _BEHAVED)

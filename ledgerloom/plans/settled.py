"""Queries of what settles labels, over statement rows and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import cascade, labels, settle
from ledgerloom.plans.registry import add, on_ledger
from ledgerloom.plans.statements import _CASE_PAYEE, _ID, _LABELS, _NAMED_ROWS, classified
from ledgerloom.sources.tables import LEDGER_SQL, ledger_items, read, scratch_dir, shared_copy

#: Overrides made of suppliers: for all accounts, for account s % 7 + 1, and older and newer ones of one key.
OVERRIDES = """select 'SUPPLIER ' || cast(s_suppkey as string) as o_key, cast(null as bigint) as o_account, 'Expense' as o_category, 'Rent' as o_subcategory, 'Need' as o_label, 1 as updated_at from supplier where mod(s_suppkey, 3) = 0
union all select 'SUPPLIER ' || cast(s_suppkey as string), cast(mod(s_suppkey, 7) + 1 as bigint), 'Expense', 'Travel', 'Want', 1 from supplier where mod(s_suppkey, 4) = 0
union all select 'SUPPLIER ' || cast(s_suppkey as string), cast(null as bigint), 'Transfer', 'Family', 'Unknown', 2 from supplier where mod(s_suppkey, 9) = 0"""


def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classified(spark, sf_dir).withColumn("key", F.upper("p.payee"))
    s, name = read(spark, sf_dir, "supplier"), F.concat(F.lit("SUPPLIER "), F.col("s_suppkey").cast("string")).alias("o_key")
    entry = lambda rows, account, c, sub, label, at: rows.select(name, account.cast("long").alias("o_account"), F.lit(c).alias("o_category"), F.lit(sub).alias("o_subcategory"), F.lit(label).alias("o_label"), F.lit(at).alias("updated_at"))
    given = entry(s.where("s_suppkey % 3 = 0"), F.lit(None), "Expense", "Rent", "Need", 1).unionByName(entry(s.where("s_suppkey % 4 = 0"), F.col("s_suppkey") % 7 + 1, "Expense", "Travel", "Want", 1)).unionByName(entry(s.where("s_suppkey % 9 = 0"), F.lit(None), "Transfer", "Family", "Unknown", 2))
    return settle.overridden(found.select(*_ID, "account_id", "key", *cascade.NAMES), given).select(*_ID, *[c for c in cascade.NAMES if c != "merchant"])


_OPEN = ", ".join(f"'{s}'" for s in settle.UNRESOLVED)
_BEGINS = "(k.flat = o.flat or (length(k.flat) >= 6 and length(o.flat) >= 6 and (starts_with(k.flat, o.flat) or starts_with(o.flat, k.flat))))"
add(
    "c30b_prefix_overrides", overridden,
    f"""with {_NAMED_ROWS}, cl as (select {', '.join(_ID)}, account_id, upper({_CASE_PAYEE}) as key, {_LABELS} from named), ov as (select *, replace(o_key, ' ', '') as flat from ({OVERRIDES})), ks as (select distinct key, replace(key, ' ', '') as flat from cl where key <> ''),
met as (select k.key, o.o_account, arg_max({{'c': o_category, 's': o_subcategory, 'l': o_label}}, (updated_at, o_subcategory, o_category, o_label)) as e from ks k join ov o on {_BEGINS} group by 1, 2),
j as (select cl.*, coalesce(a.e, b.e) as e, a.e is not null as own, (subcategory in ({_OPEN}) or subcategory = '') and coalesce(a.e, b.e) is not null as hit from cl left join met a on a.key = cl.key and a.o_account = cl.account_id left join met b on b.key = cl.key and b.o_account is null)
select {', '.join(_ID)}, case when hit then e.c else category end as category, case when hit then e.s else subcategory end as subcategory, case when hit then e.l else needs_wants end as needs_wants, case when hit then 0.99::double else confidence end as confidence,
case when hit then 'counterparty_override' else method end as method, case when hit and own then 'override:applicant' when hit then 'override:global' else rule end as rule from j""",
)
_MAPPED = " ".join(f"when subcategory in ({', '.join(repr(s) for s in group)}) then '{n}'" for n, group in settle.NEEDS_WANTS.items())
add("c32b_needs_wants_map", lambda s, d: classified(s, d).select(*_ID, settle.needs_wants(F.col("category"), F.col("subcategory"), F.col("needs_wants")).alias("label")),
    f"with {_NAMED_ROWS}, cl as (select {', '.join(_ID)}, {_LABELS} from named) select {', '.join(_ID)}, case when category <> 'Expense' then 'Not Applicable' {_MAPPED} when needs_wants in ('Need', 'Want', 'Unknown') then needs_wants else 'Unknown' end as label from cl")

_PAID = "description like 'SALARY%' and account_id % 3 = 0"
on_ledger("a34b_salary_fallbacks", lambda l: settle.salary_cycle(l.select("account_id", "seq", "d", "credit_c", "description", F.col("counterparty").alias("payee")), F.col("description").startswith("SALARY") & (F.col("account_id") % 3 == 0)).withColumn("days", F.size("days").cast("long")),
    f"""select account_id, case when n > 0 then median_c when payee is not null then p_median else mean_c end::double as income_c, n > 0 or payee is not null as detected, case when n > 0 then 'keyword' when payee is not null then 'payee' else 'mean' end as source, case when n = 0 then payee end as payee, case when n > 0 then n else coalesce(pn, 0) end as n, case when n > 0 then n else coalesce(pn, 0) end as days
from (select account_id, count(*) filter (where {_PAID}) as n, median(credit_c) filter (where {_PAID}) as median_c, (2 * sum(credit_c)::bigint + count(*)) // (2 * count(*)) as mean_c from ledger where credit_c > 500000 group by 1)
left join (select account_id, counterparty as payee, n as pn, m as p_median from (select *, row_number() over (partition by account_id order by m desc, counterparty) as k from (select account_id, counterparty, count(*) as n, median(credit_c) as m from ledger where credit_c > 500000 group by 1, 2 having count(*) >= 2)) where k = 1) using (account_id)""")  # fmt: skip


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of last resort for all narrations, of which the first run has seen those of even accounts."""
    l = shared_copy(ledger_items(spark, sf_dir, balance=False).select("account_id", F.col("description").alias("text")), "texts")  # noqa: E741
    path, rule = scratch_dir(spark, "labels"), labels.heuristic(F.col("text"), F.lit(1))
    settle.cached_labels(spark, l.where("account_id % 2 = 0"), path, "1", rule)
    settle.cached_labels(spark, l, path, "1", rule)
    return settle.with_labels(l, path, "1").groupBy("account_id", "label").agg(F.count("*").alias("n"))


add("c24b_cached_labels", cached,
    f"with {LEDGER_SQL} select account_id, case when regexp_matches(upper(description), 'EMI|LOAN|LENDER') then 'Loan EMI' when regexp_matches(upper(description), 'CHARGES|FEE') then 'Banking Charges' when regexp_matches(upper(description), 'SALARY|PAYROLL') then 'Salary' when regexp_matches(upper(description), 'CASH') then 'Cash' else 'Other' end as label, count(*) as n from ledger group by 1, 2")

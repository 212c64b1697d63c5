"""Queries of transfers between accounts. To the ledger's rows some of their own debits are added as another account's
credit of the same amount, on the day, the next or the day before, or on a day too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import transfers
from ledgerloom.plans.registry import add
from ledgerloom.sources.tables import LEDGER_SQL, ledger_items


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_items(spark, sf_dir, narration=False, balance=False, place=True).select((F.col("account_id") % 25).alias("owner"), "account_id", "seq", "d", "debit_c", "credit_c")
    late = F.element_at(F.array(*[F.lit(x) for x in (0, 1, -1, 2)]), (F.pmod(F.col("account_id") + F.col("seq"), F.lit(4)) + 1).cast("int"))
    row = F.struct(*rows.columns)
    moved = F.struct("owner", (F.col("account_id") + 25).alias("account_id"), (F.col("seq") + 1_000_000).alias("seq"), F.date_add("d", late).alias("d"), F.lit(0).cast("long").alias("debit_c"), F.col("debit_c").alias("credit_c"))
    return rows.select(F.inline(F.when(F.expr("debit_c > 0 and seq % 3 = 0"), F.array(row, moved)).otherwise(F.array(row))))


OWNED_SQL = """r0 as (select account_id % 25 as owner, account_id, seq, d, debit_c, credit_c from ledger),
rows_ as (select * from r0 union all select owner, account_id + 25, seq + 1000000, cast(d + to_days(cast([0, 1, -1, 2][(account_id + seq) % 4 + 1] as integer)) as date), 0, debit_c from r0 where debit_c > 0 and seq % 3 = 0),
side0 as (select owner, account_id, seq, d, debit_c + credit_c as amount_c, debit_c > 0 as is_out from rows_ where (debit_c > 0) <> (credit_c > 0))"""
for _k, _offset in enumerate(transfers.OFFSETS):
    OWNED_SQL += f""",
rank{_k} as (select *, d + to_days(case when is_out then {_offset} else 0 end) as day, row_number() over (partition by owner, amount_c, d + to_days(case when is_out then {_offset} else 0 end), is_out order by case when is_out then account_id else -account_id end, seq) as n from side{_k}),
pair{_k} as (select o.owner, o.amount_c, o.account_id as from_account, o.seq as out_seq, o.d as out_d, i.account_id as to_account, i.seq as in_seq, i.d as in_d from rank{_k} o join rank{_k} i on o.owner = i.owner and o.amount_c = i.amount_c and o.day = i.day and o.n = i.n and o.is_out and not i.is_out where o.account_id <> i.account_id),
side{_k + 1} as (select s.* from side{_k} s where not exists (select 1 from pair{_k} p where p.from_account = s.account_id and p.out_seq = s.seq) and not exists (select 1 from pair{_k} p where p.to_account = s.account_id and p.in_seq = s.seq))"""
OWNED_SQL += ",\npairs as (" + " union all ".join(f"select * from pair{k}" for k in range(len(transfers.OFFSETS))) + "), used as (select from_account as account_id, out_seq as seq from pairs union all select to_account, in_seq from pairs)"


add("x8b_matched_transfers", lambda s, d: transfers.match(owned(s, d)), f"with {LEDGER_SQL}, {OWNED_SQL} select * from pairs")
add("x8c_transfer_velocity", lambda s, d: transfers.marked_velocity(transfers.marked(owned(s, d))),
    f"with {LEDGER_SQL}, {OWNED_SQL} select owner, coalesce(t, 0) as transfers, days, round(coalesce(t, 0)::double / days, 6) as per_day from (select owner, date_diff('day', min(d), max(d)) + 1 as days from rows_ group by 1) left join (select owner, count(*) as t from pairs group by 1) using (owner)")
add("x16b_without_transfers", lambda s, d: transfers.months(transfers.marked(owned(s, d)).where("not used")),
    f"with {LEDGER_SQL}, {OWNED_SQL} select owner, strftime(d, '%Y-%m') as ym, sum(credit_c)::bigint as in_c, sum(debit_c)::bigint as out_c, count(distinct account_id) as accounts from rows_ r where not exists (select 1 from used u where u.account_id = r.account_id and u.seq = r.seq) group by 1, 2")

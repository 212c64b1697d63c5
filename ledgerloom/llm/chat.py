"""Chat formatting by a finite-state machine over roles and a declarative template.

Rows of a conversation stream through one pass in order of turn. The machine's state is the last role; it says
whether the next role may follow. Each turn becomes three segments, opening, text and closing, and only text of
roles that the template names bears loss. Control strings inside texts are escaped, so the output can be read
back exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import partitions


@dataclass(frozen=True)
class Template:
    """How a turn is written: open + role + after_role + escaped text + close. `follows`: the roles that may
    come after a role (`None`: at the start); `ends`: those a conversation may end with."""

    open: str = "### "
    after_role: str = ": "
    close: str = " </turn>\n"
    escape: str = "\\"
    control: tuple[str, ...] = ("###", "</turn>")
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str | None, frozenset[str]] = field(default_factory=lambda: {None: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"assistant"})

    def _pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (self.escape, *self.control))))

    def escaped(self, text: str) -> str:
        return self._pattern().sub(lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def shown(self, role: str) -> str:
        """A role's name in the output. One without a name is written as it is, escaped and in brackets."""
        return self.names.get(role) or "[" + re.sub(r"([\\\]])", r"\\\1", self.escaped(role)) + "]"

    def reader(self) -> re.Pattern:
        """One turn of the output."""
        e, c = re.escape(self.escape), re.escape(self.close.strip())
        role = "|".join(map(re.escape, self.names.values())) + rf"|\[(?:{e}.|[^{e}\]])*\]"
        return re.compile(rf"{re.escape(self.open)}({role}){re.escape(self.after_role)}((?:{e}.|(?!{c})[^{e}])*?){re.escape(self.close)}(?={re.escape(self.open)}|\Z)", re.S)

    def parse(self, output: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of an output."""
        back = {v: k for k, v in self.names.items()}
        turns, at, reader = [], 0, self.reader()
        while at < len(output):
            m = reader.match(output, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            role = back.get(m[1])
            turns.append((self.unescaped(self.unescaped(m[1][1:-1])) if role is None else role, self.unescaped(m[2])))
            at = m.end()
        return turns


TEMPLATE = Template()


def segments(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, turn_no, role_ok, segment, loss) of each turn, three segments each: loss flags on the text.

    Rows are ordered by turn, then role, then text; null turns come first. Null roles and texts count as empty
    strings. role_ok says whether the machine lets the role follow the last one. Rows with a null conv_id are
    one conversation. A conversation streams through a task row by row and is never held whole."""
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, turn_no long, role_ok boolean, role string, segments array<struct<segment:string,loss:boolean>>"
    part = pa.struct([("segment", pa.string()), ("loss", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, no = object(), None, 0
        for b in batches:
            rows = []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c != conv:
                    conv, last, no = c, None, 0
                pieces = [{"segment": template.open + template.shown(role) + template.after_role, "loss": False}, {"segment": template.escaped(text), "loss": role in template.loss}, {"segment": template.close, "loss": False}]
                rows.append((c, no, role in template.follows.get(last, ()), role, pieces))
                last, no = role, no + 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(part))], ["conv_id", "turn_no", "role_ok", "role", "segments"])

    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    dealt = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What `segments` (in its order) wrote, parsed turn by turn and hashed as it streams: (conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, valid)."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"conv": object(), "n": 0}

        def done() -> tuple:
            return state["conv"], state["n"], state["turns"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(), state["chars"], state["valid"] and state["role"] in template.ends

        kind = None
        for b in batches:
            kind, rows = b.schema.field(0).type, []
            for c, ok, pieces in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if c != state["conv"]:
                    if state["n"]:
                        rows.append(done())
                    state = {"conv": c, "n": 0, "turns": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "valid": True, "role": None}
                output = "".join(p["segment"] for p in pieces)
                ((role, text),) = template.parse(output)
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["chars"] += len(output)
                state["valid"] &= ok
                state["role"] = role
                for p in pieces:
                    if p["loss"]:
                        plain = template.unescaped(p["segment"])
                        state["loss"] += len(plain)
                        state["loss_sha"].update(plain.encode("utf-8", "surrogatepass"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k or kind) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if state["n"]:
            yield pa.RecordBatch.from_arrays([pa.array([x], k or kind) for x, k in zip(done(), kinds, strict=True)], names)

    ddl = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return formatted.mapInArrow(run, ddl)


def formatted_text(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn_no, text) of each turn as written."""
    return formatted.select("conv_id", "turn_no", F.array_join(F.transform("segments", lambda x: x["segment"]), "").alias("text"))


PROBE = "\\### Assistant: </turn> ok"


def sql() -> str:
    """The query in DuckDB's SQL, from the template's rules."""
    shown = "case role when 'system' then 6 when 'user' then 4 when 'assistant' then 9 else length(role) + 2 end"
    return f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}')
, o as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as from_end from c)
select conv_id, cast(count(*) as bigint) as n_turns,
sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
cast(sum(15 + ({shown}) + length(regexp_replace(text, '(\\\\|###|</turn>)', '\\\\\\1', 'g'))) as bigint) as formatted_chars,
bool_and(case when before is null then role in ('system', 'user') when before in ('system', 'assistant') then role = 'user' else before = 'user' and role = 'assistant' end)
and bool_or(from_end = 1 and role = 'assistant') as valid
from o group by conv_id"""

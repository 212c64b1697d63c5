"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a Parquet table that only
grows, says which rule versions a blob was scanned with and what was found; a scan reads texts of those blobs
alone that lack a rule version, and within them runs only the missing rules. Findings are joined back to all
paths and versions with that content.

Positions come from two native functions that walk the same leftmost matches: split() gives the text between
matches, regexp_extract_all() the matches, and their running lengths are code-point offsets."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import BROADCAST_IDS, fresh_path, materialize


@dataclass(frozen=True)
class Rule:
    """`pattern` is a Java regular expression; with `group`, that group must have `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    #: A text without this string can't match.
    needs: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
#: The base kinds, in the order in which they are listed. A maximal run that is long enough is the same as a
#: run of that many characters or more, so only `assign` needs a length test after the match.
BASE = (
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{20,}", needs="gh"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
)
RULES = BASE + MORE
_SPAN = "array<struct<start:int,stop:int,kind:string>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text: array of (start, stop, kind), code points, stop exclusive."""
    pattern = F.lit(rule.pattern)
    match, between = F.regexp_extract_all(text, pattern, 0), F.split(text, rule.pattern, -1)
    tested = F.regexp_extract_all(text, pattern, rule.group) if rule.group else match
    parts = F.arrays_zip(F.slice(between, 1, F.size(match)).alias("gap"), match.alias("hit"), tested.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.length(x["hit"])
        own = F.array(F.struct(begin.alias("start"), stop.alias("stop"), F.lit(rule.kind).alias("kind")))
        return F.struct(stop.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(parts, start, step)["found"]
    may = (F.contains(text, F.lit(rule.needs)) if rule.needs else F.lit(True)) & text.rlike(rule.pattern)
    return F.when(may, found).otherwise(F.array().cast(_SPAN))


def scan_history(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path_col, blob_id, spans) for each row of `versions` (a row for each version of each path).

    `ledger`: path of the ledger table, made if missing; blobs new to it, or to a rule's version, are scanned
    and appended before the findings are read. A null text counts as empty. Repeated rows stay. spans is
    sorted by start, then by the order of `rules`."""
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = versions.select(F.col(path_col), F.sha2(text, 256).alias("blob_id"))
    _append_unseen(spark, versions.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob_id"), text.alias("text")), ledger, rules)
    current = F.array(*[F.lit(r.version) for r in rules])
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    rows = spark.read.parquet(ledger).where(F.size("found") > 0)
    rows = rows.select("blob_id", F.filter("found", lambda x: F.array_contains(current, x["version"])).alias("found"))
    found = rows.groupBy("blob_id").agg(F.flatten(F.collect_list("found")).alias("found")).select("blob_id", F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("no"), x["stop"].alias("stop"), x["kind"].alias("kind")))).alias("spans"))
    spans = F.transform(F.col("spans"), lambda x: F.struct(x["start"], x["stop"], x["kind"]))
    return named.join(found, "blob_id", "left").select(path_col, "blob_id", F.coalesce(spans, F.array()).cast(_SPAN).alias("spans"))


def _append_unseen(spark: SparkSession, versions: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> None:
    every = F.array(*[F.lit(r.version) for r in rules])
    blobs = versions.groupBy("blob_id").agg(F.min("path").alias("path"))
    try:
        old = spark.read.parquet(ledger)
    except Exception as e:  # noqa: BLE001  the first scan: there is no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = blobs.withColumn("todo", every)
    else:
        seen = old.groupBy("blob_id").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
        todo = blobs.join(seen, "blob_id", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("seen")
    # One row of each blob brings its text; equal rows of one path scan it twice and are put together after.
    todo = todo.withColumnsRenamed({"blob_id": "unseen", "path": "from_path"}).hint("shuffle_hash")
    texts = versions.join(todo, (F.col("blob_id") == F.col("unseen")) & F.col("path").eqNullSafe(F.col("from_path")))

    def tagged(r: Rule) -> Column:
        own = F.transform(spans_of(F.col("text"), r), lambda x: F.struct(x["start"], x["stop"], x["kind"], F.lit(r.version).alias("version")))
        return F.when(F.array_contains("todo", r.version), own).otherwise(F.array().cast("array<struct<start:int,stop:int,kind:string,version:string>>"))

    scanned = texts.select("blob_id", F.col("todo").alias("scanned"), F.concat(*[tagged(r) for r in rules]).alias("found"))
    scanned.dropDuplicates(["blob_id"]).write.mode("append").parquet(ledger)


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with its spans (sorted by start, overlaps allowed) replaced by `mark`."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), more.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """docs with secrets redacted and n_chars set anew where a text changed; every row and column stays.

    Rows are matched to findings by content, so repeated and null doc_ids need no care. While the findings are few
    (BROADCAST_IDS spans) they are broadcast, so texts don't travel for them. Null texts stay null."""
    ledger = ledger or fresh_path(docs.sparkSession, "ledger")
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    found = scan_history(docs.select("doc_id", "text"), ledger, rules).where(F.size("spans") > 0).select("blob_id", "spans").dropDuplicates(["blob_id"])
    found = materialize(found.select(F.col("blob_id").alias("__blob"), F.col("spans").alias("__spans")), "findings")
    few = (found.agg(F.sum(F.size("__spans"))).first()[0] or 0) <= BROADCAST_IDS  # spans are some 40 bytes each
    joined = docs.withColumn("__blob", blob).join(F.broadcast(found) if few else found, "__blob", "left")
    # In a step of its own: inside a lambda, a select's new `text` would come before the old one.
    new = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.coalesce(F.col("__spans"), F.array().cast(_SPAN))))
    done = joined.withColumn("__text", new)
    columns = {"text": F.col("__text"), "n_chars": F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast("long"))}
    return done.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of what scan_history returns: (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    base = [r.kind for r in BASE]
    show = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(show(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of `digest` over `documents`: positions are sums of the lengths of what lies before a match."""
    length = lambda parts: f"coalesce(list_sum(list_transform({parts}, lambda x: length(x))), 0)"
    found = []
    for no, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        cut = f"select r, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {r.group}) as p, string_split_regex(t, '{pattern}') as gaps from d where regexp_matches(t, '{pattern}')"
        one = f"select r, {length('gaps[1:i]')} + {length('m[1:i - 1]')} as start, length(m[i]) as n, p[i] as part from (select *, unnest(range(1, len(m) + 1)) as i from ({cut}))"
        found.append(f"select r, {no} as no, '{r.kind}:' || start::bigint || ':' || (start + n)::bigint as span, start from ({one}) where length(part) >= {r.least}")
    base = " or ".join(f"no = {i}" for i in range(len(BASE)))
    counts = ", ".join(f"count(*) filter (where no = {i}) as n_{r.kind}" for i, r in enumerate(BASE))
    return f"""with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents), s as ({' union all '.join(found)}),
a as (select r, {counts}, string_agg(span, ',' order by start, no) filter (where {base}) as base, string_agg(span, ',' order by start, no) as spans from s group by 1)
select doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (r)"""

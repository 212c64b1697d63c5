"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is cut into literal tokens (runs of letters and digits) and filed under the one that fewest rules
have. The tokens of a URL fetch candidate rules from that index by an equi-join, and only candidates run their
regular expression. All of it is DataFrame expressions; distinct URLs are judged once and the verdicts joined
back."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to which the index is broadcast; a larger list is joined by a shuffle with salted tokens.
BROADCAST_RULES = 20_000
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`text` is `host/path` for a prefix rule: it fits the host and its subdomains where the URL's path starts
    with the rule's. A pattern rule is matched anywhere in host and path; `*` stands for any run and `^` for
    one character that is no letter, digit, `_`, `-`, `.` or `%`, or the end."""

    action: str
    text: str
    prefix: bool = True

    @property
    def regex(self) -> str:
        if self.prefix:
            host, _, path = self.text.partition("/")
            return rf"^([^/]*\.)?{_quoted(host)}/{_quoted(path)}"
        return "".join({"*": ".*", "^": r"([^A-Za-z0-9_.%-]|$)"}.get(c) or _quoted(c) for c in self.text)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every URL fitting the rule has whole: those with a boundary on both sides."""
        if self.prefix:
            # The last token of the path may go on in the URL, and so is none unless a separator follows it.
            return re.findall(r"[a-z0-9]+(?=[^a-z0-9])", self.text.lower())
        return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", self.text.lower())


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s)


#: The rules of the query: prefix rules first decide; where none fits, any blocking pattern blocks.
PREFIX_RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)
PATTERN_RULES = (
    Rule("block", "/ads/", False),
    Rule("block", "/banner/", False),
    Rule("block", ".tracker.", False),
    Rule("block", "/login^", False),
    Rule("block", ".org/de/", False),
    Rule("block", "/wp-admin/", False),
)


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(token, rule, action, regex, prefix): each rule under its rarest token, the longest and then the first
    of equally rare ones; a rule without a token is filed under the empty one, which every URL has."""
    count: dict[str, int] = {}
    for r in rules:
        for t in set(r.tokens):
            count[t] = count.get(t, 0) + 1
    rows = [(min(r.tokens, key=lambda t: (count[t], -len(t), t), default=""), r.text, r.action, r.regex, r.prefix) for r in rules]
    return spark.createDataFrame(rows, "token string, rule string, action string, regex string, prefix boolean")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule] = PREFIX_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of pages.

    Of the prefix rules that fit the longest (then the least in order of text) decides, and `rule` names it;
    where none fits, rule is null and a fitting pattern rule decides (an allowing one before a blocking one,
    named in `pattern`), else `default`. Null urls and those without `://` have empty host and path and get the
    default. Repeated rows stay; an empty table gives an empty result; further columns are not carried."""
    spark = pages.sparkSession
    index = rules_table(spark, rules)
    # Paths are judged without regard to case by tokens only; the regular expressions decide.
    urls = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''").distinct()
    place = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.split(F.lower(place), "[^a-z0-9]+"), F.array(F.lit(""))))
    probes = urls.withColumn("token", F.explode(tokens))
    if len(rules) <= BROADCAST_RULES:
        candidates = probes.join(F.broadcast(index), "token")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        candidates = probes.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), ["token", "salt"])
    fits = candidates.where(F.expr("concat(host, path) rlike regex"))
    # Longest first; of equally long rules the least text: its negated code points compare the other way round.
    best = F.max(F.when(F.col("prefix"), F.struct(F.length("rule").alias("size"), F.translate("rule", "".join(map(chr, range(33, 127))), "".join(map(chr, range(126, 32, -1)))).alias("key"), "rule", "action")))
    other = F.min(F.when(~F.col("prefix"), F.struct("action", "rule")))
    found = fits.groupBy("host", "path").agg(best.alias("best"), other.alias("other"))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Without a host nothing can fit; such rows take no part in the join, which they would make uneven.
    joined = own.where("host <> ''").join(found, ["host", "path"], "left")
    empty = own.where("host = ''").select("*", F.lit(None).cast(found.schema["best"].dataType).alias("best"), F.lit(None).cast(found.schema["other"].dataType).alias("other"))
    return joined.unionByName(empty).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", "other.action", F.lit(default)).alias("verdict"),
        F.when(F.col("best").isNull(), F.col("other.rule")).alias("pattern"),
    )



def sql() -> str:
    """The query in DuckDB's SQL, with each rule as a condition of its own."""
    host = f"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    path = "regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"

    def fits(r: Rule) -> str:
        h, _, p = r.text.partition("/")
        return f"((host = '{h}' or host like '%.{h}') and starts_with(path, '/{p}'))"

    ranked = sorted(PREFIX_RULES, key=lambda r: (-len(r.text), r.text))
    rule = "case " + " ".join(f"when {fits(r)} then '{r.text}'" for r in ranked) + " end"
    action = "case rule " + " ".join(f"when '{r.text}' then '{r.action}'" for r in ranked) + " end"
    pattern = "case " + " ".join(f"when regexp_matches(host || path, '{r.regex}') then '{r.text}'" for r in sorted(PATTERN_RULES, key=lambda r: (r.action, r.text))) + " end"
    return f"""with u as (select page_id, {host} as host, {path} as path from pages),
r as (select *, {rule} as rule from u),
p as (select *, case when rule is null and host <> '' then {pattern} end as pattern from r)
select page_id, host, path, rule, coalesce({action}, case when pattern is not null then 'block' end, 'allow') as verdict, pattern from p"""

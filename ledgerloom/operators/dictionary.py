"""Keyword dictionaries of any size up to a checked one, matched where rows stand.

All keywords, and the strings that exclude or are required by some, are one multi-pattern automaton: a table of
transitions by node and class of character, as integer arrays that are broadcast once. A batch of narrations steps
through it side by side, one array look-up for each position, so the cost of a row follows its length and not the
number of keywords, and rows never travel. A hit then has to stand between characters that are no letters or digits;
keywords of several words are also looked for in the narration without blanks, where handles run words together."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a dictionary's transitions that may be broadcast, and entries that the driver may read from a table.
MOST_BYTES, MOST_ENTRIES = 256 << 20, 200_000
#: Fixed: what a narration loses before words that run together are looked for.
SQUASHED = re.compile(r"[\s\-_.]")
#: The same for Arrow, whose blanks are fewer.
_SQUASHED = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\\-_.]"

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_KEPT = np.ones(256, bool)
_KEPT[[*range(0x09, 0x0E), *range(0x1C, 0x21), *b"-_."]] = False
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[0x61:0x7B] -= 32


class Automaton:
    """Finds every place at which one of the patterns (distinct byte strings, not empty) ends."""

    def __init__(self, patterns: list[bytes]) -> None:
        used = sorted({b for p in patterns for b in p})
        self.classes = np.zeros(256, np.int32)  # 0: a byte that no pattern has
        self.classes[used] = np.arange(1, len(used) + 1)
        self.lengths = np.fromiter(map(len, patterns), np.int64, len(patterns))
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        depth, ends = [0], [-1]
        for i, p in enumerate(patterns):
            at = 0
            for c in self.classes[list(p)].tolist():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    ends.append(-1)
                at = children[at][c]
            ends[at] = i
        if len(children) * width * 4 > MOST_BYTES:
            raise ValueError(f"{len(children)} nodes of {width} classes are too many to broadcast")
        self.table, self.ends = np.zeros((len(children), width), np.int32), np.array(ends, np.int64)
        fail, self.link = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
        # Level by level: a node goes where the longest shorter pattern's beginning goes, but for its own children.
        for node in np.argsort(depth, kind="stable").tolist():
            back = int(fail[node])
            if node:
                self.table[node] = self.table[back]
                self.link[node] = back if self.ends[back] >= 0 else self.link[back]
            for c, child in children[node].items():
                fail[child] = self.table[back, c] if node else 0
                self.table[node, c] = child
        #: Where a node's patterns begin to be told: itself, a shorter pattern that ends it, or none (0).
        self.told = np.where(self.ends >= 0, np.arange(len(children)), self.link)

    def hits(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, end, pattern) for texts at buf[start:start + size], ends exclusive and within the text."""
        order = np.argsort(-size, kind="stable")
        begin, longest = start[order], size[order]
        active = np.searchsorted(-longest, -np.arange(1, int(longest[0]) + 1 if len(longest) else 1), side="right")
        cls, state = self.classes[buf], np.zeros(len(order), np.int32)
        table, width, any_ = self.table.reshape(-1), self.table.shape[1], self.told > 0
        rows, places, found = [], [], []
        for i, m in enumerate(active):
            state = table[state[:m] * width + cls[begin[:m] + i]]
            row = np.flatnonzero(any_[state])
            at = self.told[state[row]]
            while len(row):
                rows.append(order[row])
                places.append(np.full(len(row), i + 1))
                found.append(self.ends[at])
                at = self.link[at]
                row, at = row[at > 0], at[at > 0]
        if not rows:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(rows), np.concatenate(places), np.concatenate(found)


def _packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts) + b"\0", np.uint8), np.cumsum(size) - size, size


def _of_arrow(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _packed, off the array's own buffers; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    return np.append(data, np.uint8(0)), edge[:-1] - edge[0], np.diff(edge)


def _squash(texts: pa.Array, raw: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`raw`, the bytes of texts, without what SQUASHED drops: a mask over bytes, unless some are no ASCII."""
    buf, start, size = raw
    if (buf > 0x7F).any():
        return _of_arrow(pc.replace_substring_regex(texts, _SQUASHED, ""))
    keep = _KEPT[buf]
    edge = np.r_[0, np.cumsum(keep)]
    return np.append(buf[:-1][keep[:-1]], np.uint8(0)), edge[start], edge[start + size] - edge[start]


@dataclass
class Dictionary:
    """Entries (keyword, category, subcategory, needs or wants), in order of preference among equally long ones.
    `excluded`, `required`: by keyword (upper case), strings none of which and at least one of which a narration has
    to hold. Only ASCII letters are compared without case. A keyword's length counts with the blanks around it."""

    entries: list[tuple[str, str, str, str]]
    excluded: dict[str, list[str]] = field(default_factory=dict)
    required: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        plain = lambda s: _UPPER[np.frombuffer(s.encode(), np.uint8)].tobytes()
        spelled = [plain(e[0].strip(" ")) for e in self.entries]
        marks = [plain(m) for d in (self.excluded, self.required) for ms in d.values() for m in ms]
        self.patterns = list(dict.fromkeys(p for p in (*spelled, *marks) if p))
        number = {p: i for i, p in enumerate(self.patterns)}
        self.whole = Automaton(self.patterns)
        joined = list(dict.fromkeys(s.replace(b" ", b"") for s in spelled if b" " in s))
        at = {p: i for i, p in enumerate(joined)}
        self.squashed = Automaton(joined)
        #: Of each pattern, whole and squashed: the entries it stands for.
        self._of = ([[] for _ in self.patterns], [[] for _ in joined])
        for i, s in enumerate(spelled):
            if s:
                self._of[0][number[s]].append(i)
                if b" " in s:
                    self._of[1][at[s.replace(b" ", b"")]].append(i)
        self._flat = [(np.fromiter(map(len, of), np.int64, len(of)), np.array([i for x in of for i in x], np.int64)) for of in self._of]
        upper = [e[0].strip(" ").upper() for e in self.entries]
        self._excluded = {i: [number[plain(m)] for m in self.excluded[u]] for i, u in enumerate(upper) if u in self.excluded}
        self._required = {i: [number[plain(m)] for m in self.required[u]] for i, u in enumerate(upper) if u in self.required}
        self.category = [e[1] for e in self.entries]
        self._kind = np.unique(self.category, return_inverse=True)[1].astype(np.int64)
        self.rank = sorted(range(len(self.entries)), key=lambda i: (-len(self.entries[i][0]), i))
        self._place = np.argsort(self.rank)
        kinds = ("keyword", "k_category", "k_subcategory", "k_label")
        self.values = pa.StructArray.from_arrays([*(pa.array([e[k] for e in self.entries], pa.string()) for k in range(4)), pa.array(self._place.astype(np.int32))], [*kinds, "rank"])

    def _standing(self, part: int, automaton: Automaton, packed: tuple[np.ndarray, np.ndarray, np.ndarray], hits: tuple[np.ndarray, np.ndarray, np.ndarray], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of the hits of patterns with no letter or digit before them and, if `right`, after."""
        buf, start, size = packed
        row, end, pattern = hits
        begin = start[row] + end - automaton.lengths[pattern]
        stop = start[row] + end
        own = lambda at: _ALNUM[buf[at]]
        before = (begin > start[row]) & _ALNUM[buf[np.maximum(begin - 1, 0)]] & (own(begin) | (part == 1))
        after = (end < size[row]) & own(np.minimum(stop, len(buf) - 1)) & own(stop - 1) if right else np.zeros(len(row), bool)
        row, pattern = row[~before & ~after], pattern[~before & ~after]
        many, flat = self._flat[part]
        first = np.cumsum(many) - many
        at = np.repeat(first[pattern] - (np.cumsum(many[pattern]) - many[pattern]), many[pattern]) + np.arange(int(many[pattern].sum()))
        return np.repeat(row, many[pattern]), flat[at]

    def best(self, texts: list[str | None]) -> list[list[int]]:
        """Of each text the longest keyword of each category that stands in it (ties: by order), as entry numbers,
        longest first. Null: none."""
        row, entry = self._chosen(_packed([(t or "").encode("utf-8", "surrogatepass") for t in texts]), lambda: _packed([SQUASHED.sub("", t or "").encode("utf-8", "surrogatepass") for t in texts]))
        out: list[list[int]] = [[] for _ in texts]
        for r, e in zip(row.tolist(), entry.tolist(), strict=True):
            out[r].append(e)
        return out

    def best_of(self, texts: pa.Array) -> pa.ListArray:
        """`best` of an array of texts, as values of the entries; only rows with a keyword cost more than array steps."""
        raw = _of_arrow(texts)
        row, entry = self._chosen(raw, lambda: _squash(texts, raw))
        edge = np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))]
        return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), self.values.take(pa.array(entry, pa.int64())))

    def _found(self, raw: tuple[np.ndarray, np.ndarray, np.ndarray], squashed: Callable[[], tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of all keywords that stand in the texts, by row and longest first; one may come twice."""
        hits = self.whole.hits(_UPPER[raw[0]], raw[1], raw[2])
        row, entry = self._standing(0, self.whole, raw, hits, True)
        if len(self.squashed.lengths):
            packed = squashed()
            more = self._standing(1, self.squashed, packed, self.squashed.hits(_UPPER[packed[0]], packed[1], packed[2]), False)
            row, entry = np.r_[row, more[0]], np.r_[entry, more[1]]
        order = np.lexsort((self._place[entry], row))
        row, entry = row[order], entry[order]
        bound = np.isin(entry, [*self._excluded, *self._required])
        if bound.any():
            # Only of rows with such an entry is it asked which marks they hold.
            wanted = np.unique([p for d in (self._excluded, self._required) for ps in d.values() for p in ps])
            keep = np.isin(hits[2], wanted) & np.isin(hits[0], row[bound])
            marked = set(zip(hits[0][keep].tolist(), hits[2][keep].tolist(), strict=True))
            lacks = lambda r, e: any((r, p) in marked for p in self._excluded.get(e, ())) or (e in self._required and not any((r, p) in marked for p in self._required[e]))
            drop = bound.copy()
            drop[bound] = [lacks(r, e) for r, e in zip(row[bound].tolist(), entry[bound].tolist(), strict=True)]
            row, entry = row[~drop], entry[~drop]
        return row, entry

    def _chosen(self, raw: tuple[np.ndarray, np.ndarray, np.ndarray], squashed: Callable[[], tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of what `best` gives, by row and longest first."""
        row, entry = self._found(raw, squashed)
        first = np.sort(np.unique(row * (int(self._kind.max(initial=0)) + 1) + self._kind[entry], return_index=True)[1])
        return row[first], entry[first]

    def found_in(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of all keywords that stand in the texts, by row and longest first; one may come twice."""
        raw = _of_arrow(texts)
        return self._found(raw, lambda: _squash(texts, raw))


def together(*parts: Dictionary) -> tuple[Dictionary, list[int]]:
    """One dictionary of the entries of several, each with its own exclusions and requirements, so that a text is stepped
    through once for all; and the number of each one's first entry. Entries keep their order of preference within each."""
    out, starts = Dictionary([e for p in parts for e in p.entries]), np.cumsum([0, *(len(p.entries) for p in parts)]).tolist()
    marks = [m for p in parts for d in (p._excluded, p._required) for ms in d.values() for m in (p.patterns[i] for i in ms)]
    if marks:
        out.patterns = list(dict.fromkeys([*out.patterns, *marks]))
        number = {p: i for i, p in enumerate(out.patterns)}
        out.whole = Automaton(out.patterns)
        out._of = (out._of[0] + [[] for _ in range(len(out.patterns) - len(out._of[0]))], out._of[1])
        out._flat[0] = (np.r_[out._flat[0][0], np.zeros(len(out._of[0]) - len(out._flat[0][0]), np.int64)], out._flat[0][1])
        for p, at in zip(parts, starts, strict=False):
            for own, d in ((out._excluded, p._excluded), (out._required, p._required)):
                own.update({at + e: [number[p.patterns[i]] for i in ms] for e, ms in d.items()})
    return out, starts[:-1]


def first_of(row: np.ndarray, entry: np.ndarray, n: int) -> np.ndarray:
    """Of each of n rows the first entry among (row, entry), sorted by row, or -1."""
    out = np.full(n, -1, np.int64)
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    out[row[at]] = entry[at]
    return out


def of_table(table: DataFrame, excluded: dict[str, list[str]] | None = None, required: dict[str, list[str]] | None = None) -> Dictionary:
    """A dictionary of the rows (keyword, category, subcategory, label, ord) of a table, which is counted before the
    driver reads it."""
    n = table.limit(MOST_ENTRIES + 1).count()
    if n > MOST_ENTRIES:
        raise ValueError(f"a dictionary has {MOST_ENTRIES} entries at most")
    rows = sorted(table.select("ord", "keyword", "category", "subcategory", "label").collect(), key=lambda r: (r.ord, r.keyword))
    return Dictionary([tuple(r)[1:] for r in rows], excluded or {}, required or {})


#: What `matches` gives: entries, and the place of each among all by length and order.
KIND = "array<struct<keyword: string, k_category: string, k_subcategory: string, k_label: string, rank: int>>"


def matches(spark: SparkSession, dictionary: Dictionary, text: Column) -> Column:
    """The longest keyword of each category that stands in the text, longest first."""
    shared = spark.sparkContext.broadcast(dictionary)

    @F.arrow_udf(KIND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for texts in batches:
            parts = [known.best_of(texts.slice(at, 4096)) for at in range(0, len(texts), 4096)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(known.values.type))

    return found(text)


def allowed(found: Column, debit: Column, credit: Column) -> Column:
    """The first of the found entries whose category the direction allows: a credit is no expense, a debit no income."""
    fits = lambda k: ~((credit > 0) & ~(debit > 0) & (k["k_category"] == "Expense")) & ~((debit > 0) & ~(credit > 0) & (k["k_category"] == "Income"))
    return F.get(F.filter(found, fits), F.lit(0))


def truncated(dictionary: Dictionary, least: int = 6) -> dict[str, int]:
    """Every beginning of a keyword, of `least` characters or more and in upper case, with the entry of the longest
    keyword it begins: what a value that a bank cut short stands for."""
    out: dict[str, int] = {}
    for i in dictionary.rank:
        k = dictionary.entries[i][0].upper()
        for n in range(least, len(k) + 1):
            out.setdefault(k[:n], i)
    return out


def truncated_match(spark: SparkSession, dictionary: Dictionary, value: Column, least: int = 6) -> Column:
    """The entry of the longest keyword that begins with the value, which a bank may have cut short; else null."""
    shared = spark.sparkContext.broadcast((truncated(dictionary, least), dictionary.values))

    @F.arrow_udf(KIND.removeprefix("array<").removesuffix(">"))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, values = shared.value
        for texts in batches:
            yield values.take(pa.array([known.get((t or "").strip().upper()) for t in texts.to_pylist()], pa.int64()))

    return found(value)

"""Names in texts by similarity of their word sets, from edit distances, with a q-gram index instead of all pairs.

The score of a text and a name compares three strings made of their words: those of both, and those with the words of
one or the other appended; the best of the three ratios counts (100 if one has all words of the other). A ratio is 100
less the share of insertions and deletions among the letters of both. Names are a dictionary of bounded size, indexed by
words and by pairs of letters: a name is a candidate if it shares a word, or if so few letters can differ at the wanted
score that the pairs of letters it must then share are there. No name over the threshold is left out; `candidates`
counts how many are scored. Equal texts are scored once a batch, where they stand."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Names that a dictionary may hold.
MOST_NAMES = 200_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The distinct words of a text in lower case, in order of their letters."""
    return sorted({w for w in _WORD.findall(text.lower())})


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    if not a or not b:
        return 0
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        at[c] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at[c]
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(distance: int, letters: int) -> float:
    return 100.0 - 100.0 * distance / letters if letters else 100.0


def score(a: list[str], b: list[str]) -> float:
    """Of two sorted lists of distinct words, from 0 to 100."""
    if not a or not b:
        return 0.0
    both = set(a) & set(b)
    left, right = " ".join(w for w in a if w not in both), " ".join(w for w in b if w not in both)
    if both and not (left and right):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = bool(shared)
    one, other = shared + gap + len(left), shared + gap + len(right)
    best = _ratio(len(left) + len(right) - 2 * common(left, right), one + other)
    if shared:
        best = max(best, _ratio(gap + len(left), shared + one), _ratio(gap + len(right), shared + other))
    return best


def _pairs(s: str) -> Counter:
    return Counter(s[i : i + 2] for i in range(len(s) - 1))


class Index:
    """Names by words and by pairs of letters of all their words."""

    def __init__(self, names: list[str]) -> None:
        if len(names) > MOST_NAMES:
            raise ValueError(f"a dictionary has {MOST_NAMES} names at most")
        self.names, self.words = names, [words(n) for n in names]
        self.flat = [" ".join(w) for w in self.words]
        self._word: dict[str, list[int]] = defaultdict(list)
        self._pair: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self._length: dict[int, list[int]] = defaultdict(list)
        for i, (ws, flat) in enumerate(zip(self.words, self.flat, strict=True)):
            self._length[len(flat)].append(i)
            for w in ws:
                self._word[w].append(i)
            for p, n in _pairs(flat).items():
                self._pair[p].append((i, n))

    def candidates(self, ws: list[str], least: float) -> set[int]:
        """Every name whose score with the words may be `least` or more. Without a word in common the score is a ratio
        of whole strings, at which d letters may differ; each changes two pairs of letters at most."""
        found = {i for w in ws for i in self._word.get(w, ())}
        flat = " ".join(ws)
        n, met = len(flat), Counter()
        for p, k in _pairs(flat).items():
            for i, m in self._pair.get(p, ()):
                met[i] += min(k, m)
        share = 1 - least / 100
        for length, own in self._length.items():
            d = int(share * (n + length) + 1e-9)
            if abs(n - length) <= d and length:
                need = max(n, length) - 1 - 2 * d
                found.update(own if need <= 0 else (i for i in own if met[i] >= need))
        return found

    def best(self, text: str, least: float) -> tuple[int, float] | None:
        """(number, score) of the first name with the highest score, if that is `least` or more."""
        ws, top = words(text), None
        for i in sorted(self.candidates(ws, least)):
            s = score(ws, self.words[i])
            if s >= least and (top is None or s > top[1]):
                top = (i, s)
        return top


KIND = "struct<name: string, score: double>"


def best_name(spark: SparkSession, names: list[str], text: Column, least: Column) -> Column:
    """(name, score) of the most similar name (ties: the first listed) where the score is `least` or more, else null.
    `least` may differ by row, as banks that cut narrations short are matched more freely."""
    shared = spark.sparkContext.broadcast(names)

    @F.arrow_udf(KIND)
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index, known = Index(shared.value), {}
        for texts, bounds in batches:
            out = []
            for key in zip(texts.to_pylist(), bounds.to_pylist(), strict=True):
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    hit = index.best(key[0], key[1]) if key[0] is not None and key[1] is not None else None
                    known[key] = hit and {"name": index.names[hit[0]], "score": hit[1]}
                out.append(known[key])
            yield pa.array(out, pa.struct([("name", pa.string()), ("score", pa.float64())]))

    return found(text, least)


#: Fixed: thresholds of banks whose narrations are whole and of those that cut them short, which are listed.
WHOLE, SHORT = 80.0, 70.0
CUT_SHORT = ("Bank Of India", "Union", "BOB", "Punjab National Bank", "Canara Bank", "Indian Overseas Bank")


def threshold(bank: Column, own: dict[str, float] | None = None) -> Column:
    out = F.when(bank.isin(*CUT_SHORT), SHORT).otherwise(WHOLE)
    for name, least in (own or {}).items():
        out = F.when(bank == name, float(least)).otherwise(out)
    return out.cast("double")


def confidence(score_: Column, least: Column) -> Column:
    """From 0.70 at the threshold upward, 0.85 at most."""
    return F.round(F.least(F.greatest(0.70 + (F.round(score_ / 100, 2) - least / 100) * 0.75, F.lit(0.70)), F.lit(0.85)), 2)

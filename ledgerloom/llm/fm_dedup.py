"""Substring dedup with compressed FM-indexes over words, one per shard.

Windows of `window` words are routed by content: a window's key is the least hash among its k-grams, so equal
windows have equal keys wherever they stand. Consecutive windows with one key are a segment. Segments whose key
occurs in one document only are done. Of the others each distinct content is shipped once, to the shard of its
key, with the smallest doc_id that holds it.

A shard is an FM-index (wavelet matrix with popcount ranks over the Burrows-Wheeler transform of its segments).
Each segment streams through it from right to left. A backward-search step extends the match by a word; a match
of full window length is first shortened by its last word, that is, widened to the rows that agree on one word
less. Each step thus gives the matching statistic cut off at the window length, and the smallest doc_id of the
rows that share the window. Documents then read off, for each of their segments, the intervals of windows that
also start in a smaller document.

Keys with very many distinct segments are salted: segments are dealt into parts and each pair of parts is an
index of its own, so every pair of segments meets in some index and none holds more than two parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import materialize, partitions, with_fields
from ledgerloom.llm.textkit import ASCII_SPACE, Words, chunks, mix

WINDOW = 50
GRAM = 8
#: Words of an index from which on a shard is closed at the next key.
SHARD_WORDS = 1 << 18
#: Distinct segments of a key in a part, and their words.
PART, PART_WORDS = 3_000, 1 << 20
_SLIDE = np.uint64(0x9E3779B97F4A7C15)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _segments(first: np.ndarray, h: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, content) of each segment of texts whose word hashes are h[first[i]:first[i + 1]]."""
    gram = min(GRAM, window)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(h) < window:
        return none
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * _SLIDE + h[i : i + len(grams)]
    key = _least(mix(grams), window - gram + 1)
    text = np.searchsorted(first, np.arange(len(key)), side="right") - 1
    inside = np.arange(len(key)) + window <= first[text + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    new = np.flatnonzero(np.r_[True, (key[at][1:] != key[at][:-1]) | (np.diff(at) != 1) | (text[at][1:] != text[at][:-1])])
    begin, count = at[new], np.diff(np.r_[new, len(at)])
    # The content's hash from running sums, as for words: weights are powers of the base.
    up = np.full(len(h), _SLIDE, np.uint64)
    up[0] = 1
    down = np.full(len(h), np.uint64(pow(int(_SLIDE), -1, 1 << 64)), np.uint64)
    down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(mix(h) * up, dtype=np.uint64)]
    content = mix((sums[begin + count + window - 1] - sums[begin]) * down[begin] + count.astype(np.uint64))
    return text[begin], begin - first[text[begin]], count, key[begin], content


class WaveletMatrix:
    """rank(c, p): how often symbol c stands before p. Each level holds its bits in 64-bit words and a count
    per word, a bit and a half for each symbol."""

    def __init__(self, x: np.ndarray, top: int) -> None:
        self.levels = max(int(top).bit_length(), 1)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level & 1).astype(np.uint8)
            packed = np.packbits(np.r_[bit, np.zeros(64 - len(bit) % 64, np.uint8)], bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]].astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def place(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Where position p goes when each level sorts by a bit of c: rank(c, p) plus the start of c's run."""
        for i in range(self.levels):
            word = p >> 6
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)))
            p = np.where(c >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, p - ones)
        return p


class FMIndex:
    """Over segments of word hashes, each at least `window` long. Rows are suffixes sorted by their first
    `window` words, which is as far as a search looks."""

    def __init__(self, segments: list[np.ndarray], owner: np.ndarray, window: int) -> None:
        self.window = window
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        self.end = np.cumsum(size + 1) - 1  # each segment is followed by a 0
        self.size = size
        _, ids = np.unique(np.concatenate(segments), return_inverse=True)
        self.text = np.zeros(int(size.sum()) + len(segments), np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.end] = False
        self.text[inside] = ids + 1
        rank, span = self.text, 1
        while span * 2 < window:
            rank = self._joined(rank, span)
            span *= 2
        shift = window - span
        later = self._later(rank, shift)
        order = np.lexsort((later, rank))
        # Rows that agree on all words but the last, and on all.
        short = self._later(rank, shift - 1)
        change = (rank[order][1:] != rank[order][:-1]) | (short[order][1:] != short[order][:-1])
        self.row_of_class = self._starts(change)
        full = np.flatnonzero(np.r_[True, (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])])
        doc = np.repeat(np.arange(len(segments)), size + 1)[order]
        least = np.minimum.reduceat(owner[doc], full)
        self.least = np.repeat(least, np.diff(np.r_[full, len(order)]))
        before = self.text[order - 1]  # of the first suffix the last 0: it wraps around
        top = int(self.text.max())
        self.bwt = WaveletMatrix(before, top)
        total = np.bincount(self.text, minlength=top + 1)
        self.first = np.r_[0, np.cumsum(total)[:-1]]
        self.run = self.bwt.place(np.arange(top + 1), np.zeros(top + 1, np.int64))

    @staticmethod
    def _later(rank: np.ndarray, by: int) -> np.ndarray:
        return np.r_[rank[by:], np.zeros(by, rank.dtype)]

    @staticmethod
    def _starts(change: np.ndarray) -> np.ndarray:
        at = np.r_[0, np.where(change, np.arange(1, len(change) + 1), 0)]
        return np.maximum.accumulate(at)

    def _joined(self, rank: np.ndarray, span: int) -> np.ndarray:
        key = rank * (int(rank.max()) + 1) + self._later(rank, span)
        return np.unique(key, return_inverse=True)[1]

    def stream(self) -> Iterator[tuple[int, np.ndarray]]:
        """(offset from the right, rows): for each step the segments still streaming are the first of
        `self.order`; rows are where their current match begins."""
        self.order = np.argsort(-self.size, kind="stable")
        size, at = self.size[self.order], self.end[self.order] - 1
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
        row = np.zeros(len(size), np.int64)
        for step, m in enumerate(active):
            if step >= self.window:
                row = self.row_of_class[row]
            row = row[:m]
            c = self.text[at[:m] - step]
            row = self.first[c] + self.bwt.place(c, row) - self.run[c]
            yield step, row

    def runs(self) -> tuple[np.ndarray, ...]:
        """(segment, first, stop, least), ordered: of each segment the runs of windows with one smallest owner of a
        segment that has the window. A run is written when it ends, so memory follows the runs, not the longest segment."""
        out: list[np.ndarray] = []
        now, since, w = np.zeros(0, np.int64), np.zeros(0, np.int64), -1

        def close(which: np.ndarray, at: int) -> None:
            segment = self.order[which]
            last = self.size[segment] - self.window
            out.append(np.stack([segment, last - at + 1, last - since[which] + 1, now[which]]))

        for step, row in self.stream():
            if step < self.window - 1:
                continue
            w = step - self.window + 1  # windows before it, from the right
            least = self.least[row]
            if w == 0:
                now, since = least.copy(), np.zeros(len(row), np.int64)
                continue
            if len(row) < len(now):
                close(np.arange(len(row), len(now)), w)
                now, since = now[: len(row)], since[: len(row)]
            if len(other := np.flatnonzero(now != least)):
                close(other, w)
                now[other], since[other] = least[other], w
        close(np.arange(len(now)), w + 1)
        found = np.concatenate(out, axis=1)
        return tuple(found[:, np.lexsort((found[1], found[0]))])


def _find_segments(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, start, n, key, content) of each segment of each row of docs (doc_id, text, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in chunks(list(range(b.num_rows)), b.column(1).to_pylist()):
                w = Words(texts, ASCII_SPACE)
                text, start, n, key, content = _segments(w.first, w.hashes(), window)
                own = pa.array(np.array(rows, np.int64)[text])
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(2).take(own), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))], ["doc_id", "digest", "start", "n", "key", "content"])

    return docs.mapInArrow(run, with_fields(docs, "doc_id", "digest long, start int, n int, key long, content long"))


def _cut(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted segments: (key, content, low, high, doc_id, words), once for each index that
    a segment is in. A segment is cut from the text it was found in: texts are told apart by doc_id and digest."""
    lists = wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("key", "content", "start", "n", "parts", "part")).alias("own")).withColumnsRenamed({"doc_id": "of", "digest": "of_digest"})
    once = docs.dropDuplicates(["doc_id", "digest"])
    joined = once.join(lists.hint("shuffle_hash"), (F.col("doc_id") == F.col("of")) & (F.col("digest") == F.col("of_digest"))).select("doc_id", "text", "own")
    names = ["key", "content", "low", "high", "doc_id", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = []
                for doc, text, own in zip(*[c.to_pylist() for c in b.slice(at, 64).columns], strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    for s in own:
                        data = b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1])
                        for other in range(s["parts"]):
                            rows.append((s["key"], s["content"], min(other, s["part"]), max(other, s["part"]), doc, data))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names)

    return joined.mapInArrow(run, "key long, content long, low int, high int, doc_id long, words binary")


def _statistics(cut: DataFrame, window: int) -> DataFrame:
    """(key, content, runs): of each segment the runs (first, stop, least) of windows with one smallest owner."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("least", pa.int64())]))

    def index(rows: list[tuple]) -> pa.RecordBatch:
        w = Words([r[5] for r in rows], ASCII_SPACE)
        h = w.hashes()
        segment, first, stop, least = FMIndex([h[w.first[i] : w.first[i + 1]] for i in range(len(rows))], np.array([r[4] for r in rows]), window).runs()
        edge = np.searchsorted(segment, np.arange(len(rows) + 1))
        values = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(least)], fields=list(kind.value_type))
        runs = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), runs], ["key", "content", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, load = [], 0
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if load >= SHARD_WORDS and r[:1] + r[2:4] != rows[-1][:1] + rows[-1][2:4]:
                    yield index(rows)
                    rows, load = [], 0
                rows.append(r)
                load += r[5].count(b" ") + 1
        if rows:
            yield index(rows)

    n = partitions(cut.sparkSession)
    return cut.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high", "content").mapInArrow(run, "key long, content long, runs array<struct<first:int,stop:int,least:bigint>>")


def _told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest) of docs; the digest tells texts with one doc_id apart."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a whole number")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, digest, spans): of each text with such words, ranges (first, stop) of words in windows whose word
    sequence also starts in a document with a smaller doc_id. Ranges may overlap. Rows with a null doc_id take
    no part; null texts have no words; rows that repeat a doc_id are texts of one document, each with ranges of its
    own. Segments are told apart by key and content, two 64-bit hashes."""
    own = _told_apart(docs.where("doc_id is not null"))
    found = materialize(_find_segments(own, window), "segments")
    shared = found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    kept = materialize(found.join(shared, "key"), "repeated")
    distinct = kept.groupBy("key", "content").agg(F.min(F.struct("doc_id", "digest", "start", "n")).alias("at")).select("key", "content", "at.*")
    load = distinct.groupBy("key").agg(F.count("*").alias("many"), F.sum(F.col("n") + window - 1).alias("words"))
    parts = F.ceil(F.greatest(F.col("many") / PART, F.col("words") / PART_WORDS)).cast("int")
    hot = load.select("key", F.least(parts, F.col("many").cast("int")).alias("parts")).where("parts > 1")
    wanted = distinct.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))
    statistics = _statistics(_cut(own, wanted, window), window)
    spans = F.transform(F.filter("runs", lambda r: r["least"] < F.col("doc_id")), lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["stop"] + window - 1).alias("stop")))
    hits = kept.join(statistics, ["key", "content"]).select("doc_id", "digest", spans.alias("spans")).where(F.size("spans") > 0)
    return hits.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs: `kept` holds the kept words, joined by spaces.

    An empty table gives an empty result; further columns are not carried. See `covered` for nulls and repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                stay = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    stay[min(s["first"], len(words))] += 1
                    stay[min(s["stop"], len(words))] -= 1
                if spans:
                    keep = np.flatnonzero(np.cumsum(stay)[:-1] == 0).tolist()
                    own = [words[i] for i in keep]
                else:
                    own = words
                n.append(len(words))
                gone.append(len(words) - len(own))
                kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    spans = materialize(covered(docs, window), "covered").withColumnsRenamed({"doc_id": "of", "digest": "of_digest"})
    same = (F.col("doc_id") == F.col("of")) & (F.col("digest") == F.col("of_digest"))
    joined = _told_apart(docs).join(spans.hint("shuffle_hash"), same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, with_fields(joined, "doc_id", "n_words long, n_removed long, kept string"))


def digests(kept: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of what dedup returns."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over at most `SPAN` consecutive tokens keep some positions and ignore the others, so that a seed still
matches where ignored tokens were substituted; items of fewer tokens have masks of their length. Seeds of the benchmark form a table (hash, item, position);
seeds of the documents are joined with it, and around each hit the tokens of document and item are compared
along the hit's diagonal: an overlap is a window of `window` tokens, all of a shorter item's, of which at least
`share` are equal.

A document pass sends on only regions around seeds that pass a filter of the benchmark's seeds. The filter has
a fixed size and is used only while the benchmark has few enough seeds (`FILTER_KEYS`); beyond that every seed
goes into the join. False positives of the filter drop out in the join."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import materialize, with_fields, without
from ledgerloom.llm.textkit import NON_WORD, Words, chunks, mix, ranges

SPAN = 12
#: The positions each mask keeps. Of every window of SPAN to WINDOW tokens with a share of SHARE equal
#: ones, whichever they are, at least one mask at one place keeps equal tokens only.
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 3, 7, 9, 10, 11), (0, 1, 2, 4, 5, 9, 10), (0, 1, 4, 5, 6, 7, 8), (0, 1, 2, 3, 5, 8, 10), (0, 1, 5, 7, 8, 9, 10), (0, 1, 2, 3, 4, 7, 8))
FILTER_BITS = 1 << 24
FILTER_KEYS = 2_000_000
WINDOW, SHARE = 20, 0.8


def short_masks(n: int, share: float = SHARE) -> list[tuple[int, ...]]:
    """Masks of an item of n < SPAN tokens: it is cut into two parts more than the tokens that may differ, and
    each mask keeps two parts. Where none may differ, one mask keeps all."""
    gone = n - math.ceil(share * n)
    if not gone:
        return [tuple(range(n))]
    parts = np.array_split(np.arange(n), min(n, gone + 2))
    return [tuple(np.concatenate(p).tolist()) for p in itertools.combinations(parts, len(parts) - gone)]


def seeds(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed hash at each start of the mask's whole span."""
    n = len(tokens) - mask[-1]
    out = np.full(max(n, 0), sum(1 << at for at in mask), np.uint64)
    for at in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[at : at + len(out)]
    return mix(out)


def _tokens(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    w = Words(texts, NON_WORD)
    return w, w.hashes()


def _index(benchmark: DataFrame, share: float) -> tuple[DataFrame, DataFrame, list[tuple[int, ...]]]:
    """(hash, item_id, item_pos), (item_id, item_tokens), and the masks: MASKS, and those of the lengths that
    items of fewer than SPAN tokens have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), lower=True):
                w, h = _tokens(texts)
                own = [h[w.first[i] : w.first[i + 1]].view(np.int64) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(own, pa.list_(pa.int64()))], ["item_id", "item_tokens"])

    items = benchmark.select("item_id", "text").where("item_id is not null").mapInArrow(run, with_fields(benchmark, "item_id", "item_tokens array<long>")).distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                own = np.array(t.as_py(), np.int64).view(np.uint64)
                many = [(m, seeds(own, m)) for m in MASKS] if len(own) >= SPAN else [(m, seeds(own, m)[:1]) for m in short_masks(len(own), share)] if len(own) else []
                if many:
                    h = np.concatenate([x for _, x in many]).view(np.int64)
                    at = np.concatenate([np.arange(len(x), dtype=np.int32) for _, x in many])
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([i.as_py()] * len(h), b.schema.field(0).type), pa.array(at)], ["hash", "item_id", "item_pos"])

    items = materialize(items, "items")
    index = items.mapInArrow(spread, "hash long, item_id long, item_pos int")
    lengths = [r[0] for r in items.select(F.size("item_tokens")).distinct().where(F.size("item_tokens").between(1, SPAN - 1)).collect()]
    masks = list(dict.fromkeys([*MASKS, *(m for n in sorted(lengths) for m in short_masks(n, share))]))
    return materialize(index, "seeds"), items, masks


def _filter(index: DataFrame) -> np.ndarray | None:
    """Bits of all seeds at two places each; None where the benchmark has too many seeds to fit it."""
    distinct = index.select("hash").distinct()
    if distinct.count() > FILTER_KEYS:
        return None
    bits = np.zeros(FILTER_BITS, bool)
    h = distinct.toArrow().column(0).to_numpy().view(np.uint64)
    bits[h >> np.uint64(40)] = True
    bits[h & np.uint64(FILTER_BITS - 1)] = True
    return np.packbits(bits)


def _regions(docs: DataFrame, bits: np.ndarray | None, window: int, masks: list[tuple[int, ...]]) -> DataFrame:
    """Stretches of documents around seeds that the filter lets through: (doc_id, first, tokens, hits)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # two MB at most
    schema = with_fields(docs, "doc_id", "first int, tokens array<long>, hits array<struct<pos:int,hash:bigint>>")
    pair = pa.struct([("pos", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if shared.value is None else np.unpackbits(shared.value).view(bool)
        for b in batches:
            for ids, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), lower=True):
                w, h = _tokens(texts)
                at, hashes, last = [], [], []
                for m in masks:
                    own = seeds(h, m)
                    near = np.arange(len(own)) if table is None else np.flatnonzero(table[own >> np.uint64(40)] & table[own & np.uint64(FILTER_BITS - 1)])
                    at.append(near)
                    hashes.append(own[near])
                    last.append(np.full(len(near), m[-1]))
                at, hashes, last = np.concatenate(at), np.concatenate(hashes), np.concatenate(last)
                doc = np.searchsorted(w.first, at, side="right") - 1
                whole = at + last < w.first[doc + 1]  # a span over the end of a text is none
                at, hashes, doc = at[whole], hashes[whole], doc[whole]
                order = np.argsort(at, kind="stable")
                at, hashes, doc = at[order], hashes[order], doc[order]
                if not len(at):
                    continue
                begin, end = np.maximum(at - window, w.first[doc]), np.minimum(at + SPAN + window, w.first[doc + 1])
                new = np.flatnonzero(np.r_[True, begin[1:] > np.maximum.accumulate(end)[:-1]] | np.r_[True, doc[1:] != doc[:-1]])
                rows = []
                for i, j in zip(new, np.r_[new[1:], len(at)], strict=True):
                    s, e = begin[i], end[i:j].max()
                    hits = [{"pos": int(p), "hash": int(x)} for p, x in zip(at[i:j] - s, hashes[i:j].view(np.int64), strict=True)]
                    rows.append((ids[doc[i]], int(s - w.first[doc[i]]), h[s:e].view(np.int64), hits))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], b.schema.field(0).type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.int64())), pa.array(c[3], pa.list_(pair))], ["doc_id", "first", "tokens", "hits"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _verify(pairs: DataFrame, window: int, share: float) -> DataFrame:
    """Compares tokens along each diagonal: (doc_id, item_id, start, stop, equal) of each overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, first, tokens, item, wanted, diagonal in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                own, other = np.array(tokens), np.array(wanted)
                lo, hi = max(0, diagonal), min(len(own), len(other) + diagonal)
                size = min(window, len(other))
                if hi - lo < size:
                    continue
                same = np.r_[0, np.cumsum(own[lo:hi] == other[lo - diagonal : hi - diagonal])]
                good = np.flatnonzero(same[size:] - same[:-size] >= share * size)
                if len(good):
                    covered = np.unique(ranges(good, np.full(len(good), size)))
                    at = lo + first
                    out.append((doc, item, int(at + covered[0]), int(at + covered[-1] + 1), int(np.diff(same)[covered].sum())))
            c = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], ["doc_id", "item_id", "start", "stop", "equal"])

    return pairs.mapInArrow(run, "doc_id long, item_id long, start long, stop long, equal long")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, start, stop, n_equal) for each document and item that overlap: the first and last
    token of the overlaps (numbers of words of letters and digits, lower case) and the equal tokens of the
    longest.

    Null texts count as empty; rows with a null doc_id can't be named and give no row. Repeated rows of one
    doc_id are one document. An empty table on either side gives an empty result."""
    found = _overlapping(docs, benchmark, window, share)
    return found.groupBy("doc_id", "item_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("equal").alias("n_equal"))


def _overlapping(docs: DataFrame, benchmark: DataFrame, window: int, share: float) -> DataFrame:
    """(doc_id, item_id, start, stop, equal) along each diagonal with an overlap."""
    index, items, masks = _index(benchmark, share)
    regions = materialize(_regions(docs.where("doc_id is not null"), _filter(index), window, masks).withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = regions.select("region", F.explode("hits").alias("hit")).select("region", "hit.pos", "hit.hash")
    on = hits.join(index, "hash").select("region", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    pairs = on.join(regions.drop("hits"), "region").join(items, "item_id").select("doc_id", "first", "tokens", "item_id", "item_tokens", "diagonal")
    return _verify(pairs, window, share)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """docs without those that overlap a benchmark item; columns and rows with a null doc_id stay. Null and empty texts
    stay; an empty table on either side takes nothing away."""
    return without(docs, _overlapping(docs, benchmark, window, share))

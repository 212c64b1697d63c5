"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code. The 64 bits are cut into blocks; fingerprints at `threshold`
or fewer differing bits have, in at least one block, at most threshold // blocks of them. Each block's code is
a product of perfect Hamming codes of length 15 (covering radius 1) and of single bits (radius 0), so its
covering radius is the number of Hamming parts. A fingerprint has one home anchor per block, at most the
radius away; it is replicated to every anchor within radius plus the block's threshold. Two fingerprints close
in a block thus meet at the home anchor of either, where home members are compared with all members.

A bucket gives at most a spanning forest of its links, not all pairs, so a large group of near copies costs
links in proportion to its size; no bucket is capped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import minhash
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.shared import materialize, partitions, with_fields
from ledgerloom.llm.textkit import ranges

#: Members of a bucket up to which all its links are listed; beyond, a spanning forest of them.
SMALL = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text's word shingles (A-Z lower-cased), repeats counted; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.r_[0, ends[:-1]][: len(words) - k + 1].tolist()
    stop = (ends - 1)[k - 1 :].tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(begin)
    for at in range(0, n, 1 << 14):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(begin[at : at + (1 << 14)], stop[at : at + (1 << 14)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp bigint) for each row of docs; a null text counts as empty. Other columns are not carried."""
    schema = with_fields(docs, id_col, "fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _hamming_near(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The Hamming code of length 15 by syndromes: the syndrome of each word, and for each syndrome s the flips
    first[s]:first[s + 1] of (mask, weight) that lead to a codeword within `reach`, nearest first."""
    x = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where(x >> bit & 1, bit + 1, 0)
    weight = np.bitwise_count(x).astype(np.int64)
    masks = x[weight <= reach]
    masks = masks[np.lexsort((masks, weight[masks], syndrome[masks]))]
    return syndrome, np.searchsorted(syndrome[masks], np.arange(17)), masks, weight[masks]


class Anchors:
    """The covering of one block of `bits` bits: `parts` Hamming codes, the other bits as they are."""

    def __init__(self, bits: int, parts: int, threshold: int) -> None:
        self.bits, self.parts, self.threshold = bits, parts, threshold
        self.tables = _hamming_near(threshold + 1)

    def replicas(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, home): every anchor at which a fingerprint can meet one that differs from it in
        `threshold` bits. Within a Hamming part one unit of distance is the radius and costs nothing."""
        row, anchor = np.arange(len(x)), np.zeros(len(x), np.int64)
        spent, home = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        syndrome, first, masks, dists = self.tables
        for p in range(self.parts):
            part = (x[row] >> (15 * p)) & 0x7FFF
            of = syndrome[part]
            many = first[of + 1] - first[of]
            at = ranges(first[of], many)
            nearest = np.zeros(len(at), bool)
            nearest[np.r_[0, np.cumsum(many)[:-1]]] = True
            row, anchor, spent, home, part = (np.repeat(v, many) for v in (row, anchor, spent, home, part))
            spent = spent + np.maximum(dists[at] - 1, 0)
            anchor, home = anchor | (part ^ masks[at]) << (15 * p), home & nearest
            keep = spent <= self.threshold
            row, anchor, spent, home = row[keep], anchor[keep], spent[keep], home[keep]
        raw = [15 * self.parts + i for i in range(self.bits - 15 * self.parts)]
        anchor = anchor | (x[row] >> (15 * self.parts)) << (15 * self.parts)
        for bit in raw:
            can = spent < self.threshold
            row, home, spent, anchor = np.r_[row, row[can]], np.r_[home, np.zeros(can.sum(), bool)], np.r_[spent, spent[can] + 1], np.r_[anchor, anchor[can] ^ (1 << bit)]
        return row, anchor, home


def _block_bits(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    sizes = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    return list(zip(np.r_[0, np.cumsum(sizes)[:-1]].tolist(), sizes, strict=True))


def cover(threshold: int, blocks: int) -> list[tuple[int, Anchors]]:
    """(first bit, covering) of each block. `blocks`: more make fewer replicas and larger buckets."""
    return [(s, Anchors(n, n // 15, threshold // blocks)) for s, n in _block_bits(blocks)]


def whole_buckets(batches: Iterator[pa.RecordBatch], shift: int = 0) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first, many at a time; rows that share its value, without the last
    `shift` bits, stay together."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= 1 << 18:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0] >> shift, whole[0][-1] >> shift))
            if cut:
                yield [c[:cut] for c in whole]
            held, rows = [[c[cut:] for c in whole]], 0
    if rows or held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _forest(fp: np.ndarray, home: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between home members and members of one bucket."""
    label = np.arange(len(fp))
    rows = np.flatnonzero(home)
    step = max(1, (1 << 21) // len(fp))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        close = np.bitwise_count(fp[own][:, None] ^ fp[None, :]) <= threshold
        for i, near in zip(own[close.sum(axis=1) > 1], close[close.sum(axis=1) > 1], strict=True):
            other = np.flatnonzero(near & (label != label[i]))
            if len(other):
                seen, which = np.unique(label[other], return_index=True)
                for j in other[which]:
                    yield int(i), int(j)
                label[np.isin(label, seen)] = label[i]


def _links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows sorted by key, as row numbers."""
    first = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
    size = np.diff(np.r_[first, len(key)])
    homes = np.add.reduceat(home.astype(np.int64), first)
    a, b = [], []
    small = (size > 1) & (size <= SMALL) & (homes > 0)
    group = np.repeat(np.arange(len(first)), size)
    rows = np.flatnonzero(home & small[group])
    for at in range(0, len(rows), 1 << 13):
        own = rows[at : at + (1 << 13)]
        many = size[group[own]]
        left, right = np.repeat(own, many), ranges(first[group[own]], many)
        near = np.flatnonzero((np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (left != right))
        a.append(left[near])
        b.append(right[near])
    for g in np.flatnonzero((size > SMALL) & (homes > 0)):
        at = slice(first[g], first[g] + size[g])
        found = np.array(list(_forest(fp[at], home[at], threshold)), np.int64).reshape(-1, 2) + first[g]
        a.append(found[:, 0])
        b.append(found[:, 1])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def link_fingerprints(fps: DataFrame, threshold: int = 4, blocks: int = 3) -> DataFrame:
    """(a, b): links that join all fingerprints (distinct bigint fp) at `threshold` or fewer differing bits
    into their components."""
    columns = ["place", "fp"]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covers = cover(threshold, blocks)
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 4096):
                fp = whole[at : at + 4096]
                for k, (bit, anchors) in enumerate(covers):
                    own = (fp.view(np.uint64) >> np.uint64(bit) & np.uint64((1 << anchors.bits) - 1)).astype(np.int64)
                    row, anchor, home = anchors.replicas(own)
                    yield pa.RecordBatch.from_arrays([pa.array((anchor * blocks + k) * 2 + home), pa.array(fp[row])], columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, fp in whole_buckets(batches, 1):
            a, b = _links(place >> 1, fp.view(np.uint64), (place & 1).astype(bool), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    spread = fps.select("fp").mapInArrow(replicate, "place long, fp long")
    met = spread.repartition(partitions(fps.sparkSession), F.expr("place div 2")).sortWithinPartitions(*columns)
    return met.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4, blocks: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id whose text can be reached over links; rows with equal texts are one
    fingerprint and share it. A null text counts as empty (fingerprint zero). Rows with a null doc_id stay and
    never name a component unless no other row is in it. An empty table gives an empty result; further columns
    are not carried."""
    fps = materialize(fingerprints(docs, shingle), "fps")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = connected_components(link_fingerprints(nodes, threshold, blocks)).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = materialize(joined.join(least, "root").select("fp", "component_id"), "components")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies by shingles: words a shingle, and the similarity in percent from which on texts are copies.
SHINGLE, SIMILARITY = 5, 80


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: int = SIMILARITY) -> DataFrame:
    """(doc_id, group_id) for each row of docs with a doc_id and a word: group_id is the smallest doc_id that can
    be reached over pairs of texts whose sets of word shingles have a similarity of `least` percent or more.

    The first candidates are texts with linked fingerprints, found by anchor covering. At four bits of 64 these miss
    about half of the copies at a similarity of 0.9, so texts that share a band of MinHash values follow; all are
    confirmed by their whole sets. doc_id may be of any type; texts that share one are of one group. Null and empty
    texts and null doc_ids give no row; an empty table gives an empty result; further columns are not carried."""
    found = minhash.grouped(docs.where("doc_id is not null"), shingle, least, fingerprint, link_fingerprints, same_ids=True)
    return found.where("n_shingles > 0").select("doc_id", F.col("component_id").alias("group_id"))

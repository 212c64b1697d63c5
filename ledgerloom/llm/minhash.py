"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

One hash of each shingle serves all of a signature: its upper bits choose a bin and each bin keeps its least hash. An
empty bin takes the value of the first bin that isn't empty in an order of bins of its own, which is the same for all
texts; so even a text of few shingles has a full signature whose bins agree with a chance of the similarity. Bands of
bins are buckets.

A bucket's candidates are a star: its members against one of them, the hub. Each hub's members travel to the hub,
in parts, and are compared with it by their whole sets. A second round takes other hubs where labels still differ. In
buckets whose members are still of several components the members that may have a partner there are compared with each
other in one place (in parts, each two of which meet), and links that join components are all that leaves it. So no
table grows with the square of a group's size, and no link is lost."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.shared import checked, materialize, partitions, with_fields
from ledgerloom.llm.textkit import ASCII_SPACE, Words, chunks, mix, ranges

#: Bins of a signature, and bands of them with so many bins each. Texts of similarity s share no band with a chance of
#: (1 - s ** ROWS) ** BANDS: 2.9e-6 at 0.8, 3e-9 at 0.85.
BINS, BANDS, ROWS = 256, 42, 6
#: Bits of 128 bins in which similar texts may differ. At a similarity of 0.8 a bit differs with a chance of 0.1, so
#: that over 30 do for three pairs in a million.
SKETCH_BITS = 30
#: Rounds of stars.
ROUNDS = 2
#: Texts, and their bytes, that are compared with as many others in one place; larger buckets are cut into such parts.
PART, PART_BYTES = 2048, 4 << 20

_RANDOM = np.random.default_rng(11)
#: Of each bin the places of all bins in its own order.
_RANK = np.argsort(_RANDOM.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash): the distinct hashed word shingles of each text, ascending; a text of fewer words is one shingle."""
    w = Words(texts, ASCII_SPACE)
    h, many = w.hashes(), np.diff(w.first)
    out, own = [], []
    for k in range(1, shingle + 1):
        of = np.flatnonzero(np.minimum(many, shingle) == k)
        at = ranges(w.first[of], many[of] - k + 1)
        joined = np.full(len(at), k, np.uint64)
        for i in range(k):
            joined = joined * np.uint64(0x9E3779B97F4A7C15) + h[at + i]
        out.append(mix(joined))
        own.append(np.repeat(of, many[of] - k + 1))
    values, text = np.concatenate(out), np.concatenate(own)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (text[1:] != text[:-1])] if len(values) else np.zeros(0, bool)
    return text[new], values[new]


def signatures(text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, signature) of sorted sets: a row of BINS values for each text that has a shingle."""
    bins = (values >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (bins[1:] != bins[:-1])]) if len(text) else np.zeros(0, np.int64)
    names, row = np.unique(text[first], return_inverse=True)
    low, full = np.zeros((len(names), BINS), np.uint64), np.zeros((len(names), BINS), bool)
    low[row, bins[first]], full[row, bins[first]] = values[first], True
    for i in np.flatnonzero(~full.all(axis=1)):
        own = np.flatnonzero(full[i])
        donor = own[_RANK[:, own].argmin(axis=1)]
        low[i] = np.where(full[i], low[i], low[i][donor])
    return names, low


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), 1))
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, i : ROWS * BANDS : ROWS])
    return keys


class Block:
    """Texts with an index of their shingles, against which others are compared. Labels of components that get joined
    are kept, so that only links between different ones are told."""

    def __init__(self, nodes: np.ndarray, labels: np.ndarray, texts: list[bytes], shingle: int, least: int) -> None:
        self.nodes, self.labels, self.shingle, self.least = nodes, labels, shingle, least
        owner, h = shingle_sets(texts, shingle)
        self.sizes = np.bincount(owner, minlength=len(nodes))
        order = np.argsort(h, kind="stable")
        self.values, self.first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        self.owners, self._root = owner[order], {}

    def _find(self, label: int) -> int:
        path = []
        while (up := self._root.get(label, label)) != label:
            path.append(label)
            label = up
        for x in path:
            self._root[x] = label
        return label

    def links(self, nodes: np.ndarray, labels: np.ndarray, texts: list[bytes]) -> list[tuple[int, int]]:
        """Links that join each of the texts and the block's own into components: 100 * common >= least * all."""
        step = max(1, (1 << 20) // max(1, len(self.nodes)))  # of texts, as each has a cell for each of the block's
        if len(texts) > step:
            return [x for i in range(0, len(texts), step) for x in self.links(nodes[i : i + step], labels[i : i + step], texts[i : i + step])]
        own, h = shingle_sets(texts, self.shingle)
        if not len(h) or not len(self.values):
            return []
        n, sizes = len(self.nodes), np.bincount(own, minlength=len(texts))
        at = np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)
        hit = self.values[at] == h
        own, at = own[hit], at[hit]
        both = np.zeros(len(texts) * n, np.int64)
        ends, i = np.cumsum(self.many[at]), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), side="right")))
            cell = np.repeat(own[i:j] * n, self.many[at[i:j]]) + self.owners[ranges(self.first[at[i:j]], self.many[at[i:j]])]
            both += np.bincount(cell, minlength=len(both))
            i = j
        both = both.reshape(len(texts), n)
        close = (both > 0) & (100 * both >= self.least * (sizes[:, None] + self.sizes[None, :] - both)) & (labels[:, None] != self.labels[None, :])
        out = []
        for y in np.flatnonzero(close.any(axis=1)):
            x = np.flatnonzero(close[y])
            seen, which = np.unique(self.labels[x], return_index=True)
            mine = self._find(int(labels[y]))
            for label, w in zip(seen.tolist(), which.tolist(), strict=True):
                other = self._find(label)
                if other != mine:
                    self._root[other] = mine
                    out.append((int(nodes[y]), int(self.nodes[x[w]])))
        return out


#: Sides of a place: texts that those of the other side are compared with; those; texts compared with each other.
HELD, STREAMED, ALL = 0, 1, 2


def compared(places: DataFrame, text: DataFrame, shingle: int, least: int) -> DataFrame:
    """(a, b): links found in places (place, side, node, label). text: (node, text)."""
    n = partitions(places.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, whole = None, None, False
        held: tuple[list, list, list] = ([], [], [])
        out: list[tuple[int, int]] = []

        def closed() -> Block:
            return Block(np.array(held[0], np.int64), np.array(held[1], np.int64), held[2], shingle, least)

        def end() -> None:
            """Compares a place's texts with each other, a run of them at a time."""
            if whole and len(held[0]) > 1:
                own = closed()
                for i in range(0, len(held[0]), 32):
                    out.extend(own.links(own.nodes[i : i + 32], own.labels[i : i + 32], held[2][i : i + 32]))

        def told() -> pa.RecordBatch:
            pairs = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for b in batches:
            place, side, node, label = (b.column(i).to_numpy() for i in range(4))
            edges = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (side[1:] != side[:-1])]) if len(place) else []
            for i, j in zip(edges, np.r_[edges[1:], len(place)], strict=True):
                if place[i] != at:
                    end()
                    at, block, whole, held = place[i], None, side[i] == ALL, ([], [], [])
                for ids, texts in chunks(list(range(i, j)), b.column(4).slice(i, j - i).to_pylist(), 1 << 16):
                    texts = [t.lower() for t in texts]
                    if side[i] == STREAMED:
                        block = block or closed()
                        out.extend(block.links(node[ids], label[ids], texts))
                    else:
                        for into, new in zip(held, (node[ids].tolist(), label[ids].tolist(), texts), strict=True):
                            into.extend(new)
            yield told()
        end()
        yield told()

    rows = places.join(text, "node").select("place", "side", "node", "label", "text").repartition(n, "place").sortWithinPartitions("place", "side", "node")
    return rows.mapInArrow(run, "a long, b long")


def _near(a: str, b: str) -> str:
    return f"bit_count({a}.low ^ {b}.low) + bit_count({a}.high ^ {b}.high) <= {SKETCH_BITS}"


def star_edges(members: DataFrame, turn: int) -> DataFrame:
    """(hub, hub_label, node, label): each bucket's hub, another one each turn, with its members that have another
    label and a near sketch."""
    order = F.xxhash64("node", "key") if turn else F.col("node")
    hub = members.groupBy("key").agg(F.min_by(F.struct("node", "label", "low", "high"), order).alias("hub"))
    own = F.struct("node", "label", "low", "high")
    edges = members.withColumn("own", own).join(hub, "key").where("own.label <> hub.label").where(_near("own", "hub"))
    return edges.select(F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label"), "node", "label").distinct()


def edge_places(edges: DataFrame) -> DataFrame:
    """Places of hubs with their partners, of edges (hub, hub_label, node, label). A hub of many has several places."""
    edges = materialize(edges, "edges")
    parts = edges.groupBy("hub", "hub_label").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    place = F.xxhash64("hub", "part").alias("place")
    hubs = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(place, F.lit(HELD).alias("side"), F.col("hub").alias("node"), F.col("hub_label").alias("label"))
    others = edges.join(parts.select("hub", "parts"), "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return hubs.unionAll(others.select(place, F.lit(STREAMED).alias("side"), "node", "label"))


def rest_places(members: DataFrame) -> DataFrame:
    """Places of the members of buckets with several labels, without those that have no member of another label and a
    near sketch in their place."""
    n = partitions(members.sparkSession)
    live = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("bytes") / PART_BYTES)).cast("int")
    cut = members.join(live.select("key", F.least(parts, F.col("n").cast("int")).alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    place = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("place")
    side = F.when(F.col("parts") == 1, ALL).when(F.col("part") < F.col("other"), HELD).when(F.col("part") > F.col("other"), STREAMED).otherwise(ALL)
    rows = spread.select(place, side.alias("side"), "node", "label", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def kept(place: pa.RecordBatch) -> pa.RecordBatch:
            side, label = place.column(1).to_numpy(), place.column(3).to_numpy()
            sketch = np.stack([place.column(i).to_numpy() for i in (4, 5)], axis=1)
            keep, step = np.zeros(len(side), bool), max(1, (1 << 20) // len(side))
            for i in range(0, len(side), step):
                own = slice(i, i + step)
                apart = np.bitwise_count(sketch[own, None] ^ sketch[None]).sum(axis=2, dtype=np.int64)
                keep[own] = ((apart <= SKETCH_BITS) & (label[own, None] != label[None]) & ((side[own, None] != side[None]) | (side[own, None] == ALL))).any(axis=1)
            return place.filter(pa.array(keep)).select(["place", "side", "node", "label"])

        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if b.num_rows else held
            if b.num_rows:
                key = b.column(0).to_numpy()
                edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                out = [kept(b.slice(i, j - i)) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if j - i > 1]
                held = b.slice(int(edge[-1]))
                if out:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held is not None and held.num_rows > 1:
            yield kept(held)

    return rows.repartition(n, "place").sortWithinPartitions("place").mapInArrow(run, "place long, side int, node long, label long")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by the first column, whose value another row has too; one row is held between batches."""
    held, met = None, False
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        key = b.column(0).to_numpy()
        same = key[1:] == key[:-1]
        before = np.r_[met, same]
        yield b.slice(0, b.num_rows - 1).filter(pa.array(before[:-1] | same))
        held, met = b.slice(b.num_rows - 1), bool(before[-1])
    if held is not None and met:
        yield held


def features(docs: DataFrame, shingle: int, fingerprint: Callable[[str], int] | None = None) -> DataFrame:
    """(doc_id, text_digest, n_shingles, digest, low, high, bytes, bands, fp) of docs (doc_id, text, text_digest);
    digest tells sets apart and is null where a text has no word; fp: its fingerprint, 0 where none is asked for."""
    names = ["doc_id", "text_digest", "n_shingles", "digest", "low", "high", "bytes", "bands", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(1).to_pylist()
            for rows, texts in chunks(list(range(b.num_rows)), every):
                texts = [t.lower() for t in texts]
                text, values = shingle_sets(texts, shingle)
                own, low = signatures(text, values)
                many = np.bincount(text, minlength=len(texts))
                ends = np.r_[0, np.cumsum(many)]
                digest = [hashlib.md5(values[ends[i] : ends[i + 1]].tobytes()).hexdigest() if many[i] else None for i in range(len(texts))]
                sketch, keys = np.zeros((len(texts), 2), np.uint64), np.zeros((len(texts), BANDS), np.uint64)
                sketch[own] = np.packbits(low[:, :128] >> np.uint64(13) & np.uint64(1) == 1, axis=1, bitorder="little").view(np.uint64)
                keys[own] = band_keys(low)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                fp = np.array([fingerprint(every[i]) for i in rows] if fingerprint else np.zeros(len(rows)), np.uint64)
                cols = [b.column(i).slice(rows[0], len(rows)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(many), pa.array(digest, pa.string()), *(pa.array(sketch[:, i].view(np.int64)) for i in (0, 1)), pa.array(size), bands, pa.array(fp.view(np.int64))], names)

    return docs.select("doc_id", "text", "text_digest").mapInArrow(run, with_fields(docs, "doc_id", "text_digest string, n_shingles long, digest string, low long, high long, bytes long, bands array<long>, fp long"))


def _same_document(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links among the nodes of doc_ids that have several."""
    several = rows.where("digest is not null").groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first < last").select("doc_id")
    named = rows.select("doc_id", "digest").join(several, "doc_id").distinct().join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
    named = materialize(named, "named")
    return named.join(named.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("node > a").select("a", F.col("node").alias("b"))


def _fingerprint_edges(nodes: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges between the nodes of linked fingerprints, and from one node of each fingerprint to its others."""
    hub = nodes.groupBy("fp").agg(F.min("node").alias("hub"))
    hub = materialize(hub, "fingerprints")
    near = link(hub).join(hub.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(hub.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b").select("x", "y")
    same = nodes.select("fp", "node").join(hub, "fp").where("node > hub").select(F.col("hub").alias("x"), F.col("node").alias("y"))
    pairs = near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionAll(same).distinct()
    return pairs.select(F.col("x").alias("hub"), F.col("x").alias("hub_label"), F.col("y").alias("node"), F.col("y").alias("label"))


def grouped(docs: DataFrame, shingle: int, least: int, fingerprint: Callable[[str], int] | None = None, link: Callable[[DataFrame], DataFrame] | None = None, same_ids: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; see near_duplicates.

    fingerprint, link: a fingerprint of texts, and links (a, b) between those of a table (fp); then texts whose
    fingerprints are linked are the first candidates, instead of a second round of stars. same_ids: rows that share a
    doc_id are of one component."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_digest", F.md5("text"))
    rows = materialize(features(own, shingle, fingerprint), "features")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_digest")).alias("of"), *[F.first(c).alias(c) for c in ("low", "high", "bytes", "bands", "fp")])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select(F.explode("bands").alias("key"), "node", "low", "high", "bytes")
    buckets = spread.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_met, "key long, node long, low long, high long, bytes long")
    buckets = materialize(buckets, "buckets")
    first = materialize(_fingerprint_edges(nodes, link), "edges") if link else None

    met = buckets.select("node") if first is None else buckets.select("node").unionAll(first.select("hub")).unionAll(first.select("node"))
    wanted = materialize(met.distinct().join(nodes.select("node", "of.*"), "node").select(F.col("doc_id").alias("__id"), F.col("text_digest").alias("__digest"), "node"), "wanted")
    text = own.join(checked(wanted), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_digest") == F.col("__digest"))).select("node", "text")
    text = materialize(text.dropDuplicates(["node"]), "texts")

    links = materialize(_same_document(rows, nodes), "links") if same_ids else None
    roots = connected_components(links) if same_ids else None
    for turn in range(ROUNDS + 1):
        members = buckets.withColumn("label", F.col("node")) if roots is None else buckets.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        if turn == ROUNDS:
            places = rest_places(members)
        elif turn == 0 and first is not None:
            places = edge_places(first)
        else:
            places = edge_places(star_edges(members, 0 if first is not None else turn))
        found = materialize(compared(places, text, shingle, least), "links")
        links = found if links is None else links.unionAll(found)
        if roots is None or not found.isEmpty():
            roots = connected_components(links)
    reached = roots.join(nodes.select("node", "digest", "least"), "node")
    low = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = nodes.select("digest", "node", "least").join(reached.join(low, "root").select("node", "component_id"), "node", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    found = rows.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 2, least: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Sets hold a text's distinct shingles of `shingle` words (A-Z lower-cased; fewer words: the whole sequence). Texts
    are linked where 100 * (shingles of both) >= least * (shingles of either); bands are chosen for a `least` of 80 or
    more. component_id is the smallest doc_id that can be reached, kept whether it is the row's own. Texts that are
    null or have no word are linked with nothing. Equal sets are one node, of any number of rows. Rows with a null
    doc_id take part and never name a component that another row is in. A very long text is compared whole; an empty
    table gives an empty result; further columns are not carried. doc_id may be of any type that has an order."""
    return grouped(docs, shingle, least).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

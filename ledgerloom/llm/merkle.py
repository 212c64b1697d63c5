"""A Merkle manifest of a table, with parent-preimage paths.

A row's leaf is a hash of its fields. The leaves of one group, in order, are folded level by level, and the groups'
roots are folded likewise to one root. What is stored of each parent is its preimage: the hashes of its children one
after another, 64 characters each. A leaf joins the preimages of its ancestors. Its siblings are what is left of a
preimage when its own slot is cut out, and a changed leaf is folded up by putting its hash into that slot.

A level is too small a step for a job: `LEVELS` of them are folded at once, over aligned blocks of consecutive nodes,
so that a group of any size is many blocks and a table of 10^12 rows takes four such strips. Places within a group come
from a range-partitioned sort and the counts of its partitions; no group is ever in one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.shared import checked, materialize, partitions

#: Children of a parent, and levels that one strip folds.
ARITY, LEVELS = 2, 10
#: Characters of a digest as text.
SLOT = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of fields, each `-` if null, else its UTF-8 byte count, a colon and its value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `pos`, the place of each among those of its group in order, from 0, and `total`, their count.

    rows should be a written table, as the range partitioning samples it; `order` should tell rows apart, or many
    equal ones meet in one partition. Only the counts of each partition's groups are summed up."""
    n = partitions(rows.sparkSession)
    placed = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("part", group).agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select("part", group, (F.coalesce(before, F.lit(0)) - F.col("begin")).alias("shift"), F.sum("n").over(whole).alias("total"))
    joined = placed.join(checked(materialize(offsets, "offsets")), ["part", group])
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")


def _runs(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """The rows (g, pos, ...), sorted, of one block of `span` places at a time."""
    held = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if b.num_rows else held
        if not b.num_rows:
            continue
        g, block = b.column(0).to_numpy(), b.column(1).to_numpy() // span
        edge = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (block[1:] != block[:-1])])
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield b.slice(i, j - i)
        held = b.slice(int(edge[-1]))
    if held is not None:
        yield held


def _strip(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """nodes (g, pos, total, hash) folded by `levels` levels or to a group's root: (g, block, node, path, top, total),
    a row for each parent of nodes. path: the preimages of the parent and its ancestors within its block; top, in
    one row of a block: what the block folds to. A group of one node is passed on, with an empty path."""
    span = arity**levels
    names = ["g", "block", "node", "path", "top", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, span):
            at, left = b.column(1)[0].as_py(), b.column(2)[0].as_py()
            hashes, stored = b.column(3).to_pylist(), []
            while left > 1 and len(stored) < levels:
                stored.append(["".join(hashes[i : i + arity]) for i in range(0, len(hashes), arity)])
                hashes = [hashlib.sha256(x.encode()).hexdigest() for x in stored[-1]]
                left = -(-left // arity)
            n = len(stored[0]) if stored else 1
            paths = [[x[i // arity**k] for k, x in enumerate(stored)] for i in range(n)]
            cols = [pa.repeat(b.column(0)[0], n), pa.array([at // span] * n, pa.int64()), pa.array(range(at // arity, at // arity + n), pa.int64()), pa.array(paths, pa.list_(pa.string())), pa.array([hashes[0], *[None] * (n - 1)], pa.string()), pa.array([left] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    dealt = nodes.select("g", "pos", "total", "hash", F.expr(f"pos div {span}").alias("block")).repartition(partitions(nodes.sparkSession), "g", "block")
    ready = dealt.sortWithinPartitions("g", "pos").select("g", "pos", "total", "hash")
    return ready.mapInArrow(run, "g long, block long, node long, path array<string>, top string, total long")


class Folded(NamedTuple):
    """Written strips, lowest first, and the roots (g, hash)."""

    strips: list[DataFrame]
    roots: DataFrame


def fold(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> Folded:
    """nodes: (g, pos, total, hash), not null, places from 0 without gaps. The driver sees one number for each strip."""
    strips: list[DataFrame] = []
    while True:
        strips.append(materialize(_strip(nodes, arity, levels), "preimages"))
        nodes = strips[-1].where("top is not null").select("g", F.col("block").alias("pos"), "total", F.col("top").alias("hash"))
        if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
            return Folded(strips, nodes.select("g", "hash"))


def paths(folded: Folded, arity: int = ARITY) -> DataFrame:
    """(g, node, path): of each parent of leaves the preimages from its own up to its group's root. Blocks join
    their ancestors' paths from the highest strip down, so a strip's rows are joined once."""
    found = folded.strips[-1].select("g", "node", "path")
    for s in folded.strips[-2::-1]:
        upper = found.select(F.col("g").alias("ug"), F.col("node").alias("un"), F.col("path").alias("upper"))
        found = s.join(upper, (F.col("g") == F.col("ug")) & (F.expr(f"block div {arity}") == F.col("un"))).select("g", "node", F.concat("path", "upper").alias("path"))
    return found


def _slot(pos: Column, arity: int) -> Column:
    return (pos % arity).cast("int") * SLOT


def siblings(path: Column, pos: Column, arity: int = ARITY) -> Column:
    """The path's preimages without the slots of the node at pos and of its ancestors, concatenated."""
    start = F.struct(pos.alias("pos"), F.lit("").alias("found"))
    rest = lambda x, at: F.concat(F.substring(x, F.lit(1), at), F.substring(x, at + SLOT + 1, F.length(x)))
    return F.aggregate(path, start, lambda s, x: F.struct(F.floor(s["pos"] / arity).cast("long").alias("pos"), F.concat(s["found"], rest(x, _slot(s["pos"], arity))).alias("found")), lambda s: s["found"])


def refolded(leaf: Column, path: Column, pos: Column, arity: int = ARITY) -> Column:
    """What the path's top becomes when the node at pos is `leaf` and its siblings stay."""
    start = F.struct(pos.alias("pos"), leaf.alias("hash"))
    spliced = lambda x, at, h: F.concat(F.substring(x, F.lit(1), at), h, F.substring(x, at + SLOT + 1, F.length(x)))
    return F.aggregate(path, start, lambda s, x: F.struct(F.floor(s["pos"] / arity).cast("long").alias("pos"), F.sha2(spliced(x, _slot(s["pos"], arity), s["hash"]), 256).alias("hash")), lambda s: s["hash"])


def manifest(rows: DataFrame, group: str, order: str, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """rows, a written table with a column `leaf`, and for each row: `g` and `pos`, the places of its group and of the
    row in it; `path` and `over`, the preimages of its ancestors up to the group's root and from there to the whole
    root; `subroot` and `root`. rows may have none of these names.

    Groups are in ascending order (null first, strings bytewise), rows of a group by `order` (nulls first); rows with
    equal `order` by leaf. Equal rows are leaves of their own. An empty table gives an empty result."""
    named = rows.groupBy(group).agg(F.lit(0).cast("long").alias("all"))
    groups = numbered(materialize(named, "groups"), "all", [group])
    groups = materialize(groups.select(group, F.col("pos").alias("g")), "groups")
    of = groups.select(F.col(group).alias("__of"), "g")
    known = materialize(rows.join(checked(of), F.col(group).eqNullSafe(F.col("__of"))).drop("__of").withColumn("__row", F.monotonically_increasing_id()), "leaves")
    placed = materialize(numbered(known, "g", [order, "leaf", "__row"]).drop("__row"), "placed")
    own = fold(placed.select("g", "pos", "total", F.col("leaf").alias("hash")), arity, levels)
    n = groups.count()
    subroots = own.roots.withColumnRenamed("hash", "subroot")
    top = fold(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(n).cast("long").alias("total"), F.col("subroot").alias("hash")), arity, levels)
    root = (top.roots.first() or (None, None))[1]
    over = paths(top, arity).select("node", F.col("path").alias("over"))
    whole = materialize(subroots.join(over, F.expr(f"g div {arity}") == F.col("node")).select(F.col("g").alias("og"), "subroot", "over"), "subroots")
    up = paths(own, arity).withColumnsRenamed({"g": "ug"})
    joined = placed.drop("total").join(up, (F.col("g") == F.col("ug")) & (F.expr(f"pos div {arity}") == F.col("node"))).drop("ug", "node")
    return joined.join(checked(whole), F.col("g") == F.col("og")).drop("og").withColumn("root", F.lit(root).cast("string"))


def verify(docs: DataFrame, changed: dict[str, Column], where: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs (FIELDS), grouped by
    lang and ordered by doc_id: the manifest of the rows as they are, and whether each row still folds to its root
    where the fields in `changed` take other values in the rows of `where`.

    Nulls are fields like others (`-`), also as lang or doc_id; texts of any length are hashed whole; repeated rows
    are leaves of their own and so have proofs of their own; an empty table gives an empty result; further columns are
    not carried."""
    own = [F.col(c) for c in FIELDS]
    now = F.when(where, leaf_hash(*[changed.get(c, F.col(c)) for c in FIELDS]))
    leaves = docs.select("doc_id", "lang", leaf_hash(*own).alias("leaf"), now.alias("now"))
    found = manifest(materialize(leaves, "leaves"), "lang", "doc_id")
    proof = F.concat(siblings(F.col("path"), F.col("pos")), siblings(F.col("over"), F.col("g")))
    inner = refolded(F.coalesce("now", "leaf"), F.col("path"), F.col("pos"))
    folded = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), inner.alias("inner"), "over", "g")
    folded = folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", refolded(F.col("inner"), F.col("over"), F.col("g")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame) -> DataFrame:
    """`verify` where n_chars is one more in the rows whose doc_id, as decimal text, has a CRC-32 that 7 divides."""
    return verify(docs, {"n_chars": F.col("n_chars") + 1}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)

"""Names that truncation cuts short: families of keys of which one begins the other.

Sorted by their letters, keys that begin one another are neighbours: a key is followed by all that it begins. So rows
placed by account and first letters stream through in order, a stack of open prefixes gives each key the longest one
that begins it, and a task holds one family at a time, not all keys that share their first letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A = "account_id"
#: Characters of the shorter of two names from which on one may begin the other.
LEAST = 6


def flat(key: Column) -> Column:
    """A key without its bank (after `|`) and without blanks."""
    return F.regexp_replace(F.substring_index(key, "|", 1), " ", "")


def open_prefixes(flats: list[str], least: int = LEAST) -> list[int]:
    """Of each of sorted distinct names the number of the longest other one that begins it, or -1. Names shorter
    than `least` begin none."""
    out, stack = [], []
    for i, f in enumerate(flats):
        while stack and not f.startswith(flats[stack[-1]]):
            stack.pop()
        out.append(stack[-1] if stack else -1)
        if len(f) >= least:
            stack.append(i)
    return out


def canonical(keys: list[tuple[str, str]], least: int = LEAST) -> list[str]:
    """The spelling that each of a family's (key, flat) joins. Keys are taken longest first (ties: by name); a key
    joins the first kept before whose name equals its own, begins it or is begun by it, or is kept itself.

    Of each name the first kept at it and the first kept at it or beyond are known. A kept key is told to the names
    that begin it until one has been told of an earlier one, so all that is told is linear in the names."""
    flats = sorted({f for _, f in keys})
    number, parent = {f: i for i, f in enumerate(flats)}, open_prefixes(flats, least)
    here, beyond = [None] * len(flats), [None] * len(flats)
    order = sorted(range(len(keys)), key=lambda i: (-len(keys[i][0]), keys[i][0]))
    out = [""] * len(keys)
    for rank, i in enumerate(order):
        at = number[keys[i][1]]
        found = beyond[at] if len(flats[at]) >= least else here[at]
        up = parent[at]
        while up >= 0:
            if here[up] is not None and (found is None or here[up] < found):
                found = here[up]
            up = parent[up]
        if found is None:
            found, here[at], up = rank, rank, at
            while up >= 0 and beyond[up] is None:
                beyond[up], up = rank, parent[up]
        out[i] = keys[order[found]][0]
    return out


def longest(keys: list[tuple[str, str]], least: int = LEAST) -> list[str]:
    """The longest (ties: first by name) of a family's keys (key, flat) whose name equals that of each key or goes on
    from it. Names are visited last first, so what a name leads to is known before it is told to its prefix."""
    flats = sorted({f for _, f in keys})
    number, parent = {f: i for i, f in enumerate(flats)}, open_prefixes(flats, least)
    best: list[tuple[int, str] | None] = [None] * len(flats)

    def offer(at: int, x: tuple[int, str]) -> None:
        best[at] = x if best[at] is None else min(best[at], x)

    for k, f in keys:
        offer(number[f], (-len(k), k))
    for i in range(len(flats) - 1, -1, -1):
        if parent[i] >= 0:
            offer(parent[i], best[i])
    return [best[number[f]][1] for _, f in keys]


def by_family(rows: DataFrame, fn: Callable[[list[tuple]], list[tuple]], out: str, least: int = LEAST) -> DataFrame:
    """What fn makes of each family of an account: rows (account_id, flat, ...) as tuples without the account, sorted
    by all columns. Names that no other one can begin, being under `least` characters, are families of their own."""
    rest = [c for c in rows.columns if c != A]
    names = [A, *[f.split(" ")[0] for f in out.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, root, held, made, kind = None, None, [], [], None

        def told() -> pa.RecordBatch:
            cols = list(zip(*made, strict=True)) if made else [[] for _ in names]
            found = pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.string()) for c in cols[1:]]], names)
            made.clear()
            return found

        for b in batches:
            kind = b.schema.field(0).type
            for own, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if own != account or not (row[0] == root or (len(root) >= least and row[0].startswith(root))):
                    made.extend((account, *x) for x in (fn(held) if held else ()))
                    account, root, held = own, row[0], []
                held.append(tuple(row))
            yield told()
        if held:
            made.extend((account, *x) for x in fn(held))
            yield told()

    head = F.when(F.length("flat") >= least, F.substring("flat", 1, least)).otherwise(F.concat(F.lit("="), F.col("flat")))
    kind = rows.schema[A].dataType.simpleString()
    placed = rows.withColumn("__head", head).repartition(A, "__head").sortWithinPartitions(A, *rest).select(A, *rest)
    return placed.mapInArrow(run, f"{A} {kind}, {out}")


def canonical_keys(keys: DataFrame, least: int = LEAST, rule: Callable[[list[tuple[str, str]], int], list[str]] = canonical) -> DataFrame:
    """(account_id, key, canonical): spellings cut short under the one that `rule` says: `canonical`, by which a name
    may also join a longer spelling of its own beginning, or `longest`. Blank and null keys are left out."""
    own = keys.select(A, F.col("key")).where("key <> ''").distinct().select(A, flat(F.col("key")).alias("flat"), "key")

    def family(rows: list[tuple]) -> list[tuple]:
        return list(zip([k for _, k in rows], rule([(k, f) for f, k in rows], least), strict=True))

    return by_family(own, family, "key string, canonical string", least)


def matching_keys(left: DataFrame, right: DataFrame, least: int = LEAST) -> DataFrame:
    """(account_id, key, other): all pairs of a left and a right key of one account (account_id, key) whose names are
    equal or of which one begins the other. Within a family right keys are met along the open prefixes and below."""
    both = left.select(A, "key", F.lit("l").alias("side")).unionAll(right.select(A, "key", F.lit("r"))).where("key <> ''").distinct()
    own = both.select(A, flat(F.col("key")).alias("flat"), "key", "side")

    def family(rows: list[tuple]) -> list[tuple]:
        flats = sorted({f for f, _, _ in rows})
        number, parent = {f: i for i, f in enumerate(flats)}, open_prefixes(flats, least)
        sides = {s: [[] for _ in flats] for s in "lr"}
        for f, k, s in rows:
            sides[s][number[f]].append(k)
        out = [(k, o) for i in range(len(flats)) for k in sides["l"][i] for o in sides["r"][i]]
        for i in range(len(flats)):
            up = parent[i]
            while up >= 0:
                out += [(k, o) for k in sides["l"][i] for o in sides["r"][up]] + [(k, o) for k in sides["l"][up] for o in sides["r"][i]]
                up = parent[up]
        return out

    return by_family(own, family, "key string, other string", least)

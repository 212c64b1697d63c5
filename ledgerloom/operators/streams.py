"""Groups whose result depends on walking their rows in order: rows are placed by key, sorted, and stream through;
a task holds one group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def walk_groups(rows: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[tuple]], Iterable[tuple]], out: dict[str, str]) -> DataFrame:
    """keys and `out` (name: int, long, double or boolean) of what fn makes of each group's rows, given as tuples of
    all columns but the keys, in order."""
    rest = [c for c in rows.columns if c not in keys]
    names, k = [*keys, *out], len(keys)
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys] + [f"{n} {t}" for n, t in out.items()])

    def run(batches):
        at, held, kinds = None, [], None

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for b in batches:
            kinds, found = [*(b.schema.field(i).type for i in range(k)), *(_KINDS[t] for t in out.values())], []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:k] != at:
                    if held:
                        found += [(*at, *x) for x in fn(held)]
                    at, held = row[:k], []
                held.append(row[k:])
            if found:
                yield made(found)
        if held and (found := [(*at, *x) for x in fn(held)]):
            yield made(found)

    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

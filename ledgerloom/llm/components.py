"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the node; hubs cost no more than their links because the
aggregation combines before the shuffle and AQE splits a skewed join. No link and no label ever reaches the
driver: it sees one row with a count and a checksum for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b): bigint, not null, either order, repeats and loops allowed.

    Returns (node, root), root the smallest node of the component; nodes without an edge to another node are
    not listed. An empty input gives an empty result."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first()
        if row == sign or row[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        sign = row
        now = materialize(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

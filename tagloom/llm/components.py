"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import settle, unsettle

MAX_ROUNDS = 60


def _least(pairs: DataFrame, own: bool) -> DataFrame:
    """The least neighbour of each node (the node itself included if ``own``); partial sums keep hubs cheap."""
    low = F.min("v")
    return pairs.groupBy("u").agg((F.least(F.col("u"), low) if own else low).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``, in any direction and repeated at will, to ``(node, component)``.

    ``component`` is the least node that can be reached; nodes without an edge to another node have no row. No group
    is collected: each round is two aggregations and two joins, after which every edge has moved towards the least
    node of its surroundings, so the number of rounds grows with the logarithm of the longest chain. Each round is
    written to the shared folder, which cuts lineage; the round before it is deleted. Null ends are ignored; an empty
    input has an empty result.
    """
    now = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both, True), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct())
        low = _least(large, False)
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        )
        after = settle(small.where("u <> v").distinct())
        then = _mark(after)
        unsettle(now)
        unsettle(large)
        now = after
        if then == mark:
            break
        mark = then
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]

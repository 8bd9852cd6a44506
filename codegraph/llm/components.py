"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

ROUNDS = 60


def _sum(edges: DataFrame) -> tuple:
    """A count and two sums over the edge set: equal for equal sets."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(r)


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of itself and its neighbours."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge, but for roots themselves; root is the least node reachable.

    Ids may be anything that orders. Loops and repeated edges don't matter; no edges give no rows. A hub's rows are
    only summed by key (least value) and joined, which the adaptive planner splits.
    """
    now = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    before = _sum(now)
    for _ in range(ROUNDS if before[0] else 0):
        now = materialise(_small(_large(now)), "edges")
        after = _sum(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Connected components of an edge table by alternating large and small stars.

Rounds grow with the logarithm of the longest path.  A node with very many edges is
never gathered: its smallest neighbour is found by a partial aggregate and joined
back, and the join's hot key can be split, since the other side has one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooring.shared import materialise, release


def _both_ways(edges: DataFrame) -> DataFrame:
    pair = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.inline(pair))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another one; a component is
    named by its smallest node.  Self-loops and edges with a null end are ignored,
    repeated edges count once; an empty table gives no rows."""
    now = materialise(
        edges.select(F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b"))
        .where("a is not null and b is not null and a <> b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialise(_small_star(_large_star(now).distinct()).distinct(), "stars")
        release(before)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == mark:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

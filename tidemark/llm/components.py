"""Connected components by alternating large and small stars.

Both steps point edges at the smallest neighbour; repeated, every component
ends as a star around its smallest node.  A step is two aggregations and two
joins of the edge list with itself: nothing is gathered per node, a hub with
millions of edges is one aggregated row joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Edges up to which Spark may broadcast them; edges of a star compress so well that a small file may hold millions.
FEW = 100_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return df if rows <= FEW else df.hint("merge")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("u"), F.least("src", "m").alias("m"))
    return both.where(F.col("dst") > F.col("src")).join(_sized(least, rows), F.col("src") == F.col("u")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src != dst")
    least = down.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "u")
    moved = down.join(_sized(least, rows), F.col("src") == F.col("u")).where("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("dst", "src").cast("decimal(38,0)"))).first())


def propagate(nodes: DataFrame, edges: DataFrame, space: Workspace) -> DataFrame:
    """(node column, comp): every node with the smallest node of its component.

    ``nodes`` has one column of different values; ``edges`` has src and dst.
    """
    (name,) = nodes.columns
    now = space.save(edges.where("src != dst").distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        if not state[0]:
            break
        then = space.save(_small_star(_large_star(now, state[0]), state[0]).distinct())
        space.drop(now)
        now = then
    roots = now.groupBy("src").agg(F.min("dst").alias("comp"))
    out = space.save(nodes.join(_sized(roots, state[0]), F.col(name) == F.col("src"), "left").select(name, F.coalesce("comp", name).alias("comp")))
    space.drop(now)
    return out

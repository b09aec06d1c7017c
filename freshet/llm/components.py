"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import cut_lineage

#: Parts in which the edges of a node are joined.
SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); a component is named by its least node.

    Each round links the neighbours of every node to the least of them, first the larger ones,
    then the smaller ones, until all edges point straight to the least node of their component.
    Rounds grow with the logarithm of the size; each is cut into the checkpoint folder. Nothing
    but two sums per round reaches the driver. Nulls and loops are left out. Minima are partial
    aggregates; the neighbours of a node meet its minimum in `SALTS` parts, so the centre of a
    large star is not the work of one task.
    """
    def joined(rows: DataFrame, key: str, other: str, minima: DataFrame) -> DataFrame:
        spread = rows.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
        copies = minima.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return spread.join(copies, [key, "_salt"])

    def oriented(df: DataFrame) -> DataFrame:
        """Edges as (big, small), once each."""
        return df.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first())

    now = cut_lineage(oriented(edges))
    before, seen = None, state(now)
    while seen != before:
        # Large star: neighbours above a node go to the least of the node and its neighbours.
        both = now.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(now.select(F.col("small").alias("u"), F.col("big").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both.where("v > u"), "u", "v", least).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = oriented(large)
        # Small star: neighbours below a node and the node itself go to the least of them.
        lowest = large.groupBy("big").agg(F.min("small").alias("m"))
        small = joined(large, "big", "small", lowest).select(F.col("small").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(oriented(small.unionByName(lowest.select(F.col("big").alias("a"), F.col("m").alias("b")))))
        before, seen = seen, state(now)
    roots = now.select(F.col("small").alias("node")).distinct()
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(roots.withColumn("component", F.col("node")))

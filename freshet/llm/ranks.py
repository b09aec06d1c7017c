"""Gapless ranks within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one sort holds, and the most parts over all groups.
PART_ROWS = 1000
PARTS = 1 << 16


def rank_in_groups(df: DataFrame, group: str, counts: DataFrame, total: int, order: list[Column], rank: str) -> DataFrame:
    """`df` with `rank`: 0, 1, ... within each value of `group`.

    `counts` has one row per group, (`group`, `rows`), for a number of groups with a fixed bound;
    it is broadcast. A group is split into parts by a hash of `order`, so a group that holds most
    rows is sorted by many tasks; parts take the place of a total order, ties follow `order`. There are at most PARTS parts
    and one per group, so the running sums over parts are small too.
    """
    size = max(PART_ROWS, -(-total // PARTS))
    parts = counts.select(group, F.ceil(F.col("rows") / F.lit(size)).cast("long").alias("_parts"))
    spread = df.join(F.broadcast(parts), group).withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    filled = spread.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    running = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = filled.select(group, "_part", F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return (
        spread.withColumn("_at", within).join(before, [group, "_part"])
        .withColumn(rank, F.col("_before") + F.col("_at") - 1).drop("_at", "_before", "_part")
    )

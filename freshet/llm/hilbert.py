"""Shards along a Hilbert curve over several columns.

Each dimension is quantised at quantiles of its own; a row falls into a cell, cells are numbered
along the curve, and runs of the curve are cut into shards. Rows that are near in all dimensions
share a shard, so the minima and maxima of its file prune scans by any of them.

Everything is DataFrame functions. The cells are at most 2 ** (bits * dimensions); that bounds the
table of cells which is broadcast and the windows over cells, whatever the input.

Defined cases: null in a dimension is the lowest cell; ties and repeated rows are ordered by hash
and then by the given columns, equal rows are interchangeable; an empty table gives no rows;
dimensions may be numbers, dates or strings, which are compared as a whole by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.ranks import rank_in_groups
from freshet.session import cut_lineage

BITS = 4


def as_number(df: DataFrame, name: str) -> Column:
    """A column other than a string as a number that keeps its order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType | T.TimestampType):
        return F.unix_timestamp(F.col(name).cast("timestamp")).cast("double")
    return F.nanvl(F.col(name).cast("double"), F.lit(None))


def string_cuts(df: DataFrame, name: str, shares: list[float]) -> list[str]:
    """Exact quantiles of a string column: the least value with each share of the rows up to it.

    Equal values are counted first; distinct values are ranged over tasks, and running sums are taken
    within a task and over the totals of the tasks, so no task orders all values.
    """
    counted = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = cut_lineage(counted.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.sum("_c").alias("_in"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.withColumn("_upto", F.sum("_c").over(within)).join(starts, "_part").select("_v", (F.col("_start") + F.col("_upto")).alias("_upto"))
    total = ranged.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    row = upto.agg(*(F.min(F.when(F.col("_upto") >= total * q, F.col("_v"))).alias(f"q{k}") for k, q in enumerate(shares))).first()
    return [v for v in row if v is not None]


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """For each dimension its cell, 0 to 2 ** bits - 1, cut at quantiles of the data.

    Numbers are cut by one aggregate of mergeable summaries, strings by exact quantiles; the
    driver gets 2 ** bits - 1 values per dimension.
    """
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    strings = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [d for d in dims if d not in strings]
    row = df.agg(*(F.percentile_approx(as_number(df, d), shares, 10_000).alias(f"q{k}") for k, d in enumerate(numbers))).first() if numbers else []
    cuts = {d: string_cuts(df, d, shares) for d in strings} | dict(zip(numbers, row, strict=True))
    out = []
    for d in dims:
        value = F.col(d) if d in strings else as_number(df, d)
        out.append(sum((F.when(value > b, 1).otherwise(0) for b in sorted(set(cuts[d] or []))), F.lit(0)).cast("int"))
    return out


def curve_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell, from its coordinates (bits each).

    The coordinates are turned step by step from the highest bit on: where a bit is set the lower
    bits of the first axis are flipped, else they are exchanged with those of that axis. What is
    left is a Gray code whose bits, read across the axes, number the curve.
    """
    n = len(axes)
    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def turn(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        own = F.get(x, i)
        low = q - 1
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        flips = own.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, k: F.when(flips, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
            .otherwise(F.when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v)),
        )

    turned = F.aggregate(steps, F.array(*(a.cast("int") for a in axes)), turn)
    # Gray code: each axis takes up the ones before it.
    gray = F.aggregate(
        turned, F.array().cast("array<int>"),
        lambda done, v: F.concat(done, F.array(v.bitwiseXOR(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0))))),
    )
    fix = F.aggregate(
        F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), F.lit(0),
        lambda t, q: F.when(F.get(gray, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    order = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    return F.aggregate(
        order, F.lit(0).cast("long"),
        lambda h, at: h * 2 + F.get(gray, at["i"]).bitwiseXOR(fix).bitwiseAND(F.call_function("shiftleft", F.lit(1), at["b"])).cast("boolean").cast("long"),
    )


def shard_rows(df: DataFrame, dims: list[str], order: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """`df` with `curve` (place of its cell), `shard` and `slot` (0, 1, ... within the shard).

    Row counts of shards are at most one apart. `order` breaks ties inside a cell.
    """
    if len(dims) * bits > 16:
        raise ValueError("the table of cells is broadcast: at most 16 bits over all dimensions")
    names = [f"_d{k}" for k in range(len(dims))]
    placed = df.withColumns(dict(zip(names, quantised(df, dims, bits), strict=True)))
    counted = placed.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    cells = cut_lineage(counted.withColumn("curve", curve_index([F.col(c) for c in names], bits)))
    total = cells.agg(F.sum("rows")).first()[0] or 0
    before = F.coalesce(F.sum("rows").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select("curve", *names, before.alias("_start"))
    numbered = placed.join(F.broadcast(starts), names)
    ranked = rank_in_groups(numbered, "curve", cells.select("curve", "rows"), total, [F.col(c) for c in order], "_rank")
    rank = F.col("_start") + F.col("_rank")
    return (
        ranked.withColumn("_rank", rank)
        .withColumn("shard", F.expr(f"int((_rank * {shards}L) div {max(total, 1)}L)"))
        .withColumn("slot", F.expr(f"_rank - (shard * {total}L + {shards - 1}L) div {shards}L"))
        .drop(*names, "_start", "_rank")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows along the curve; readers prune files by any of the dimensions."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

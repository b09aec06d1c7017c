"""Calendar bins: interval resampling, block maxima and their quantiles, date spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.expressions import month_index


def date_spine(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Every day between each key's first and last day."""
    bounds = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    return bounds.select(*keys, F.explode(F.sequence("_a", "_b")).alias(time))


def resample(
    df: DataFrame, keys: list[str], window: int | Column, sums: list[str], maxima: list[str], time: str = "time"
) -> DataFrame:
    """Bins of `window` days anchored at each key's first day; a column over the keys gives each its own.

    Sums of an empty bin are 0 and maxima NULL. Empty bins are emitted by the bin before
    them, so no spine join is needed; the window, the aggregate and the gap filling all
    reuse one hash partitioning on the keys.
    """
    per_key = Window.partitionBy(*keys)
    days = window if isinstance(window, Column) else F.lit(window)
    binned = df.withColumn("_first", F.min(time).over(per_key)).withColumn(
        "_bin", F.floor(F.datediff(F.col(time), F.col("_first")) / days).cast("int")
    )
    aggregated = binned.groupBy(*keys, "_bin").agg(
        F.first("_first").alias("_first"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in maxima],
    )
    following = F.lead("_bin", 1).over(per_key.orderBy("_bin"))
    filled = aggregated.withColumn("_stop", F.coalesce(following - 1, F.col("_bin"))).withColumn(
        "_at", F.explode(F.sequence("_bin", "_stop"))
    )
    real = F.col("_at") == F.col("_bin")
    return filled.select(
        *keys,
        F.date_add(F.col("_first"), (F.col("_at") * days).cast("int")).alias(time),
        *[F.when(real, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in sums],
        *[F.when(real, F.col(c)).alias(c) for c in maxima],
    )


def half_year_block(time: Column, first: Column) -> Column:
    """Right-closed six-month bins: the first calendar month alone, then six months each."""
    return F.ceil((month_index(time) - month_index(first)) / F.lit(6)).cast("int")


def block_maxima(
    df: DataFrame, keys: list[str], col: str, period: str = "6m", time: str = "time"
) -> DataFrame:
    """Maximum of `col` per half-year or calendar-year block of each series.

    Rows collapse to calendar months by partial aggregation before the blocks are formed.
    """
    if period == "year":
        return df.groupBy(*keys, F.year(time).alias("block")).agg(F.max(col).alias("block_max"))
    if period != "6m":
        raise ValueError(f"unknown block period {period!r}")
    monthly = df.groupBy(*keys, F.trunc(time, "month").alias("_month")).agg(F.max(col).alias("_max"))
    first = F.min("_month").over(Window.partitionBy(*keys))
    blocks = monthly.withColumn("block", half_year_block(F.col("_month"), first))
    return blocks.groupBy(*keys, "block").agg(F.max("_max").alias("block_max"))


def block_quantiles(
    maxima: DataFrame, keys: list[str], percents: list[int], out: str = "thresholds", digits: int = 6
) -> DataFrame:
    """Sorted array of interpolated quantiles of the block maxima, rounded so ties are stable.

    A series has two maxima a year at most, so each group is a handful of values.
    """
    probabilities = F.array(*[F.lit(p / 100) for p in percents])
    quantiles = F.percentile("block_max", probabilities)
    return maxima.groupBy(*keys).agg(
        F.transform(quantiles, lambda x: F.round(x, digits)).alias(out)
    )

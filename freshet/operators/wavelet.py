"""Stationary wavelet transform and amplitude spectrum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# Daubechies wavelet with four vanishing moments, decomposition filters.
DB4_LOW = [
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
    -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
]
DB4_HIGH = [
    -0.2303778133088965, 0.7148465705529157, -0.6308807679298589, -0.027983769416859854,
    0.18703481171909309, 0.030841381835560764, -0.0328830116668852, -0.010597401785069032,
]


def impulse_response(level: int, high: bool) -> dict[int, float]:
    """Row offset -> weight of the detail (or smooth) of a level on the raw series.

    Level j filters the smooth of level j-1 with taps 2^(j-1) rows apart, tap k reading
    row n + (4 - k) 2^(j-1); filters are divided by sqrt 2 so energy is conserved.
    Chaining the levels gives one finite filter.
    """
    weights = {0: 1.0}
    for j in range(1, level + 1):
        taps = DB4_HIGH if high and j == level else DB4_LOW
        step = 2 ** (j - 1)
        chained: dict[int, float] = {}
        for offset, weight in weights.items():
            for k, tap in enumerate(taps):
                at = offset + (4 - k) * step
                chained[at] = chained.get(at, 0.0) + weight * tap / math.sqrt(2)
        weights = chained
    return weights


def swt(df: DataFrame, keys: list[str], columns: list[str], time: str = "time", levels: int = 3) -> DataFrame:
    """Details 1..levels and the last smooth of each column; the column itself is dropped.

    Beyond either end the series continues with its mean. One frame per column gathers
    the rows all filters read, so the transform is one sort whatever the level; each
    output is the product of that short array with its weights.
    """
    outputs = {f"details_{j}": impulse_response(j, True) for j in range(1, levels + 1)}
    outputs[f"smooths_{levels}"] = impulse_response(levels, False)
    reads = sorted(set().union(*outputs.values()))
    back, ahead = -reads[0], reads[-1]
    every = Window.partitionBy(*keys)
    ordered = every.orderBy(time)
    filled = df.select("*", *[F.avg(c).over(every).alias(f"_mean_{c}") for c in columns])
    filled = filled.withColumns({c: F.coalesce(c, f"_mean_{c}") for c in columns})
    near = filled.select(
        "*",
        F.row_number().over(ordered).alias("_rn"),
        F.count(F.lit(1)).over(every).cast("int").alias("_n"),
        *[F.collect_list(c).over(ordered.rowsBetween(-back, ahead)).alias(f"_near_{c}") for c in columns],
    )

    def padded(c: str) -> Column:
        before, after = F.greatest(back + 1 - F.col("_rn"), F.lit(0)), F.greatest(ahead - F.col("_n") + F.col("_rn"), F.lit(0))
        mean = F.col(f"_mean_{c}")
        return F.concat(F.array_repeat(mean, before), F.col(f"_near_{c}"), F.array_repeat(mean, after))

    whole = near.select(
        *[c for c in df.columns if c not in columns], *[padded(c).alias(f"_near_{c}") for c in columns]
    )

    def filtered(c: str, weights: dict[int, float]) -> Column:
        # The filter's taps as a literal array over the rows it reads.
        start, stop = min(weights), max(weights)
        taps = ", ".join(f"{weights.get(o, 0.0)!r}D" for o in range(start, stop + 1))
        part = f"slice(`_near_{c}`, {start + back + 1}, {stop - start + 1})"
        return F.expr(f"aggregate(zip_with({part}, array({taps}), (x, w) -> x * w), 0D, (acc, x) -> acc + x)")

    return whole.select(
        *[c for c in df.columns if c not in columns],
        *[filtered(c, weights).alias(f"{c}_{name}") for c in columns for name, weights in outputs.items()],
    )


def spectrum(
    df: DataFrame, keys: list[str], col: str, cycles_per_year: list[int], time: str = "time"
) -> DataFrame:
    """Amplitude of a series at the given yearly frequencies.

    Each row contributes a cosine and a sine per frequency; both are plain sums that
    combine before the shuffle, so a series of any length is spread over tasks.
    """
    angle = F.lit(2 * math.pi / 365.25) * F.col("cycles") * F.datediff(F.col(time), F.lit("1970-01-01").cast("date"))
    parts = (
        df.where(F.col(col).isNotNull())
        .select(*keys, time, col, F.explode(F.array(*[F.lit(k) for k in cycles_per_year])).alias("cycles"))
        .groupBy(*keys, "cycles")
        .agg(
            F.avg(F.col(col) * F.cos(angle)).alias("_re"),
            F.avg(F.col(col) * F.sin(angle)).alias("_im"),
        )
    )
    return parts.select(*keys, "cycles", F.sqrt(F.col("_re") ** 2 + F.col("_im") ** 2).alias("amplitude"))

"""Filling gaps of daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from freshet.operators import splines


def _so_far(keys: list[str], order: Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def interpolate_linear(
    df: DataFrame, keys: list[str], columns: list[str], time: str = "time", backfill: bool = False
) -> DataFrame:
    """Time-weighted linear interpolation between known values.

    The tail repeats the last value; the head stays NULL unless `backfill` copies the
    first value there. One shuffle serves all columns, with one sort in each direction:
    a frame that looks ahead without end would be rescanned for every row.
    """
    past = _so_far(keys, F.col(time).asc())
    future = _so_far(keys, F.col(time).desc())

    def last_known(w, value: str, day: str) -> list:
        return [
            F.last(e, ignorenulls=True).over(w).alias(f"{name}_{c}")
            for c in columns
            for name, e in ((value, F.col(c)), (day, F.when(F.col(c).isNotNull(), F.col(time))))
        ]

    known = df.select("*", *last_known(past, "_pv", "_pt")).select("*", *last_known(future, "_nv", "_nt"))

    def filled(c: str):
        pv, pt, nv, nt = (F.col(f"_{k}_{c}") for k in ("pv", "pt", "nv", "nt"))
        share = F.datediff(F.col(time), pt) / F.nullif(F.datediff(nt, pt), F.lit(0))
        between = F.when(pv.isNotNull() & nv.isNotNull(), pv + (nv - pv) * share)
        head = nv if backfill else F.lit(None)
        return F.coalesce(F.col(c), between, pv, head).alias(c)

    return known.select(*[filled(c) if c in columns else F.col(c) for c in df.columns])


def interpolate_spline(
    df: DataFrame, keys: list[str], columns: list[str], time: str = "time", backfill: bool = False, order: int = 3
) -> DataFrame:
    """Spline interpolation of order 3 or 2 per series; leading nulls stay unless `backfill`."""
    return splines.fill(df, keys, columns, time, backfill, order)


def interpolate_quadratic(
    df: DataFrame, keys: list[str], column: str, time: str = "time"
) -> DataFrame:
    """Quadratic through the nearest three known values, then back-fill of the head.

    Used for sparse variables. Runs on the known values' own small frame: each known
    value carries its neighbours, and a gap row looks up the last known one.
    """
    ordered = Window.partitionBy(*keys).orderBy(time)
    is_known = F.col(column).isNotNull()
    numbered = df.withColumn(
        "_k", F.count(F.when(is_known, 1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    by_known = Window.partitionBy(*keys).orderBy("_k")
    points = df.where(is_known).select(
        *keys,
        F.row_number().over(ordered).alias("_k"),
        *[e.alias(n) for n, e in {
            "_x1": F.col(time), "_y1": F.col(column),
        }.items()],
    )
    points = points.select(
        "*",
        *[f(c, n).over(by_known).alias(f"{c}{tag}") for c in ("_x1", "_y1")
          for f, n, tag in ((F.lag, 1, "p"), (F.lead, 1, "n"), (F.lead, 2, "nn"))],
    )
    # Three points around the gap: this, the next, and the previous (or the one after next).
    third_x = F.coalesce(F.col("_x1p"), F.col("_x1nn"))
    third_y = F.when(F.col("_x1p").isNotNull(), F.col("_y1p")).otherwise(F.col("_y1nn"))
    joined = numbered.join(
        points.withColumn("_x3", third_x).withColumn("_y3", third_y), [*keys, "_k"], "left"
    )
    t = F.datediff(F.col(time), F.col("_x1")).cast("double")
    b = F.datediff(F.col("_x1n"), F.col("_x1")).cast("double")
    c = F.datediff(F.col("_x3"), F.col("_x1")).cast("double")
    quadratic = (
        F.col("_y1") * (t - b) * (t - c) / (b * c)
        + F.col("_y1n") * t * (t - c) / (b * (b - c))
        + F.col("_y3") * t * (t - b) / (c * (c - b))
    )
    linear = F.col("_y1") + (F.col("_y1n") - F.col("_y1")) * t / b
    head = F.last(column, ignorenulls=True).over(_so_far(keys, F.col(time).desc()))
    value = F.coalesce(F.col(column), quadratic, linear, F.col("_y1"), head)
    return joined.select(*[value.alias(column) if n == column else F.col(n) for n in df.columns])

"""Descriptive tables: totals, means and variances by district, year and season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.expressions import SEASONS, season_of, step_down, step_up, year_season


def _spine(df: DataFrame, keys: list[str], periods: Column, name: str) -> DataFrame:
    """Every key with every period. The period list is one array, so no join is involved."""
    return df.select(*keys).distinct().withColumn(name, F.explode(periods))


def observed_periods(df: DataFrame, period: Column) -> Column:
    """The periods that occur anywhere in the table, as one array; the calendar bounds it."""
    return df.agg(F.array_sort(F.collect_set(period))).scalar()


def by_season(df: DataFrame, keys: list[str], measure: Column, out: str, time: str = "time") -> DataFrame:
    """Measure per key and season, all four seasons present."""
    grouped = df.groupBy(*keys, season_of(F.col(time)).alias("season")).agg(measure.alias(out))
    spine = _spine(df, keys, F.array(*[F.lit(s) for s in SEASONS]), "season")
    return spine.join(grouped, [*keys, "season"], "left")


def season_matrix(df: DataFrame, keys: list[str], measure: Column, time: str = "time") -> DataFrame:
    """Measure per key with one column per season."""
    return df.withColumn("season", season_of(F.col(time))).groupBy(*keys).pivot("season", SEASONS).agg(measure)


def by_year(df: DataFrame, measure: Column, out: str, years: tuple[int, int] | None = None, time: str = "time",
            zero: bool = False) -> DataFrame:
    """Measure for every year from the first to the last; a year without rows is NULL, or 0 for counts.

    The table gives the years; `years` asks for a range of its own instead.
    """
    spark = df.sparkSession
    grouped = df.groupBy(F.year(time).alias("year")).agg(measure.alias(out)).where("year is not null")
    if years is None:
        span = grouped.agg(F.sequence(F.min("year"), F.max("year")).alias("years"))
        spine = span.select(F.explode("years").alias("year"))
    else:
        spine = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year"))
    joined = spine.join(grouped, "year", "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(0))) if zero else joined


def per_period(
    df: DataFrame, keys: list[str], period: str, measure: Column, time: str = "time", zero: bool = True
) -> DataFrame:
    """Measure per key and period over every period seen in the table; empty ones are 0 or NULL."""
    periods = {"year": F.year(time), "year_season": year_season(F.col(time))}
    if period not in periods:
        raise ValueError(f"unknown period {period!r}; one of {sorted(periods)}")
    expr = periods[period]
    grouped = df.groupBy(*keys, expr.alias("period")).agg(measure.alias("value"))
    spine = _spine(df, keys, observed_periods(df, expr), "period")
    joined = spine.join(grouped, [*keys, "period"], "left")
    return joined.withColumn("value", F.coalesce("value", F.lit(0))) if zero else joined


def average_per_period(
    df: DataFrame, keys: list[str], period: str, measure: Column, time: str = "time", zero: bool = True
) -> DataFrame:
    """Average over periods of the measure; by season when the period is a year-season."""
    values = per_period(df, keys, period, measure, time, zero)
    if period == "year":
        return values.groupBy(*keys).agg(F.avg("value").alias("average"))
    season = F.split("period", " ", 2)[1]
    return values.groupBy(*keys, season.alias("season")).agg(F.avg("value").alias("average"))


def axis_bounds(df: DataFrame, column: str, step: float) -> DataFrame:
    """Smallest and largest value rounded outwards to a step."""
    return df.agg(
        step_down(F.min(column), step).alias("lower"), step_up(F.max(column), step).alias("upper")
    )

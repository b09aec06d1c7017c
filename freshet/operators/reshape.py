"""Projections, pivots and unpivots whose column lists are decided when the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F, types as T

from freshet.functions.expressions import SEASONS

# Quality threshold on the event score per country and level.
EVENT_QUALITY = {
    "uga": {"none": None, "medium": 3, "high": 6},
    "ken": {"none": None, "medium": 0, "high": 1},
}


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def select_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*columns_like(df, pattern))


def drop_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*columns_like(df, pattern))


def double_columns(df: DataFrame, last_first: bool = False) -> list[str]:
    """Names of the double columns, optionally with the last one moved to the front."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return names[-1:] + names[:-1] if last_first else names


def label_last(df: DataFrame, label: str = "flood") -> DataFrame:
    return df.select(*[c for c in df.columns if c != label], label)


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value: one counting pass, one row to the driver."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, from one aggregate row."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "n_null").orderBy("n_null", "column")


def null_mask(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns <c>_imp that tell which values were missing."""
    return df.select("*", *[F.col(c).isNull().alias(f"{c}_imp") for c in columns])


def links_long(links: DataFrame, name: str, station_cols: list[str]) -> DataFrame:
    """Wide district-station links to one row per link, null stations dropped."""
    long = links.withColumn(name, F.lower(name)).unpivot([name], station_cols, "_n", "station")
    return long.where(F.col("station").isNotNull()).select(F.col(name).alias("district"), "station")


def series_long(wide: DataFrame, time: str, stations: list[str]) -> DataFrame:
    return wide.unpivot([time], stations, "Stations", "dis")


def stations_wide(
    df: DataFrame, value_prefixes: dict[str, str], max_stations: int | None = None, district: str = "district",
    station: str = "station", time: str = "time"
) -> DataFrame:
    """One row per district and day; the n-th station by name becomes column <prefix><n>.

    The district's stations are numbered from its distinct station names, not by a
    window over its rows. Joins on time, so gaps in one station shift nothing. Without
    `max_stations` the data give the number of columns; with it, a district that has
    more stations is an error, never a cut.
    """
    names = df.select(district, station).distinct().withColumn(
        "_n", F.row_number().over(Window.partitionBy(district).orderBy(station))
    )
    if max_stations is None:
        max_stations = most_stations(df, district, station)
    else:
        too_many = F.raise_error(F.concat(F.lit(f"more than {max_stations} stations in "), district)).cast("int")
        names = names.withColumn("_n", F.when(F.col("_n") <= max_stations, F.col("_n")).otherwise(too_many))
    numbered = df.join(names, [district, station])
    cells = [
        F.max(F.when(F.col("_n") == n, F.col(c))).alias(f"{prefix}{n}")
        for c, prefix in value_prefixes.items() for n in range(1, max_stations + 1)
    ]
    return numbered.groupBy(district, time).agg(*cells)


def most_stations(df: DataFrame, district: str = "district", station: str = "station") -> int:
    """Largest number of stations of one district: the one number a wide layout needs beforehand."""
    per_district = df.select(district, station).distinct().groupBy(district).agg(F.count(station).alias("_k"))
    return per_district.agg(F.max("_k")).first()[0] or 1


def first_values(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """First non-null value of each column per key, in the order of `order`."""
    def first(c: str):
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)

    return df.groupBy(*keys).agg(*[first(c) for c in columns])


def season_dummies(df: DataFrame, season: str = "season", base: str = "fall") -> DataFrame:
    """0/1 column per season other than the base."""
    dummies = [(F.col(season) == s).cast("int").alias(s) for s in SEASONS if s != base]
    return df.select("*", *dummies).drop(season)


def level_dummies(df: DataFrame, column: str, levels: list[str], base: str) -> DataFrame:
    """0/1 column per known level other than the base."""
    return df.select("*", *[(F.col(column) == v).cast("int").alias(v) for v in levels if v != base])


def product_features(df: DataFrame, rain: str, shallow: str, mid: str, deep: str, soil: list[str]) -> DataFrame:
    """Rain times the top soil layer, second times fourth layer; the layers are dropped."""
    return df.select(
        "*",
        (F.col(shallow) * F.col(rain)).alias("rainSM_L1"),
        (F.col(mid) * F.col(deep)).alias("soilM_2x4"),
    ).drop(*soil)


def repair_keys(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[column])


def quality_events(df: DataFrame, country: str, score: str, level: str = "medium") -> DataFrame:
    """Events whose quality score exceeds the country's threshold for the level."""
    cut = EVENT_QUALITY[country][level]
    return df if cut is None else df.where(F.col(score) > cut)


def valid_scores(df: DataFrame, column: str, sentinels: tuple[str, ...] = ("1000", "1000.0", "none")) -> DataFrame:
    """Drop sentinel scores, then cast the rest to double."""
    text = F.col(column).cast("string")
    return df.where(~text.isin(*sentinels)).withColumn(column, text.try_cast("double"))


def row_max(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Row-wise maximum, nulls skipped."""
    best = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    return df.withColumn(out, best)


def row_argmin(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Name of the column that holds the row's minimum; the first wins ties."""
    smallest = F.least(*columns) if len(columns) > 1 else F.col(columns[0])
    names = F.coalesce(*[F.when(F.col(c) == smallest, F.lit(c)) for c in columns])
    return df.withColumn(out, names)

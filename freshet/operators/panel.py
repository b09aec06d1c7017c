"""Joins that build the (district, station, day) panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.expressions import season_of
from freshet.operators.reshape import repair_keys


def prepare_daily(df: DataFrame, district: str = "District", year: str = "Year", month: str = "Month",
                  day: str = "Day") -> DataFrame:
    """Key normalisation of a daily district table: lower-case district, DATE from its parts."""
    spent = {c.lower() for c in (district, year, month, day, "PCODE")}
    return df.select(
        F.lower(district).alias("district"),
        F.make_date(year, month, day).alias("time"),
        *[c for c in df.columns if c.lower() not in spent],
    )


def prepare_impact(df: DataFrame, area: str, date_format: str, start: str = "2000-01-01", date: str = "Date",
                   flood: str = "flood") -> DataFrame:
    """Impact records as (time, district, flood): parsed, cut off, lower-cased, then de-duplicated."""
    parsed = df.select(
        F.to_date(date, date_format).alias("time"), F.lower(area).alias("district"), F.col(flood).alias("flood")
    )
    return parsed.where(F.col("time") >= F.lit(start).cast("date")).na.drop().distinct()


def link_discharge(discharge: DataFrame, links: DataFrame) -> DataFrame:
    """Discharge of every linked station; rows with an incomplete value are dropped.

    The link table is tiny next to the discharge, so Spark broadcasts it by its size.
    """
    return discharge.join(links, "station").na.drop()


def attach_impact(panel: DataFrame, impact: DataFrame) -> DataFrame:
    """Left join on (time, district); a day without a record is not a flood."""
    return panel.join(impact, ["time", "district"], "left").withColumn(
        "flood", F.coalesce("flood", F.lit(0))
    )


def drop_quiet_districts(panel: DataFrame, label: str = "flood", district: str = "district") -> DataFrame:
    """Keep districts with at least one event."""
    active = panel.groupBy(district).agg(F.sum(label).alias("_f")).where(F.col("_f") > 0).select(district)
    return panel.join(active, district, "left_semi")


def attach_daily(panel: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left join daily district tables on (time, district)."""
    for table in tables:
        panel = panel.join(table, ["time", "district"], "left")
    return panel


def build_panel(
    discharge: DataFrame, links: DataFrame | None, impact: DataFrame, rain: DataFrame, soil: DataFrame | None,
    country: Column | str, district_repair: dict[str, str] | None = None
) -> DataFrame:
    """The model panel of one country. Without links, discharge already carries its district."""
    panel = link_discharge(discharge, links) if links is not None else discharge
    panel = drop_quiet_districts(attach_impact(panel, impact))
    if district_repair:
        rain = repair_keys(rain, "district", district_repair)
        soil = repair_keys(soil, "district", district_repair) if soil is not None else None
    panel = attach_daily(panel, *[t for t in (rain, soil) if t is not None])
    return panel.select(
        "*",
        F.concat("station", "district").alias("station_dis"),
        (country if isinstance(country, Column) else F.lit(country)).alias("Country"),
        season_of(F.col("time")).alias("season"),
    )


def clip_to_events(panel: DataFrame, impact: DataFrame, days: int = 7, time: str = "time") -> DataFrame:
    """Rows strictly inside (first event - days, last event + days), bounds as scalar subqueries."""
    low = impact.agg(F.date_sub(F.min(time), days)).scalar()
    high = impact.agg(F.date_add(F.max(time), days)).scalar()
    return panel.where((F.col(time) > low) & (F.col(time) < high))


def completeness(panel: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Series whose row count differs from the number of days the panel spans."""
    span = panel.agg((F.datediff(F.max(time), F.min(time)) + 1)).scalar()
    counts = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("n_days", span).where(F.col("n_rows") != F.col("n_days"))


def attach_vegetation(panel: DataFrame, vegetation: list[DataFrame]) -> DataFrame:
    """Vegetation of all countries stacked, then one left join; sparse in time."""
    stacked = vegetation[0]
    for table in vegetation[1:]:
        stacked = stacked.unionByName(table)
    return panel.join(stacked.select("district", "time", "EVI_mean"), ["district", "time"], "left")


def attach_static(panel: DataFrame, water: DataFrame, slope: DataFrame) -> DataFrame:
    """Water share and mean slope per district; one row per district, broadcast by size."""
    return panel.join(
        water.select("district", F.col("occurrence").alias("perc_water")), "district", "left"
    ).join(slope.select("district", F.col("mean").alias("avg_slope")), "district", "left")


def neighbour_edges(matrix: DataFrame, district: str = "District") -> DataFrame:
    """Adjacency matrix with 1 / empty cells to lower-cased edges."""
    names = [c for c in matrix.columns if c != district]
    long = matrix.select(
        F.col(district), *[F.col(f"`{c}`").cast("int").alias(c) for c in names]
    ).unpivot([district], names, "neighbour", "_v")
    return long.where(F.col("_v").isNotNull()).select(
        F.lower(district).alias("district"), F.lower("neighbour").alias("neighbour")
    ).distinct()


def neighbour_maxima(panel: DataFrame, edges: DataFrame, columns: list[str], district: str = "district",
                     time: str = "time") -> DataFrame:
    """Maximum of each column over a district's neighbours on the same day, left-joined."""
    features = panel.select(F.col(district).alias("neighbour"), time, *columns)
    maxima = (
        features.join(edges, "neighbour")
        .groupBy(district, time)
        .agg(*[F.max(c).alias(f"NB_{c}") for c in columns])
    )
    return panel.join(maxima, [district, time], "left")

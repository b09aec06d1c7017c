"""Writers. Partition columns become folders, so later reads prune them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RESULT_PARTITIONS = ["model", "window", "n_ahead", "wt"]


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scores of many configurations, one folder per (model, window, n_ahead, wt)."""
    df.write.mode(mode).partitionBy(*RESULT_PARTITIONS).parquet(path)


def write_per_station(df: DataFrame, path: str, station: str = "station", time: str = "time") -> None:
    """One folder per station. Years spread a station with many rows over several tasks."""
    spread = df.repartition(F.col(station), F.year(time))
    spread.write.mode("errorifexists").partitionBy(station).parquet(path)


def write_cube_by_year(df: DataFrame, path: str, time: str = "time") -> None:
    """Long form of a (lat, lon, time) cube, one folder per year."""
    df.withColumn("year", F.year(time)).write.mode("errorifexists").partitionBy("year").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def edges_to_wkt(edges: DataFrame, zone: str) -> DataFrame:
    """Polygon edges as one MULTILINESTRING text per zone.

    A zone's boundary is the unit that a layer file stores as one row.
    """
    segment = F.format_string("(%s %s, %s %s)", "x1", "y1", "x2", "y2")
    return edges.groupBy(zone).agg(
        F.concat(
            F.lit("MULTILINESTRING ("), F.array_join(F.array_sort(F.collect_list(segment)), ", "), F.lit(")")
        ).alias("wkt")
    )

"""Readers: CSV, parquet, JDBC, partitioned results, and the write-once cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from freshet.schemas import nan_to_null

# The period of the discharge archive.
ARCHIVE_START, ARCHIVE_END = "2000-01-01", "2019-12-01"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession, paths: str | list[str], schema: str, columns: list[str] | None = None
) -> DataFrame:
    """Latin-1 CSV whose columns are found by the names in the header of each file.

    The declared types are kept; a declared column that no header has is an error, further
    columns are dropped, and files of one read need the same header.
    """
    declared = T.StructType.fromDDL(schema)
    reader = spark.read.option("header", True).option("encoding", "ISO-8859-1")
    # With inference off only the first line is read here; a byte-order mark is not part of a name.
    header = reader.csv(paths).columns
    bare = {name.removeprefix("\ufeff").removeprefix("ï»¿"): name for name in header}
    if missing := [f.name for f in declared if f.name not in bare]:
        raise ValueError(f"columns {missing} are not in the header {list(bare)}")
    kinds = {bare[f.name]: f.dataType for f in declared}
    in_file = T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in header])
    df = reader.schema(in_file).option("enforceSchema", False).csv(paths)
    wanted = columns or declared.names
    return nan_to_null(df.select(*[F.col(f"`{bare[c]}`").alias(c) for c in wanted]))


def read_matrix(spark: SparkSession, path: str, key: str = "District") -> DataFrame:
    """A wide 1 / empty matrix in UTF-8 with or without a byte-order mark; every cell column is an int."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    header = [name.removeprefix("\ufeff") for name in reader.csv(path).columns]
    require = [key, *[c for c in header if c != key]]
    if key not in header:
        raise ValueError(f"no column {key!r} in {header}")
    table = reader.csv(path).toDF(*header)
    return table.select(key, *[F.col(f"`{c}`").cast("int").alias(c) for c in require[1:]])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; a column absent in one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_countries(frames: dict[str, DataFrame]) -> DataFrame:
    """Per-country frames stacked with the country as a literal column."""
    return union_all([df.withColumn("Country", F.lit(country)) for country, df in frames.items()])


def archive_period(df: DataFrame, time: str = "time", start: str = ARCHIVE_START, end: str = ARCHIVE_END) -> DataFrame:
    """Closed date range as a plain predicate, so it reaches the parquet or JDBC scan."""
    return df.where(F.col(time).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def discharge_jdbc_options(
    country: str,
    tables: dict[str, str],
    url: str,
    n_partitions: int = 64,
    start: str = ARCHIVE_START,
    end: str = ARCHIVE_END,
) -> dict[str, str]:
    """Options of a range-partitioned JDBC read of the country's discharge table."""
    if country not in tables:
        raise ValueError(f"no discharge table for {country!r}; one of {sorted(tables)}")
    return {
        "url": url,
        "dbtable": tables[country],
        "partitionColumn": "time",
        "lowerBound": start,
        "upperBound": end,
        "numPartitions": str(n_partitions),
    }


def read_discharge_jdbc(spark: SparkSession, country: str, tables: dict[str, str], url: str, **kwargs) -> DataFrame:
    """Daily discharge cells of a country; the period filter is evaluated by the database."""
    options = discharge_jdbc_options(country, tables, url, **kwargs)
    return archive_period(spark.read.format("jdbc").options(**options).load())


def read_results(spark: SparkSession, path: str, models: list[str] | None = None, wt: bool | None = None) -> DataFrame:
    """Result sets of all configurations in one read; filters prune partition folders."""
    df = spark.read.parquet(path).withColumn("wt", F.col("wt").cast("boolean"))
    if models is not None:
        df = df.where(F.col("model").isin(*models))
    if wt is not None:
        df = df.where(F.col("wt") == F.lit(wt))
    return df


def read_ranked_results(spark: SparkSession, path: str, ranking: str, most: int = 1) -> DataFrame:
    """Result sets of the configurations that a ranking table places up to `most`.

    The ranking (model, window, n_ahead, wt, rank) is a small table of its own. It is joined by the partition
    columns of the results, so Spark reads it first and then opens the folders of the chosen configurations only.
    """
    chosen = spark.read.parquet(ranking).where(F.col("rank") <= most)
    return read_results(spark, path).join(chosen, ["model", "window", "n_ahead", "wt"])


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table published at `path`; when there is none, build it, publish it, then read it back.

    A build goes to a folder of its own under `path`, and a marker that names it is written when it is
    complete. What an aborted build has left is never read; of two builders at once the last to finish is read.
    """
    marker = f"{path}/published"

    def published() -> str | None:
        try:
            row = spark.read.text(marker).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return row[0] if row else None

    name = published()
    if name is None:
        name = uuid.uuid4().hex
        build().write.mode("errorifexists").parquet(f"{path}/builds/{name}")
        spark.range(1).select(F.lit(name).alias("value")).coalesce(1).write.mode("overwrite").text(marker)
    return spark.read.parquet(f"{path}/builds/{name}")

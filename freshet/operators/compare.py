"""Comparison of models over districts.

Result tables hold one row per model, configuration and district: a group is at most as
long as the list of administrative districts, so the built-in exact median serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: one-sided normal quantile of the sign test.
SIGNIFICANCE_Z = 1.645


def sign_test(results: DataFrame, models: list[str], scores: list[str], district: str = "district") -> DataFrame:
    """For each ordered pair of models: wins, matched districts, Z, and significance.

    A district becomes one row with a column per model; the pairs are literals, so no
    join between models takes place and only pair totals are shuffled.
    """
    wide = results.where(F.col("model").isin(*models)).groupBy(district).agg(*[
        F.max(F.when(F.col("model") == m, F.col(s))).alias(f"{s}_{i}")
        for i, m in enumerate(models) for s in scores
    ])
    entries = [
        F.struct(
            F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(s).alias("score"),
            F.col(f"{s}_{i}").alias("x"), F.col(f"{s}_{j}").alias("y"),
        )
        for i, a in enumerate(models) for j, b in enumerate(models) if i != j for s in scores
    ]
    pairs = wide.select(F.explode(F.array(*entries)).alias("p")).select("p.*").na.drop(subset=["x", "y"])
    counted = pairs.groupBy("model_a", "model_b", "score").agg(
        F.count(F.when(F.col("x") > F.col("y"), 1)).alias("wins"), F.count(F.lit(1)).alias("n")
    )
    z = (F.col("wins") - F.col("n") / 2) / (0.5 * F.sqrt("n"))
    return counted.withColumn("z", z).withColumn("significant", F.col("z") >= SIGNIFICANCE_Z)


def best_model(results: DataFrame, models: list[str], score: str = "f1", district: str = "district") -> DataFrame:
    """Best model per district; the first in the list wins ties and a score must beat 0."""
    rank = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    rest = [c for c in results.columns if c not in (district, "model")]
    ranked = results.where(F.col("model").isin(*models) & (F.col(score) > 0))
    picked = ranked.groupBy(district).agg(
        F.max_by(F.struct("model", *rest), F.struct(F.col(score), -rank)).alias("_b")
    )
    return picked.select(district, F.col("_b.model").alias("best_model"), *[f"_b.{c}" for c in rest])


def score_matrix(results: DataFrame, score: str, aheads: list[int]) -> DataFrame:
    """Mean and median of a score by window (rows) and lead (columns)."""
    both = results.groupBy("window", "n_ahead").agg(F.avg(score).alias("avg"), F.median(score).alias("median"))
    cells = [
        F.max(F.when(F.col("n_ahead") == a, F.col(m))).alias(f"{m}_{a}") for a in aheads for m in ("avg", "median")
    ]
    return both.groupBy("window").agg(*cells)


def score_bins(df: DataFrame, count: str, score: str, width: int = 5, n_bins: int = 11) -> DataFrame:
    """Districts, mean and median score by bins of the event count; empty bins stay.

    The last bin is open and holds every larger count; an unknown count is 0 events.
    """
    place = F.floor(F.coalesce(F.col(count), F.lit(0)) / width)
    placed = df.withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(n_bins)).cast("int"))
    grouped = placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_districts"), F.avg(score).alias(f"avg_{score}"),
        F.median(score).alias(f"med_{score}"),
    )
    spine = df.sparkSession.range(n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    joined = spine.join(grouped, "bin", "left")
    low = F.col("bin") * width
    closed = F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))
    interval = F.when(F.col("bin") == n_bins, F.concat(low.cast("string"), F.lit("+"))).otherwise(closed)
    return joined.select(
        interval.alias("interval"), F.coalesce("n_districts", F.lit(0)).alias("n_districts"),
        f"avg_{score}", f"med_{score}",
    )


def score_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and median of every column over all districts, one row per column."""
    return df.unpivot([], columns, "column", "value").groupBy("column").agg(
        F.avg("value").alias("mean"), F.median("value").alias("median")
    )


def group_minima(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """All rows equal to their group's minimum; ties stay."""
    lowest = df.groupBy(*keys).agg(F.min(column).alias("_m"))
    return df.join(lowest, keys).where(F.col(column) == F.col("_m")).drop("_m")


def average_rank(df: DataFrame, keys: list[str], value: Column, out: str = "rank") -> DataFrame:
    """Descending rank within a key; tied values share the mean of their ranks.

    Groups are the features of one model, a short list.
    """
    w = Window.partitionBy(*keys)
    valued = df.withColumn("_v", value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_v"))
    return valued.withColumn(out, F.rank().over(w.orderBy(F.col("_v").desc())) + (ties - 1) / 2).drop("_v")


def ranks_over_folds(ranks: DataFrame, keys: list[str], folds: list[int], variable: str = "var") -> DataFrame:
    """One row per variable with its rank in each fold; variables missing in a fold are dropped."""
    cells = [F.max(F.when(F.col("fold") == k, F.col("rank"))).alias(f"rank_{k}") for k in folds]
    wide = ranks.groupBy(*keys, variable).agg(*cells, F.count(F.lit(1)).alias("_n"), F.sum("rank").alias("rank_sum"))
    return wide.where(F.col("_n") == len(folds)).drop("_n")

"""Contingency tables and skill scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.functions.expressions import event_skill_scores, skill_scores
from freshet.operators.windows import run_ids

CELLS = ["hits", "misses", "false_alarms", "corr_neg"]
SCORES = ["f1", "pod", "far", "pofd", "csi"]


def contingency(df: DataFrame, keys: list[str], obs: str = "flood", pred: str = "predicted") -> DataFrame:
    """Daily hits, misses, false alarms and correct negatives: four conditional sums."""
    o, p = F.col(obs) == 1, F.col(pred) == 1

    def count(condition):
        return F.count(F.when(condition, 1))

    return df.groupBy(*keys).agg(
        count(o & p).alias("hits"),
        count(o & ~p).alias("misses"),
        count(~o & p).alias("false_alarms"),
        count(~o & ~p).alias("corr_neg"),
    )


def add_skill(df: DataFrame) -> DataFrame:
    scores = skill_scores(*[F.col(c) for c in CELLS])
    return df.select("*", *[expr.alias(name) for name, expr in scores.items()])


def daily_scores(df: DataFrame, keys: list[str], obs: str = "flood", pred: str = "predicted") -> DataFrame:
    return add_skill(contingency(df, keys, obs, pred))


def event_scores(
    df: DataFrame, keys: list[str], order: str, obs: str = "flood", pred: str = "predicted", hits: str = "per_run"
) -> DataFrame:
    """Scores that treat a run of consecutive predicted days as one warning.

    hits="per_run" counts warnings that contain an event, "per_day" counts event days
    inside warnings. False alarms are warnings minus hits.
    """
    if hits not in ("per_run", "per_day"):
        raise ValueError(f"unknown hit mode {hits!r}")
    runs = run_ids(df, keys, order, pred)
    hit = (F.col(obs) == 1) & (F.col(pred) == 1)
    per_run = runs.groupBy(*keys, "run").agg(
        F.max(F.col(pred)).alias("_warning"),
        F.count(F.when(hit, 1)).alias("_hit_days"),
        F.count(F.when((F.col(obs) == 1) & (F.col(pred) == 0), 1)).alias("_misses"),
    )
    hit_count = F.count(F.when(F.col("_hit_days") > 0, 1)) if hits == "per_run" else F.sum("_hit_days")
    counted = per_run.groupBy(*keys).agg(
        hit_count.alias("hits"), F.sum("_warning").alias("_warnings"), F.sum("_misses").alias("misses")
    )
    table = counted.withColumn("false_alarms", F.col("_warnings") - F.col("hits")).drop("_warnings")
    return add_event_skill(table)


def add_event_skill(table: DataFrame) -> DataFrame:
    scores = event_skill_scores(F.col("hits"), F.col("misses"), F.col("false_alarms"))
    return table.withColumn("corr_neg", F.col("hits") + F.col("misses")).select(
        "*", *[expr.alias(name) for name, expr in scores.items()]
    )


def add_rates(df: DataFrame, total: str | None = None) -> DataFrame:
    """The four cells as shares of the number of scored rows; no rows give NULL."""
    n = F.nullif(F.col(total) if total else sum((F.col(c) for c in CELLS[1:]), F.col(CELLS[0])), F.lit(0))
    return df.select(*[(F.col(c) / n).alias(c) if c in CELLS else F.col(c) for c in df.columns])


def fold_summary(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample standard deviation over folds as avg_* and std_*."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in columns], *[F.stddev_samp(c).alias(f"std_{c}") for c in columns]
    )


def class_weights(df: DataFrame, label: str = "flood", balanced: bool = True) -> DataFrame:
    """Attach weight n / (2 n_c), or n / n_c, to every row of class c; the label is 0 or 1.

    One aggregate counts both classes; its single row is a scalar subquery.
    """
    sums = df.agg(F.struct(
        F.count(F.when(F.col(label) == 0, 1)).alias("n0"), F.count(F.when(F.col(label) == 1, 1)).alias("n1")
    ).alias("s")).scalar()
    own = F.when(F.col(label) == 1, F.col("_s.n1")).when(F.col(label) == 0, F.col("_s.n0")).otherwise(
        F.raise_error(F.lit("class weights need a label of 0 or 1")).cast("bigint")
    )
    weight = (F.col("_s.n0") + F.col("_s.n1")) / (own * (2 if balanced else 1))
    return df.withColumn("_s", sums).withColumn("weight", weight).drop("_s")

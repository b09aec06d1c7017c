"""Quantile-threshold classifiers, swept without replicating days by quantile.

A day's predictor falls above the first `level` of its series' sorted thresholds. Days
are counted per (series, level); suffix sums over at most 51 levels then give hits and
false alarms of every quantile at once. Folds work the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.expressions import threshold_objective
from freshet.operators.blocks import chronological_split, flood_count_folds
from freshet.operators.resample import block_maxima, block_quantiles, half_year_block
from freshet.operators.scores import CELLS, add_event_skill, add_rates, add_skill

PERCENTS = list(range(50, 100))
EVENT_PERCENTS = list(range(50, 91, 5))
N_FOLDS = 5


def level_of(x: Column, thresholds: Column) -> Column:
    """How many sorted thresholds the predictor reaches; NULL reaches none."""
    return F.coalesce(F.size(F.filter(thresholds, lambda t: t <= x)), F.lit(0))


def _suffix_sums(counts: DataFrame, keys: list[str], measures: list[str], percents: list[int]) -> DataFrame:
    """For every percent: sums over its level and all higher ones, plus the totals.

    The histogram of a series, at most one entry per level, becomes one array.
    """
    packed = counts.groupBy(*keys).agg(F.collect_list(F.struct("_level", *measures)).alias("_h"))
    each = packed.select("*", F.posexplode(F.array(*[F.lit(p) for p in percents])).alias("_i", "percent"))
    each = each.withColumn("_level", F.col("_i") + 1)
    zero = F.lit(0).cast("long")

    def total(m: str, from_level: Column | None = None) -> Column:
        def add(acc: Column, entry: Column) -> Column:
            part = entry[m] if from_level is None else F.when(entry["_level"] >= from_level, entry[m]).otherwise(zero)
            return acc + part

        return F.aggregate("_h", zero, add)

    return each.select(
        *keys, "percent", "_level",
        *[total(m, F.col("_level")).alias(m) for m in measures],
        *[total(m).alias(f"{m}_total") for m in measures],
    )


def _cells(table: DataFrame, keep: list[str]) -> DataFrame:
    hits, alarms = F.col("_floods"), F.col("_rows") - F.col("_floods")
    floods = F.col("_floods_total")
    dry = F.col("_rows_total") - floods
    return table.select(
        *keep,
        hits.alias("hits"),
        (floods - hits).alias("misses"),
        alarms.alias("false_alarms"),
        (dry - alarms).alias("corr_neg"),
    )


def sweep_scores(
    days: DataFrame,
    thresholds: DataFrame,
    keys: list[str],
    predictor: str,
    percents: list[int] = PERCENTS,
    label: str = "flood",
) -> DataFrame:
    """Contingency table and scores of every quantile threshold of every series."""
    counts = (
        days.join(thresholds, keys)
        .withColumn("_level", level_of(F.col(predictor), F.col("thresholds")))
        .groupBy(*keys, "_level")
        .agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col(label) == 1, 1)).alias("_floods"))
    )
    sums = _suffix_sums(counts, keys, ["_rows", "_floods"], percents)
    named = sums.join(thresholds, keys).withColumn("threshold", F.element_at("thresholds", F.col("_level")))
    return add_skill(_cells(named, [*keys, "percent", "threshold"]))


def threshold_scores(
    days: DataFrame, keys: list[str], predictor: str, block_col: str = "max_dt_3days",
    percents: list[int] = PERCENTS, label: str = "flood"
) -> DataFrame:
    """Sweep with thresholds taken from the half-year maxima of the same rows."""
    thresholds = block_quantiles(block_maxima(days, keys, block_col), keys, percents)
    return sweep_scores(days, thresholds, keys, predictor, percents, label)


def best_by(
    scores: DataFrame, keys: list[str], score: str, ties: list[str], highest: bool = True
) -> DataFrame:
    """The row with the best score per key; ties go to the smallest tie columns, NULLs last.

    Where every score of a key is NULL, the most hits decide if the table has them.

    A struct minimum, so it combines partially and a hot key never needs a sort.
    """
    rank = -F.col(score) if highest else F.col(score)
    rest = [c for c in scores.columns if c not in {*keys, *ties}]
    instead = [F.when(rank.isNull(), -F.col("hits")).alias("_hits")] if "hits" in rest else []
    order = F.struct(rank.isNull().alias("_null"), rank.alias("_rank"), *instead, *ties)
    picked = scores.groupBy(*keys).agg(F.min_by(F.struct(*ties, *rest), order).alias("_best"))
    return picked.select(*keys, "_best.*")


def supported(days: DataFrame, minimum: int = 2, district: str = "district", station: str = "station",
              label: str = "flood") -> DataFrame:
    """Keep districts whose event total per station reaches the minimum."""
    total = days.groupBy(district, station).agg(F.sum(label).alias("_f"))
    kept = total.groupBy(district).agg((F.sum("_f") / F.count(F.lit(1))).alias("_per")).where(
        F.col("_per") >= minimum
    )
    return days.join(kept.select(district), district, "left_semi")


def fit_threshold(
    days: DataFrame, predictor: str, loss: str = "f1", block_col: str = "max_dt_3days",
    percents: list[int] = PERCENTS
) -> DataFrame:
    """Pick (station, quantile) per district on the early events, score it on the late ones."""
    keys = ["district", "station"]
    split = chronological_split(supported(days), keys, "time")
    train = split.where(F.col("is_train"))
    thresholds = block_quantiles(block_maxima(train, keys, block_col), keys, percents)
    # Early and late days are counted in their levels together: one pass gives both tables.
    levels = (
        split.join(thresholds, keys)
        .withColumn("_level", level_of(F.col(predictor), F.col("thresholds")))
        .groupBy(*keys, "_level")
        .agg(*[F.count(F.when(condition, 1)).alias(name) for name, condition in {
            "_rows": F.col("is_train"),
            "_floods": F.col("is_train") & (F.col("flood") == 1),
            "_rows_test": ~F.col("is_train"),
            "_floods_test": ~F.col("is_train") & (F.col("flood") == 1),
        }.items()])
    )
    sums = _suffix_sums(levels, keys, ["_rows", "_floods", "_rows_test", "_floods_test"], percents)
    sums = sums.join(thresholds, keys).withColumn("threshold", F.element_at("thresholds", F.col("_level")))
    tests = [f"{m}{suffix}" for m in ("_rows_test", "_floods_test") for suffix in ("", "_total")]
    trained = add_skill(_cells(sums, [*keys, "percent", "threshold", *tests]))
    best = best_by(trained, ["district"], loss, ["station", "percent"]).where(F.col("_rows_test_total") > 0)
    named = best.select(*keys, "percent", "threshold", *[F.col(c).alias(c.replace("_test", "")) for c in tests])
    scored = add_skill(_cells(named, [*keys, "percent", "threshold", "_rows_total"]))
    return scored.withColumnRenamed("_rows_total", "n_test").withColumn("n_floods", F.col("hits") + F.col("misses"))


def cross_validate_thresholds(
    days: DataFrame, predictor: str, loss: str = "f1", block_col: str = "max_dt_3days",
    percents: list[int] = PERCENTS
) -> DataFrame:
    """Five-fold scores of the best quantile per (district, station, fold).

    Thresholds of a fold come from the other folds' monthly maxima, a table small enough
    to copy per fold. Each day is counted in its level against all five threshold sets
    before anything is shuffled.
    """
    keys = ["district", "station"]
    folded = flood_count_folds(days, keys, "time", n_folds=N_FOLDS)
    monthly = folded.groupBy(*keys, "fold", F.trunc("time", "month").alias("_month")).agg(
        F.max(block_col).alias("_max")
    )
    held_out = monthly.withColumn(
        "test_fold", F.explode(F.sequence(F.lit(1), F.lit(N_FOLDS)))
    ).where(F.col("fold") != F.col("test_fold"))
    fkeys = [*keys, "test_fold"]
    first = F.min("_month").over(Window.partitionBy(*fkeys))
    maxima = (
        held_out.withColumn("block", half_year_block(F.col("_month"), first))
        .groupBy(*fkeys, "block")
        .agg(F.max("_max").alias("block_max"))
    )
    thresholds = block_quantiles(maxima, fkeys, percents)
    per_series = thresholds.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("test_fold", "thresholds"))).alias("_sets")
    )
    levels = (
        folded.join(per_series, keys)
        .select(*keys, "fold", "flood", predictor, F.explode("_sets").alias("test_fold", "thresholds"))
        .withColumn("_level", level_of(F.col(predictor), F.col("thresholds")))
        .withColumn("is_test", F.col("fold") == F.col("test_fold"))
        .groupBy(*fkeys, "_level")
        .agg(*[
            F.count(F.when(condition, 1)).alias(name)
            for name, condition in {
                "_rows": ~F.col("is_test"),
                "_floods": ~F.col("is_test") & (F.col("flood") == 1),
                "_rows_test": F.col("is_test"),
                "_floods_test": F.col("is_test") & (F.col("flood") == 1),
            }.items()
        ])
    )
    measures = ["_rows", "_floods", "_rows_test", "_floods_test"]
    sums = _suffix_sums(levels, fkeys, measures, percents)
    tests = [f"{m}{suffix}" for m in ("_rows_test", "_floods_test") for suffix in ("", "_total")]
    trained = add_skill(_cells(sums, [*fkeys, "percent", *tests]))
    best = best_by(trained, fkeys, loss, ["percent"])
    renamed = best.select(
        *fkeys, "percent", *[F.col(c).alias(c.replace("_test", "")) for c in tests]
    )
    scored = add_skill(_cells(renamed, [*fkeys, "percent", "_rows_total"]))
    return scored.withColumnsRenamed({"_rows_total": "n_test"}).withColumn(
        "n_floods", F.col("hits") + F.col("misses")
    )


def best_station(folds: DataFrame, loss: str = "f1") -> DataFrame:
    """Mean and standard deviation over folds for each district's best station."""
    columns = ["f1", *CELLS, "csi", "pod", "far", "pofd", "n_floods"]
    rates = add_rates(folds, "n_test")
    summary = rates.groupBy("district", "station").agg(
        *[F.avg(c).alias(f"avg_{c}") for c in columns], *[F.stddev_samp(c).alias(f"std_{c}") for c in columns]
    )
    return best_by(summary, ["district"], f"avg_{loss}", ["station"])


def event_sweep(
    days: DataFrame, thresholds: DataFrame, keys: list[str], predictor: str, percents: list[int],
    label: str = "flood", hits: str = "per_run", time: str = "time"
) -> DataFrame:
    """Event-based scores of every threshold from one ordered pass over each series.

    A warning at level q starts where the day's level reaches q and the previous day's
    does not, so warnings are a difference of two level counts. An event is the first in
    its warning unless every level since the previous event, that one included, reached
    q; that is a difference of two level counts as well.
    """
    levels = days.join(thresholds, keys).withColumn("_l", level_of(F.col(predictor), F.col("thresholds")))
    w = Window.partitionBy(*keys).orderBy(time)
    flagged = levels.select(
        *keys,
        time,
        "_l",
        F.coalesce((F.col(label) == 1).cast("int"), F.lit(0)).alias("_e"),
        F.coalesce(F.lag("_l").over(w), F.lit(0)).alias("_prev"),
    )
    flagged = flagged.withColumn(
        "_seg", F.coalesce(F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn(
        "_last_event", F.last(F.when(F.col("_e") == 1, F.col("_l")), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)
        )
    ).withColumn("_low", F.min("_l").over(Window.partitionBy(*keys, "_seg")))
    joined_from = F.least(F.coalesce(F.col("_last_event"), F.lit(0)), F.col("_low"))

    def entry(level: Column, warnings: int, firsts: Column, events: Column) -> Column:
        return F.struct(
            level.alias("_level"), F.lit(warnings).alias("_warnings"), firsts.alias("_firsts"),
            events.alias("_events"),
        )

    zero = F.lit(0)
    event = F.col("_e")
    spread = flagged.select(*keys, F.explode(F.array(
        entry(F.col("_l"), 1, event, event),
        entry(F.least(F.col("_l"), F.col("_prev")), -1, zero, zero),
        entry(joined_from, 0, -event, zero),
    )).alias("_s")).select(*keys, "_s.*")
    counts = spread.groupBy(*keys, "_level").agg(
        *[F.sum(m).alias(m) for m in ("_warnings", "_firsts", "_events")]
    )
    sums = _suffix_sums(counts, keys, ["_warnings", "_firsts", "_events"], percents)
    hit = F.col("_firsts") if hits == "per_run" else F.col("_events")
    table = sums.join(thresholds, keys).select(
        *keys,
        "percent",
        F.element_at("thresholds", F.col("_level")).alias("threshold"),
        hit.alias("hits"),
        (F.col("_events_total") - F.col("_events")).alias("misses"),
        (F.col("_warnings") - hit).alias("false_alarms"),
    )
    return add_event_skill(table)


def optimise_threshold(scored: DataFrame, weight_far: float = 0.5) -> DataFrame:
    """Objective of every (station, quantile) and the minimum per district."""
    scored = scored.withColumn("objective", threshold_objective(F.col("pod"), F.col("far"), weight_far))
    return best_by(scored, ["district"], "objective", ["station", "percent"], highest=False)

"""Event-centred blocks, folds and splits, and sequences for the panel classifier.

Frames here hold one row per (district, time) or (district, station, time); a DATE
order column bounds every window partition by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

N_FOLDS = 5


def half_width(window: int | Column | None) -> int | Column:
    """Rows kept on each side of an event: 60 days of intervals, or 21 daily rows.

    A column, over the key alone, gives every key its own interval length.
    """
    if isinstance(window, Column):
        return F.ceil(60 / window).cast("int")
    return 21 if window is None else math.ceil(60 / window)


def event_islands(df: DataFrame, window: int | Column | None, key: str = "district", time: str = "time",
                  label: str = "flood") -> DataFrame:
    """One row per block of events at most I rows apart: bounds in rows, clipped to the series."""
    reach = half_width(window)
    w = Window.partitionBy(key).orderBy(time)
    numbered = df.select(
        key, time, label,
        F.row_number().over(w).alias("rn"),
        F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n"),
    )
    events = numbered.where(F.col(label) == 1)
    apart = F.col("rn") - F.lag("rn").over(w)
    opened = events.withColumn("_open", F.coalesce((apart > reach).cast("int"), F.lit(1)))
    islands = opened.withColumn("block", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "block").agg(
        F.min("rn").alias("first_event"),
        F.max("rn").alias("last_event"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.count(F.lit(1)).alias("n_events"),
        F.greatest(F.min("rn") - reach, F.lit(1)).alias("lo"),
        F.least(F.max("rn") + reach, F.max("_n")).alias("hi"),
    )


def trim_islands(islands: DataFrame, window: int | Column | None, key: str = "district") -> DataFrame:
    """Share overlapping rows between neighbouring blocks: two thirds to the later one.

    e rows overlap when the events of two blocks are at most 2I intervals apart; the
    earlier block loses its last e - e//3 rows and the later one its first e//3.
    """
    reach, days = half_width(window), 1 if window is None else window
    w = Window.partitionBy(key).orderBy("block")

    def overlap(earlier_time, later_time):
        gap = F.ceil(F.datediff(later_time, earlier_time) / (days if isinstance(days, Column) else F.lit(days)))
        return F.when(gap <= 2 * reach, 2 * reach - gap + 1).otherwise(F.lit(0))

    with_next = overlap(F.col("last_time"), F.lead("first_time").over(w))
    with_previous = overlap(F.lag("last_time").over(w), F.col("first_time"))
    shared = islands.withColumn("_after", F.coalesce(with_next, F.lit(0))).withColumn(
        "_before", F.coalesce(with_previous, F.lit(0))
    )
    return shared.withColumn("hi", F.col("hi") - (F.col("_after") - F.floor(F.col("_after") / 3))).withColumn(
        "lo", F.col("lo") + F.floor(F.col("_before") / 3)
    ).drop("_after", "_before")


def block_rows(df: DataFrame, islands: DataFrame, key: str = "district", time: str = "time") -> DataFrame:
    """Rows of every block. Each island lists its row numbers, so the join is an equi-join."""
    numbered = df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(time)))
    members = islands.select(key, "block", F.explode(F.sequence("lo", "hi")).alias("rn"))
    return numbered.join(members, [key, "rn"]).drop("rn")


def event_blocks(df: DataFrame, window: int | Column | None, key: str = "district", time: str = "time",
                 label: str = "flood", trim: bool = True) -> DataFrame:
    """Cut the panel around its events; blocks are numbered by first day within a key."""
    islands = event_islands(df, window, key, time, label)
    return block_rows(df, trim_islands(islands, window, key) if trim else islands, key, time)


def block_folds(blocked: DataFrame, key: str = "district", n_folds: int = N_FOLDS) -> DataFrame:
    """Blocks go round-robin to folds 1..n in block order, as a column and not as a join."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("block"))
    return blocked.withColumn("fold", ((rank - 1) % n_folds + 1).cast("int"))


def events_around(blocked: DataFrame, keys: list[str], time: str = "time", label: str = "flood") -> DataFrame:
    """Earliest and latest event of every block."""
    event_time = F.when(F.col(label) == 1, F.col(time))
    return blocked.groupBy(*keys).agg(
        F.min(event_time).alias("earliest_event"),
        F.max(event_time).alias("latest_event"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def flood_count_folds(df: DataFrame, keys: list[str], time: str, n_folds: int = N_FOLDS,
                      label: str = "flood", out: str = "fold") -> DataFrame:
    """Contiguous folds with equal event counts; a fold ends on an event row.

    Boundary j sits after j*k events, k = n // n_folds; a remainder of two or more gives
    the first folds one event more each. A row's fold is one more than the number of
    boundaries passed before it. Series with fewer events than folds are dropped.
    """
    every = Window.partitionBy(*keys)
    before = every.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("_all", F.sum(label).over(every)).where(F.col("_all") >= n_folds)
    counted = counted.withColumn("_seen", F.coalesce(F.sum(label).over(before), F.lit(0)))
    per_fold = F.floor(F.col("_all") / n_folds)
    rest = F.col("_all") % n_folds
    fold = F.lit(1)
    for j in range(1, n_folds):
        boundary = j * per_fold + F.when(rest >= 2, F.least(F.lit(j), rest)).otherwise(F.lit(0))
        fold = fold + (F.col("_seen") >= boundary).cast("int")
    return counted.withColumn(out, fold).drop("_all", "_seen")


def chronological_split(df: DataFrame, keys: list[str], time: str, test_share: float = 0.2,
                        label: str = "flood") -> DataFrame:
    """Train rows run to event number n - ceil(0.2 n); the rest is test.

    Series whose train part would hold no event are dropped.
    """
    every = Window.partitionBy(*keys)
    before = every.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(label).over(every)
    bound = F.floor(total - F.ceil(test_share * total))
    return (
        df.withColumn("_bound", bound)
        .where(F.col("_bound") >= 1)
        .withColumn("is_train", F.coalesce(F.sum(label).over(before), F.lit(0)) < F.col("_bound"))
        .drop("_bound")
    )


def support_report(df: DataFrame, district: str = "district", station: str = "station", label: str = "flood",
                   minimum: int = 2, n_folds: int = N_FOLDS) -> DataFrame:
    """Why a district can or cannot be modelled; nothing is silently skipped."""
    per_station = df.groupBy(district, station).agg(
        F.sum(label).alias("_f"), F.max(label).alias("_hi"), F.min(label).alias("_lo")
    )
    per_district = per_station.groupBy(district).agg(
        (F.sum("_f") / F.count(F.lit(1))).alias("events_per_station"),
        F.max("_f").alias("max_events"),
        (F.max("_hi") > F.min("_lo")).alias("_two_classes"),
    )
    reason = (
        F.when(~F.col("_two_classes"), "one class")
        .when(F.col("events_per_station") < minimum, "too few events")
        .when(F.col("max_events") < n_folds, "fewer events than folds")
        .otherwise("ok")
    )
    return per_district.select(district, "events_per_station", "max_events", reason.alias("reason"))


def block_support(blocked: DataFrame, key: str = "district", n_folds: int = N_FOLDS) -> DataFrame:
    """Blocks per key, and whether outer and inner cross-validation are possible."""
    folds = block_folds(blocked, key, n_folds).select(key, "block", "fold").distinct()
    per_fold = folds.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("_b"))
    summary = per_fold.groupBy(key).agg(F.sum("_b").alias("n_blocks"), F.max("_b").alias("_largest"))
    train_blocks = F.col("n_blocks") - F.col("_largest")
    reason = (
        F.when(F.col("n_blocks") < n_folds, "fewer blocks than folds")
        .when(train_blocks <= 2, "too few training blocks")
        .otherwise("ok")
    )
    inner = F.when(train_blocks >= n_folds, F.lit(n_folds)).when(train_blocks > 2, train_blocks).otherwise(F.lit(0))
    return summary.select(key, "n_blocks", inner.cast("int").alias("inner_folds"), reason.alias("reason"))


def sequences(df: DataFrame, keys: list[str], time: str, features: list[str], steps: int,
              label: str = "flood") -> DataFrame:
    """Sliding sequences of `steps` rows with the label of the last row."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(steps - 1), 0)
    step = F.array(*[F.col(c).cast("double") for c in features])
    return (
        df.withColumn("sequence", F.collect_list(step).over(w))
        .where(F.size("sequence") == steps)
        .select(*keys, time, "sequence", label)
    )


def sequence_steps(window: int) -> int:
    """Intervals that span a month and a half."""
    return math.ceil(45 / window)

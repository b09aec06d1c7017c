"""Row-frame and day-range features of ordered series.

A series is one row per (keys, time). With a DATE order column the calendar bounds its
length, so one window partition per series is safe however many raw rows went into it.
With a TIMESTAMP order column a series has no such bound: it is cut into slices of
`SLICE_ROWS` rows, each slice carries the few neighbour rows its frames reach, and no
task ever orders a whole series. Both forms give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

SLICE_ROWS = 4096

Frames = dict[str, Callable[[WindowSpec], Column]]


def row_positions(df: DataFrame, keys: list[str], order: str, out: str = "pos", span: str = "month") -> DataFrame:
    """Dense 1-based position within each series, numbered span by span.

    Only (keys, span) counts are accumulated over a series; rows are ordered within a span.
    """
    df = df.withColumn("_span", F.date_trunc(span, F.col(order)))
    totals = df.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_span").orderBy(order)
    numbered = df.withColumn("_rn", F.row_number().over(within)).join(offsets, [*keys, "_span"])
    return numbered.withColumn(out, F.col("_offset") + F.col("_rn")).drop("_span", "_rn", "_offset")


def add_frames(
    df: DataFrame,
    keys: list[str],
    order: str,
    frames: Frames,
    back: int,
    ahead: int,
    slice_rows: int | None = None,
) -> DataFrame:
    """Append window columns whose frames reach `back` rows back and `ahead` rows ahead."""
    if slice_rows is None and not isinstance(df.schema[order].dataType, T.DateType):
        slice_rows = SLICE_ROWS
    if slice_rows is None:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select("*", *[make(w).alias(name) for name, make in frames.items()])
    columns = df.columns
    pos = F.col("_pos") - 1
    first = F.greatest(F.floor((pos - ahead) / slice_rows), F.lit(0))
    last = F.floor((pos + back) / slice_rows)
    tiled = (
        row_positions(df, keys, order, "_pos")
        .withColumn("_home", F.floor(pos / slice_rows))
        .withColumn("_slice", F.explode(F.sequence(first, last)))
    )
    w = Window.partitionBy(*keys, "_slice").orderBy("_pos")
    framed = tiled.select("*", *[make(w).alias(name) for name, make in frames.items()])
    return framed.where(F.col("_slice") == F.col("_home")).select(*columns, *frames)


def _full_max(col: str, start: int, end: int, min_valid: int | None = None) -> Callable[[WindowSpec], Column]:
    """Maximum over a row frame; NULL when fewer than `min_valid` values are present."""
    needed = min_valid if min_valid is not None else end - start + 1

    def make(w: WindowSpec) -> Column:
        frame = w.rowsBetween(start, end)
        return F.when(F.count(col).over(frame) >= needed, F.max(col).over(frame))

    return make


def centred_max(
    df: DataFrame, keys: list[str], order: str, col: str, out: str = "max_dt_3days", half: int = 3,
    min_valid: int = 3, **kw
) -> DataFrame:
    return add_frames(df, keys, order, {out: _full_max(col, -half, half, min_valid)}, half, half, **kw)


def future_max(
    df: DataFrame, keys: list[str], order: str, col: str, horizons: tuple[int, ...] = (3, 4, 5, 6, 7), **kw
) -> DataFrame:
    frames = {f"max_future_{k}days": _full_max(col, 1, k) for k in horizons}
    return add_frames(df, keys, order, frames, 0, max(horizons), **kw)


def discharge_features(
    df: DataFrame, keys: list[str], order: str, col: str = "dis", horizons: tuple[int, ...] = (3, 4, 5, 6, 7), **kw
) -> DataFrame:
    """Centred and future maxima from one sort of each series."""
    frames = {"max_dt_3days": _full_max(col, -3, 3, 3)}
    frames |= {f"max_future_{k}days": _full_max(col, 1, k) for k in horizons}
    return add_frames(df, keys, order, frames, 3, max(3, *horizons), **kw)


def trailing_max(df: DataFrame, keys: list[str], order: str, outs: dict[str, str], days: int = 14, **kw) -> DataFrame:
    """Maximum over the last `days` rows; `outs` maps each input column to its output."""
    frames = {out: _full_max(col, -(days - 1), 0) for col, out in outs.items()}
    return add_frames(df, keys, order, frames, days - 1, 0, **kw)


def spread_label_back(
    df: DataFrame, keys: list[str], order: str, label: str = "flood", days: int = 2, **kw
) -> DataFrame:
    """An event marks its own row and the `days` rows before; incomplete frames are dropped."""
    spread = add_frames(df, keys, order, {"_spread": _full_max(label, 0, days)}, 0, days, **kw)
    return (
        spread.where(F.col("_spread").isNotNull())
        .withColumn(label, F.col("_spread"))
        .drop("_spread")
    )


def horizon_label(
    df: DataFrame, keys: list[str], order: str, predictor: str, window: int, n_ahead: int,
    label: str = "flood", **kw
) -> DataFrame:
    """Label: any event in rows i+n_ahead .. i+n_ahead+window-1; predictor led by n_ahead-1.

    Rows whose frame is incomplete are dropped; the old label stays as `<label>_old`.
    """
    last = n_ahead + window - 1
    frames: Frames = {
        "_label": _full_max(label, n_ahead, last),
        "_predictor": lambda w: F.lead(predictor, n_ahead - 1).over(w) if n_ahead > 1 else F.col(predictor),
    }
    shifted = add_frames(df, keys, order, frames, 0, last, **kw)
    return (
        shifted.withColumnRenamed(label, f"{label}_old")
        .withColumn(label, F.col("_label"))
        .withColumn(predictor, F.col("_predictor"))
        .drop("_label", "_predictor")
        .na.drop(subset=[label, predictor])
    )


def horizon_labels(
    df: DataFrame, keys: list[str], order: str, predictor: str, configs: list[tuple[int, int]],
    label: str = "flood", **kw
) -> DataFrame:
    """`horizon_label` for many (window, n_ahead) at once, told apart by two columns.

    All frames share one sort; rows are copied per configuration after it.
    """
    frames: Frames = {}
    for i, (window, n_ahead) in enumerate(configs):
        frames[f"_l{i}"] = _full_max(label, n_ahead, n_ahead + window - 1)
        frames[f"_p{i}"] = lambda w, k=n_ahead - 1: F.lead(predictor, k).over(w) if k else F.col(predictor)
    reach = max(window + n_ahead - 1 for window, n_ahead in configs)
    framed = add_frames(df, keys, order, frames, 0, reach, **kw)
    rest = [c for c in df.columns if c not in (label, predictor)]
    options = F.array(*[
        F.struct(
            F.lit(window).alias("window"), F.lit(n_ahead).alias("n_ahead"),
            F.col(f"_l{i}").alias(label), F.col(f"_p{i}").alias(predictor),
        ) for i, (window, n_ahead) in enumerate(configs)
    ])
    return (
        framed.select(*rest, F.explode(options).alias("_c")).select(*rest, "_c.*").na.drop(subset=[label, predictor])
    )


def shift_columns(df: DataFrame, keys: list[str], order: str, offsets: dict[str, int], **kw) -> DataFrame:
    """Move columns along the series: a positive offset lags, a negative one leads."""
    moved = {c: k for c, k in offsets.items() if k}
    if not moved:
        return df

    def make(col: str, offset: int) -> Callable[[WindowSpec], Column]:
        return lambda w: F.lag(col, offset).over(w)

    frames = {f"_moved_{c}": make(c, k) for c, k in moved.items()}
    back, ahead = max(0, *moved.values()), max(0, *[-k for k in moved.values()])
    columns = df.columns
    framed = add_frames(df, keys, order, frames, back, ahead, **kw)
    return framed.select(*[F.col(f"_moved_{c}").alias(c) if c in moved else F.col(c) for c in columns])


def discharge_offsets(window: int, n_ahead: int) -> tuple[int, int]:
    """(daily, interval) offsets of the discharge columns for a forecast configuration.

    Discharge is known seven days ahead: beyond that the daily series is led by
    7 mod window, and the interval series is lagged by the remaining intervals.
    """
    daily = -(7 % window) if window * n_ahead > 7 else 0
    interval = max(0, n_ahead - 2) if window == 3 else max(0, n_ahead - 1)
    return daily, interval


def rain_history(
    df: DataFrame, key: str = "district", time: str = "time", peak: str = "max", mean: str = "mean", steps: int = 10
) -> DataFrame:
    """Maximum and accumulated rain over the last t days, t = 0..steps-1, by date.

    Missing days simply contribute nothing. All 2*steps frames share one sort.
    """
    w = Window.partitionBy(key).orderBy(F.datediff(F.col(time), F.lit("1970-01-01").cast("date")))
    columns = []
    for t in range(steps):
        frame = w.rangeBetween(-t, 0)
        columns.append(F.max(peak).over(frame).alias(f"rainfall_max_{t}"))
        columns.append(F.coalesce(F.sum(mean).over(frame), F.lit(0.0)).alias(f"rainfall_cum_{t}"))
    return df.select(key, time, *columns)


def run_ids(df: DataFrame, keys: list[str], order: str, col: str, out: str = "run") -> DataFrame:
    """Number the runs of equal consecutive values of `col`, starting at 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((F.col(col) != F.lag(col).over(w)).cast("int"), F.lit(1))
    return df.withColumn("_changed", changed).withColumn(
        out, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_changed")


def minmax_scale(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(x - min) / (max - min) within each key; a constant group gives NULL.

    Extremes come from a partial aggregate, so a hot key shrinks before its shuffle.
    """
    extremes = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]
    )

    def scaled(c: str) -> Column:
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return F.when(width != 0, (F.col(c) - F.col(f"_lo_{c}")) / width).alias(c)

    return df.join(extremes, keys).select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])

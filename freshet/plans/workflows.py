"""End-to-end plans: integration, district forecast over all configurations, benchmark.

Each returns a DataFrame; a caller writes it with `freshet.sources.sinks`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from freshet.operators import blocks as B, learn as L, reshape as R
from freshet.operators.impute import interpolate_linear, interpolate_spline
from freshet.operators.compare import average_rank, ranks_over_folds
from freshet.operators.panel import attach_static, attach_vegetation, build_panel, drop_quiet_districts, neighbour_maxima
from freshet.operators.quantiles import robust_scale, robust_scale_all
from freshet.operators.resample import resample
from freshet.operators.sweep import best_station, cross_validate_thresholds
from freshet.operators.wavelet import swt
from freshet.operators.windows import discharge_offsets, horizon_label, shift_columns, spread_label_back, trailing_max
from freshet.session import cut_lineage
from freshet.sources.tables import union_all

# Interval length in days -> largest number of intervals ahead.
MAX_AHEAD = {3: 5, 5: 3, 7: 2}
SEASON_DUMMIES = ["spring", "summer", "winter"]
SOIL = ("soil1", "soil2", "soil3", "soil4")


def configurations() -> list[tuple[int, int]]:
    return [(window, ahead) for window, most in MAX_AHEAD.items() for ahead in range(1, most + 1)]


def integrate(countries: dict[str, dict]) -> DataFrame:
    """Panels of all countries stacked; each entry holds the arguments of `build_panel`."""
    panels = [build_panel(country=name, **parts) for name, parts in countries.items()]
    return drop_quiet_districts(union_all(panels))


def daily_features(panel: DataFrame, max_stations: int | None = None, spline: bool = True) -> DataFrame:
    """Filled daily rows of every district, the frame that all configurations start from.

    `panel` has district, station, time, dis, flood, season, rainfall and soil1..soil4
    (shallow to deep). Days on which a station of the district has no value yet, or rain
    or soil is unknown, are dropped; `n_stations` says how many columns are the district's own.
    """
    key = ["district"]
    wide = R.stations_wide(panel, {"dis": "dis_station"}, max_stations)
    own = panel.select("district", "station").distinct().groupBy("district").agg(F.count("station").cast("int").alias("n_stations"))
    daily = panel.groupBy("district", "time").agg(
        F.max("flood").alias("flood"), F.first("season").alias("season"),
        *[F.max(c).alias(c) for c in ("rainfall", *SOIL)],
    )
    joined = wide.join(daily, ["district", "time"])
    stations = R.columns_like(wide, "^dis_station")
    gaps = [*stations, "rainfall", *SOIL]
    joined = joined.select(*[F.col(c).cast("double").alias(c) if c in gaps else F.col(c) for c in joined.columns])
    fill = interpolate_spline if spline else interpolate_linear
    filled = spread_label_back(fill(joined, key, gaps), key, "time")
    made = R.product_features(filled, "rainfall", "soil1", "soil2", "soil4", list(SOIL))
    made = R.season_dummies(made).join(own, "district")
    return _own_values(made.na.drop(subset=["rainfall", "rainSM_L1", "soilM_2x4", "flood"]), stations)


def _own_values(df: DataFrame, stations: list[str]) -> DataFrame:
    """Rows with a value for each station that the district has."""
    for n, c in enumerate(stations, 1):
        df = df.where(F.col(c).isNotNull() | (F.col("n_stations") < n))
    return df


def _chosen(configs: Sequence[tuple[int, int]], columns: Sequence[Column]) -> Column:
    """Of one column per configuration the one that belongs to the row's window and n_ahead."""
    own = [F.when((F.col("window") == w) & (F.col("n_ahead") == a), c) for (w, a), c in zip(configs, columns, strict=True)]
    return F.coalesce(*own)


def configured_features(
    daily: DataFrame, configs: Sequence[tuple[int, int]], wavelet: bool = False, extra: Sequence[str] = (), late: Sequence[str] = ()
) -> DataFrame:
    """Scaled interval features of every district for many configurations of `daily_features` at once.

    The columns window and n_ahead tell them apart. Daily rows are copied per configuration after one
    sort by district; from then on (window, n_ahead, district) is the key of a single shuffle, and
    every bin, lag, filter and scale runs on its partitions. `extra` columns take their
    maximum per interval; those in `late` are lagged by the lead as well. Only station columns
    that a district does not have count as 0.
    """
    keys = ["window", "n_ahead", "district"]
    stations = R.columns_like(daily, "^dis_station")
    offsets = [discharge_offsets(w, a) for w, a in configs]
    led = {f"_{-k}_{c}": (c, k) for k in {day for day, _ in offsets} for c in stations}
    copied = daily.withColumns({name: F.col(c) for name, (c, _) in led.items()})
    moved = shift_columns(copied, ["district"], "time", {name: k for name, (_, k) in led.items()})
    options = F.array(*[
        F.struct(F.lit(w).alias("window"), F.lit(a).alias("n_ahead"), *[F.col(f"_{-day}_{c}").alias(c) for c in stations])
        for (w, a), (day, _) in zip(configs, offsets, strict=True)
    ])
    rest = [c for c in daily.columns if c not in stations]
    expanded = moved.select(*rest, F.explode(options).alias("_o")).select(*rest, "_o.*")
    features = [*stations, "rainSM_L1", "soilM_2x4"]
    bins = resample(expanded, keys, F.col("window"), ["rainfall"], [*features, *SEASON_DUMMIES, "flood", "n_stations", *extra])
    lagged = {c: [interval for _, interval in offsets] for c in stations}
    lagged |= {c: [a for _, a in configs] for c in ("rainfall", "rainSM_L1", "soilM_2x4", *late)}
    lags = {f"_{k}_{c}": (c, k) for c, each in lagged.items() for k in set(each)}
    shifted = shift_columns(bins.withColumns({name: F.col(c) for name, (c, _) in lags.items()}), keys, "time", {name: k for name, (_, k) in lags.items()})
    placed = shifted.select(*[
        _chosen(configs, [F.col(f"_{k}_{c}") for k in lagged[c]]).alias(c) if c in lagged else F.col(c) for c in bins.columns
    ])
    complete = _own_values(placed.na.drop(subset=["rainfall", "rainSM_L1", "soilM_2x4", "flood", *late]), stations)
    absent = complete.select(*[
        F.when(F.col("n_stations") < stations.index(c) + 1, F.lit(0.0)).otherwise(F.col(c)).alias(c) if c in stations else F.col(c)
        for c in complete.columns if c != "n_stations"
    ])
    continuous = [*features, "rainfall"]
    if wavelet:
        absent = swt(absent, keys, continuous)
        continuous = R.columns_like(absent, "_details_|_smooths_")
    return robust_scale(absent, keys, continuous).withColumn("flood", F.col("flood").cast("int"))


def interval_features(
    daily: DataFrame, window: int, n_ahead: int, wavelet: bool = False, extra: Sequence[str] = (), late: Sequence[str] = ()
) -> DataFrame:
    """`configured_features` of one configuration."""
    return configured_features(daily, [(window, n_ahead)], wavelet, extra, late).drop("window", "n_ahead")


def district_features(
    panel: DataFrame, window: int, n_ahead: int, max_stations: int | None = None, wavelet: bool = False, spline: bool = True
) -> DataFrame:
    """Scaled interval features of every district for one configuration."""
    return interval_features(daily_features(panel, max_stations, spline), window, n_ahead, wavelet)


def _configured(scores: DataFrame, model: str, window: int, n_ahead: int, wavelet: bool) -> DataFrame:
    """Scores with the partition columns of the result sink."""
    return scores.select(
        F.lit(model).alias("model"), F.lit(window).alias("window"), F.lit(n_ahead).alias("n_ahead"),
        F.lit(wavelet).alias("wt"), *scores.columns,
    )


def district_forecast(
    panel: DataFrame, configs: Iterable[tuple[int, int]] | None = None, wavelets: Iterable[bool] = (False,),
    max_stations: int | None = None, spline: bool = True
) -> DataFrame:
    """Cross-validated logistic scores per district for every configuration, stacked.

    The columns model, window, n_ahead and wt tell configurations apart and are the
    partition columns of the result sink. Districts without enough blocks have a row with
    the `reason` and no scores. The filled daily frame is written once and shared; features of all
    configurations are one frame per wavelet setting, keyed by configuration and district.
    """
    daily = cut_lineage(daily_features(panel, max_stations, spline))
    parts = []
    # A unit is one district in one configuration; blocks, folds and fits know nothing else.
    unit = F.concat_ws("|", "window", "n_ahead", "district")
    named = F.split("unit", "[|]", 3)
    for wavelet in wavelets:
        frame = configured_features(daily, list(configs or configurations()), wavelet)
        features = [c for c in frame.columns if c not in ("window", "n_ahead", "district", "time", "flood")]
        frame = cut_lineage(frame.select(unit.alias("unit"), "time", "flood", *features))
        blocked = cut_lineage(B.event_blocks(frame, named[0].cast("int"), key="unit"))
        scores = L.model_scores(L.district_logistic(blocked, features, key="unit"), "unit").withColumn("reason", F.lit("ok"))
        refused = B.block_support(blocked, "unit").where(F.col("reason") != "ok").select("unit", "reason")
        both = union_all([scores, refused])
        parts.append(both.select(
            F.lit("LR").alias("model"), named[0].cast("int").alias("window"), named[1].cast("int").alias("n_ahead"), F.lit(wavelet).alias("wt"),
            named[2].alias("district"), *[c for c in both.columns if c != "unit"],
        ))
    return union_all(parts)


def best_station_columns(frame: DataFrame, ranks: DataFrame, stations: list[str]) -> DataFrame:
    """`best_dis` (and its wavelet parts) in place of the station columns.

    The best station of a district is the one with the least summed coefficient rank;
    districts without ranks take the largest value of their stations.
    """
    own = [c for c in frame.columns if any(c.startswith(s) for s in stations)]
    best = ranks.where(F.col("var").isin(*own)).groupBy("district").agg(F.min_by("var", F.struct("rank_sum", "var")).alias("_var"))
    best = best.select("district", F.regexp_extract("_var", "^dis_station[0-9]+", 0).alias("_best"))
    joined = frame.join(best, "district", "left")
    made = []
    for suffix in dict.fromkeys(c.removeprefix(next(s for s in sorted(stations, key=len, reverse=True) if c.startswith(s))) for c in own):
        listed = [f"{s}{suffix}" for s in stations]
        chosen = F.coalesce(*[F.when(F.col("_best") == s, F.col(c)) for s, c in zip(stations, listed, strict=True)])
        largest = F.greatest(*listed) if len(listed) > 1 else F.col(listed[0])
        made.append(F.coalesce(chosen, largest).alias(f"best_dis{suffix}"))
    return joined.select(*[c for c in frame.columns if c not in own], *made)


def panel_forecast(
    panel: DataFrame, edges: DataFrame, vegetation: DataFrame, water: DataFrame, slope: DataFrame, window: int, n_ahead: int,
    wavelet: bool = False, max_stations: int | None = None, spline: bool = True, **fit
) -> tuple[DataFrame, DataFrame]:
    """Country-level forecast: scores of each fold's best seed, and mean scores per district.

    Every district brings its best station, static features scaled over the panel, what its
    neighbours had in the last fourteen days, and dummies; blocks become sequences of a
    month and a half. Both tables carry the partition columns of the result sink.
    """
    daily = daily_features(panel, max_stations, spline)
    stations = R.columns_like(daily, "^dis_station")
    around = {c: f"max14_{c}" for c in stations} | {"flood": "flood14"}
    recent = trailing_max(daily, ["district"], "time", around)
    with_static = attach_static(attach_vegetation(recent, [vegetation]), water, slope)
    if spline:  # vegetation is sparse in time: a spline of order two
        with_static = interpolate_spline(with_static, ["district"], ["EVI_mean"], backfill=True, order=2)
    else:
        with_static = interpolate_linear(with_static, ["district"], ["EVI_mean"], backfill=True)
    daily = cut_lineage(with_static.na.drop(subset=["flood14"]))
    static = ["EVI_mean", "perc_water", "avg_slope"]
    frame = interval_features(daily, window, n_ahead, wavelet, [*static, *around.values()], ["flood14"])
    frame = cut_lineage(robust_scale_all(frame.na.fill(0.0, subset=static), static))
    own = [c for c in frame.columns if c not in ("district", "time", "flood", *static, *around.values())]
    blocked = cut_lineage(B.event_blocks(frame, window))
    coefs = L.coefficients(L.district_logistic(blocked, own), own)
    ranks = ranks_over_folds(average_rank(coefs, ["district", "fold"], F.col("coef")), ["district"], list(range(1, B.N_FOLDS + 1)))
    ranks = cut_lineage(ranks)
    largest = F.greatest(*[f"max14_{c}" for c in stations]) if len(stations) > 1 else F.col(f"max14_{stations[0]}")
    info = frame.select("district", "time", "flood14", largest.alias("best_dis14"))
    near = neighbour_maxima(info, edges, ["best_dis14", "flood14"]).select("district", "time", "NB_best_dis14", "NB_flood14")
    near = robust_scale(near.na.fill(0.0), ["district"], ["NB_best_dis14"])
    best = best_station_columns(blocked.drop(*around.values()), ranks, stations)
    ready = B.block_folds(best.join(near, ["district", "time"], "left").na.fill(0.0, subset=["NB_best_dis14", "NB_flood14"]))
    columns = [c for c in ready.columns if c not in ("district", "time", "flood", "block", "fold")]
    sequenced = B.sequences(ready, ["district", "block", "fold"], "time", columns, B.sequence_steps(window))
    overall, per_district = L.sequence_classifier(sequenced.withColumn("flood", F.col("flood").cast("int")), **fit)
    return tuple(_configured(t, "SEQ", window, n_ahead, wavelet) for t in (overall, per_district))


def benchmark(panel: DataFrame, predictor: str = "max_dt_3days", n_ahead: int = 1) -> DataFrame:
    """Cross-validated quantile thresholds: best station per district with its scores.

    A predictor named max_future_<k>days shifts label and predictor to the horizon first.
    """
    days = panel
    if "future" in predictor:
        window = int(predictor.removeprefix("max_future_")[0])
        days = horizon_label(panel, ["district", "station"], "time", predictor, window, n_ahead)
    return best_station(cross_validate_thresholds(days, predictor))

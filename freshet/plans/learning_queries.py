"""Queries over the classifiers. Their results depend on iterative fits, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from freshet.functions.expressions import season_of
from freshet.operators import blocks as B, learn as L
from freshet.operators.compare import average_rank, ranks_over_folds
from freshet.operators.panel import neighbour_maxima
from freshet.operators.quantiles import robust_scale
from freshet.operators.reshape import columns_like, season_dummies, stations_wide
from freshet.operators.resample import resample
from freshet.operators.scores import daily_scores
from freshet.operators.windows import rain_history, spread_label_back, trailing_max
from freshet.plans import workflows, views as V
from freshet.plans.registry import query
from freshet.session import cut_lineage
from freshet.sources.tables import read_table

WINDOW = 7
FEATURES = ["dis_station1", "dis_station2", "dis_station3", "rainfall", "soil", "spring", "summer", "winter"]


def district_frame(spark, d) -> DataFrame:
    """Weekly district features around events: stations, rain, soil and season, scaled."""
    days = V.v_days(spark, d)
    wide = stations_wide(days, {"dis": "dis_station"}, 3)
    floods = days.groupBy("district", "time").agg(F.max("flood").alias("flood"))
    rain = V.v_rain(spark, d).select(
        "district", "time", F.col("rain_max").alias("rainfall"), F.col("soil1").alias("soil")
    )
    daily = wide.join(floods, ["district", "time"]).join(rain, ["district", "time"], "left")
    daily = spread_label_back(daily, ["district"], "time")
    stations = columns_like(daily, "dis_station")
    weekly = resample(daily, ["district"], WINDOW, ["rainfall"], [*stations, "soil", "flood"]).na.drop()
    scaled = robust_scale(weekly, ["district"], [*stations, "rainfall", "soil"])
    return season_dummies(scaled.withColumn("season", season_of(F.col("time")))).withColumn(
        "flood", F.col("flood").cast("int")
    )


def district_blocks(spark, d) -> DataFrame:
    """Blocks of all districts, written once: supports, folds and fits read them several times."""
    return cut_lineage(B.event_blocks(district_frame(spark, d), WINDOW))


@query("group_folds")
def group_folds(spark, d):
    return L.group_folds(district_blocks(spark, d))


@query("lr_district_cv")
def lr_district_cv(spark, d):
    return L.model_scores(L.district_logistic(district_blocks(spark, d), FEATURES))


@query("lr_coefficient_ranks")
def lr_coefficient_ranks(spark, d):
    coefs = L.coefficients(L.district_logistic(district_blocks(spark, d), FEATURES), FEATURES)
    ranks = average_rank(coefs, ["district", "fold"], F.col("coef"))
    return ranks_over_folds(ranks, ["district"], list(range(1, B.N_FOLDS + 1)))


@query("svc_linear")
def svc_linear(spark, d):
    return L.model_scores(L.district_svc(district_blocks(spark, d), FEATURES))


def _discharge_wide(spark, d) -> DataFrame:
    days = V.v_days(spark, d)
    wide = stations_wide(days, {"dis": "dis_station"}, 3)
    floods = days.groupBy("district", "time").agg(F.max("flood").alias("flood"))
    return wide.join(floods, ["district", "time"])


@query("gbt_discharge")
def gbt_discharge(spark, d):
    wide = _discharge_wide(spark, d)
    predictions = L.district_boosted(wide, columns_like(wide, "dis_station[1-3]"))
    return daily_scores(predictions, ["district"])


@query("gbt_discharge_rain")
def gbt_discharge_rain(spark, d):
    rain = rain_history(V.v_rain(spark, d), peak="rain_max", mean="rain_mean", steps=8)
    wide = _discharge_wide(spark, d).join(rain, ["district", "time"], "left")
    predictions = L.district_boosted(wide, columns_like(wide, "dis_station|rainfall_"))
    return daily_scores(predictions, ["district"])


@query("panel_sequence")
def panel_sequence(spark, d):
    """Sequences of a month and a half per nation, with neighbours' recent maxima."""
    series = V.v_nation_series(spark, d).join(
        V.v_nation_impact(spark, d), ["district", "time"], "left"
    ).withColumn("flood", F.coalesce("flood", F.lit(0)))
    recent = trailing_max(series, ["district"], "time", {"dis": "max14", "flood": "flood14"})
    joined = neighbour_maxima(recent, V.v_neigh(spark, d), ["max14", "flood14"])
    columns = ["dis", "NB_max14", "NB_flood14"]
    weekly = resample(joined, ["district"], WINDOW, [], [*columns, "flood"]).na.fill(0)
    scaled = robust_scale(weekly, ["district"], ["dis", "NB_max14"])
    blocked = B.block_folds(B.event_blocks(scaled, WINDOW))
    sequenced = B.sequences(
        blocked, ["district", "block", "fold"], "time", columns, B.sequence_steps(WINDOW)
    ).withColumn("flood", F.col("flood").cast("int"))
    _, per_district = L.sequence_classifier(sequenced)
    return per_district


def forecast_panel(spark, d) -> DataFrame:
    """The panel in the shape the workflows read."""
    days = V.v_days(spark, d).withColumn("season", season_of(F.col("time")))
    rain = V.v_rain(spark, d).withColumnRenamed("rain_max", "rainfall").drop("rain_mean")
    return days.join(rain, ["district", "time"], "left")


@query("district_features")
def district_features(spark, d):
    return workflows.district_features(forecast_panel(spark, d), 5, 2)


@query("district_forecast")
def district_forecast(spark, d):
    return workflows.district_forecast(forecast_panel(spark, d), None, [False, True])


@query("panel_forecast")
def panel_forecast(spark, d):
    """Country-level scores per district with all feature groups."""
    rain = V.v_rain(spark, d)
    regions = read_table(spark, d, "supplier").join(V.supplier_district(spark, d), "s_suppkey").groupBy(
        F.col("r_name").alias("district")
    ).agg(F.avg("s_acctbal").alias("occurrence"), F.max("s_acctbal").alias("mean"))
    w = Window.orderBy("district")
    beside = regions.select("district", F.array(F.lag("district").over(w), F.lead("district").over(w)).alias("_b"))
    edges = beside.select("district", F.explode("_b").alias("neighbour"))
    _, per_district = workflows.panel_forecast(
        forecast_panel(spark, d), edges.where(F.col("neighbour").isNotNull()),
        rain.select("district", "time", F.col("soil1").alias("EVI_mean")), regions, regions, 7, 1,
    )
    return per_district

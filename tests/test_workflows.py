"""The end-to-end plans on a small hand-made panel."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators.windows import discharge_features
from freshet.plans import workflows
from freshet.session import cut_lineage
from freshet.sources import sinks, tables

START = dt.date(2000, 1, 1)
N = 900


def discharge(spark, stations, seed):
    rng = np.random.default_rng(seed)
    rows = [
        (s, START + dt.timedelta(days=i), 60.0 if i % 75 == 40 else float(rng.gamma(2, 3)))
        for s in stations for i in range(N)
    ]
    return spark.createDataFrame(rows, "station string, time date, dis double")


def weather(spark, districts, seed):
    rng = np.random.default_rng(seed)
    rows = [(d, START + dt.timedelta(days=i), *map(float, rng.random(5))) for d in districts for i in range(N) if i % 9]
    return spark.createDataFrame(
        rows, "district string, time date, rainfall double, soil1 double, soil2 double, soil3 double, soil4 double"
    )


@pytest.fixture(scope="module")
def panel(spark):
    floods = [(START + dt.timedelta(days=i), d, 1) for d in ("lira", "wakiso") for i in range(40, N, 75)]
    impact = spark.createDataFrame(floods, "time date, district string, flood int")
    links = spark.createDataFrame(
        [("lira", "u1"), ("lira", "u2"), ("wakiso", "u1"), ("quiet", "u2")], "district string, station string"
    )
    uganda = dict(
        discharge=discharge_features(discharge(spark, ["u1", "u2"], 1), ["station"], "time"), links=links,
        impact=impact, rain=weather(spark, ["lira", "wasiko"], 2), soil=None, district_repair={"wasiko": "wakiso"},
    )
    kenya = dict(
        discharge=discharge_features(discharge(spark, ["k1"], 3), ["station"], "time"),
        links=spark.createDataFrame([("kilifi", "k1")], "district string, station string"),
        impact=spark.createDataFrame(
            [(START + dt.timedelta(days=i), "kilifi", 1) for i in range(40, N, 75)], "time date, district string, flood int"
        ),
        rain=weather(spark, ["kilifi"], 4), soil=None,
    )
    return workflows.integrate({"Uganda": uganda, "Kenya": kenya}).cache()


def test_integration_keys_rows_and_repairs(panel):
    assert {r.district for r in panel.select("district").distinct().collect()} == {"lira", "wakiso", "kilifi"}
    # Seven head and tail days lack a complete rolling value.
    counts = {(r.district, r.station): r["count"] for r in panel.groupBy("district", "station").count().collect()}
    assert set(counts.values()) == {N - 7}
    assert panel.where("district = 'wakiso' and rainfall is not null").count() > 0
    assert panel.groupBy("district", "station", "time").count().where("count > 1").isEmpty()


def test_configurations():
    assert workflows.configurations() == [
        (3, 1), (3, 2), (3, 3), (3, 4), (3, 5), (5, 1), (5, 2), (5, 3), (7, 1), (7, 2)
    ]


@pytest.mark.parametrize("wavelet", [False, True])
def test_features_are_complete_and_evenly_spaced(panel, wavelet):
    out = workflows.district_features(panel, 5, 2, max_stations=2, wavelet=wavelet).toPandas()
    assert not out.isna().any().any() and set(out.flood) == {0, 1}
    for _, g in out.groupby("district"):
        gaps = g.time.sort_values().map(lambda t: t.toordinal()).diff().dropna()
        assert (gaps == 5).all()
    assert any(c.endswith("_details_3") for c in out) == wavelet


def one_configuration(daily, window, n_ahead):
    """Features of one configuration, step by step with literal window and offsets."""
    from freshet.operators import reshape as R
    from freshet.operators.quantiles import robust_scale
    from freshet.operators.resample import resample
    from freshet.operators.windows import discharge_offsets, shift_columns

    stations = R.columns_like(daily, "^dis_station")
    day, interval = discharge_offsets(window, n_ahead)
    led = shift_columns(daily, ["district"], "time", {c: day for c in stations})
    features = [*stations, "rainSM_L1", "soilM_2x4"]
    bins = resample(led, ["district"], window, ["rainfall"], [*features, *workflows.SEASON_DUMMIES, "flood", "n_stations"])
    lags = {c: interval for c in stations} | {c: n_ahead for c in ("rainfall", "rainSM_L1", "soilM_2x4")}
    moved = shift_columns(bins, ["district"], "time", lags).na.drop(subset=["rainfall", "rainSM_L1", "soilM_2x4", "flood"])
    whole = moved.where(" AND ".join(f"({c} IS NOT NULL OR n_stations < {k})" for k, c in enumerate(stations, 1)))
    filled = whole.na.fill(0.0, subset=stations)
    return robust_scale(filled, ["district"], [*features, "rainfall"])


def test_all_configurations_come_from_one_frame(spark):
    """Ten configurations equal ten single runs; lags, bins and scales share one exchange."""
    daily = cut_lineage(workflows.daily_features(late_panel(spark, 200), spline=False))
    together = workflows.configured_features(daily, workflows.configurations())
    got = together.toPandas().sort_values(["window", "n_ahead", "district", "time"])
    for window, n_ahead in workflows.configurations():
        want = one_configuration(daily, window, n_ahead).toPandas().sort_values(["district", "time"])
        mine = got[(got.window == window) & (got.n_ahead == n_ahead)]
        assert len(mine) == len(want) > 0
        for c in ("district", "time", "flood"):
            assert mine[c].tolist() == want[c].tolist()
        for c in ("dis_station1", "dis_station2", "rainfall", "rainSM_L1", "soilM_2x4", "spring"):
            assert mine[c].astype(float).tolist() == pytest.approx(want[c].astype(float).tolist(), abs=1e-12), (window, n_ahead, c)
    plan = workflows.configured_features(daily, workflows.configurations())._jdf.queryExecution().executedPlan().treeString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan


def test_benchmark_and_forecast_find_the_signal(spark, panel, tmp_path):
    same_day = {r.district: r for r in workflows.benchmark(panel).collect()}
    assert len(same_day) == 3 and all(r.avg_pod > 0.9 for r in same_day.values())
    ahead = workflows.benchmark(panel, "max_future_3days").collect()
    assert all(r.avg_f1 > 0.9 for r in ahead)
    forecast = workflows.district_forecast(panel, [(5, 1)], max_stations=2)
    sinks.write_results(forecast, str(tmp_path / "scores"))
    back = tables.read_results(spark, str(tmp_path / "scores"), ["LR"], False)
    assert back.count() == 3 and back.where(F.col("window") == 5).count() == 3


def late_panel(spark, second_from):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(N):
        day = START + dt.timedelta(days=i)
        for s in ("a", "b") if i >= second_from else ("a",):
            rows.append(("d", s, day, float(rng.gamma(2, 3)), int(i % 75 == 40), "fall", *map(float, rng.random(5))))
        rows.append(("e", "a", day, float(rng.gamma(2, 3)), int(i % 300 == 40), "fall", *map(float, rng.random(5))))
    schema = "district string, station string, time date, dis double, flood int, season string, rainfall double, soil1 double, soil2 double, soil3 double, soil4 double"
    return spark.createDataFrame(rows, schema)


def test_late_station_drops_days_and_absent_station_is_zero(spark):
    out = workflows.district_features(late_panel(spark, 200), 5, 1, spline=False).toPandas()
    first = out[out.district == "d"].time.min()
    assert first >= START + dt.timedelta(days=200)
    assert (out[out.district == "e"].dis_station2 == 0).all() and out[out.district == "e"].time.min() < first
    raw = workflows.daily_features(late_panel(spark, 200), spline=False)
    assert raw.where("district = 'd' and (dis_station1 is null or dis_station2 is null)").count() == 0


def test_forecast_names_refused_districts(spark):
    out = workflows.district_forecast(late_panel(spark, 0), [(7, 1)], spline=False).collect()
    by = {r.district: r for r in out}
    assert by["d"].reason == "ok" and by["d"].avg_f1 is not None
    assert by["e"].reason == "fewer blocks than folds" and by["e"].avg_f1 is None


def test_panel_forecast_scores_every_fold_and_district(spark, tmp_path):
    panel = late_panel(spark, 0)
    edges = spark.createDataFrame([("d", "e"), ("e", "d")], "district string, neighbour string")
    vegetation = panel.where("dayofmonth(time) = 1").groupBy("district", "time").agg(F.max("soil1").alias("EVI_mean"))
    static = spark.createDataFrame([("d", 0.1, 2.0), ("e", 0.4, 3.0)], "district string, occurrence double, mean double")
    overall, per_district = workflows.panel_forecast(
        panel, edges, vegetation, static, static, 7, 1, spline=False, seeds=(1, 2), max_iter=2
    )
    assert {r.test_fold for r in overall.collect()} == {1, 2, 3, 4, 5}
    found = per_district.collect()
    assert {r.district for r in found} == {"d", "e"} and {(r.model, r.window, r.n_ahead, r.wt) for r in found} == {("SEQ", 7, 1, False)}
    sinks.write_results(per_district, str(tmp_path / "panel"))
    assert tables.read_results(spark, str(tmp_path / "panel"), ["SEQ"], False).count() == 2


def test_best_station_follows_ranks_or_the_maximum(spark):
    frame = spark.createDataFrame([("d", 1.0, 5.0), ("e", 2.0, 7.0)], "district string, dis_station1 double, dis_station2 double")
    ranks = spark.createDataFrame([("d", "dis_station1", 3.0), ("d", "dis_station2", 9.0), ("d", "rainfall", 1.0)], "district string, var string, rank_sum double")
    out = {r.district: r.best_dis for r in workflows.best_station_columns(frame, ranks, ["dis_station1", "dis_station2"]).collect()}
    assert out == {"d": 1.0, "e": 7.0}

"""Rolling, shifting, scaling and resampling against pandas on small frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import impute, resample as RS, wavelet, windows as W
from freshet.operators.quantiles import exact_quantiles, robust_scale, robust_scale_all

START = dt.date(2000, 1, 30)


def days(n):
    return [START + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for station, n in (("a", 40), ("b", 23), ("c", 2)):
        for day in days(n):
            value = None if rng.random() < 0.2 else float(rng.integers(0, 50))
            rows.append((station, day, value, int(rng.random() < 0.2)))
    return spark.createDataFrame(rows, "station string, time date, dis double, flood int")


def by_station(df):
    pdf = df.toPandas().sort_values(["station", "time"])
    return {k: g.reset_index(drop=True) for k, g in pdf.groupby("station")}


def assert_close(got, want):
    np.testing.assert_allclose(got.astype(float), want.astype(float), equal_nan=True)


def test_rolling_maxima_equal_pandas(series):
    out = by_station(W.discharge_features(series, ["station"], "time"))
    for g in out.values():
        assert_close(g.max_dt_3days, g.dis.rolling(7, min_periods=3, center=True).max())
        for k in range(3, 8):
            assert_close(g[f"max_future_{k}days"], g.dis.rolling(k).max().shift(-k))


def test_trailing_and_spread_equal_pandas(series):
    out = by_station(W.trailing_max(series, ["station"], "time", {"flood": "f14"}))
    for g in out.values():
        assert_close(g.f14, g.flood.rolling(14).max())
    spread = by_station(W.spread_label_back(series.withColumnRenamed("dis", "x"), ["station"], "time"))
    base = by_station(series)
    for k, g in spread.items():
        want = base[k].flood.rolling(3).max().shift(-2).dropna()
        assert list(g.flood) == list(want.astype(int))
    assert "c" not in spread  # shorter than the frame


@pytest.mark.parametrize("window,ahead", [(3, 1), (3, 2), (5, 3), (7, 2)])
def test_horizon_label_equals_pandas(series, window, ahead):
    full = series.withColumn("dis", F.coalesce("dis", F.lit(1.0)))
    out = by_station(W.horizon_label(full, ["station"], "time", "dis", window, ahead))
    for k, g in by_station(full).items():
        label = g.flood.rolling(window).max().shift(-(window + ahead - 1))
        want = pd.DataFrame({"dis": g.dis.shift(-(ahead - 1)), "flood": label}).dropna()
        got = out.get(k)
        assert len(want) == (0 if got is None else len(got))
        if got is not None:
            assert_close(got.dis, want.dis.reset_index(drop=True))
            assert_close(got.flood, want.flood.reset_index(drop=True))
    many = W.horizon_labels(full, ["station"], "time", "dis", [(window, ahead), (3, 1)])
    one = many.where((F.col("window") == window) & (F.col("n_ahead") == ahead))
    assert one.count() == sum(len(g) for g in out.values()) * (2 if (window, ahead) == (3, 1) else 1)


def test_sliced_series_equal_whole_series(series):
    """Timestamps have no calendar bound: slices with borrowed rows give the same values."""
    stamped = series.withColumn("time", F.col("time").cast("timestamp"))
    whole = W.discharge_features(series, ["station"], "time").toPandas()
    for size in (1, 4, 16):
        cut = W.discharge_features(stamped, ["station"], "time", slice_rows=size).toPandas()
        for df in (whole, cut):
            df["time"] = pd.to_datetime(df["time"])
            df.sort_values(["station", "time"], inplace=True, ignore_index=True)
        pd.testing.assert_frame_equal(whole, cut, check_dtype=False)
    default = W.discharge_features(stamped, ["station"], "time")
    assert "_slice" in default._jdf.queryExecution().toString()
    assert default.count() == len(whole)


def test_row_positions_are_dense(series):
    stamped = series.withColumn("time", F.col("time").cast("timestamp"))
    for g in by_station(W.row_positions(stamped, ["station"], "time")).values():
        assert list(g.pos) == list(range(1, len(g) + 1))


def test_shift_columns_lags_and_leads(series):
    out = by_station(W.shift_columns(series, ["station"], "time", {"dis": -2, "flood": 3}))
    for k, g in by_station(series).items():
        assert_close(out[k].dis, g.dis.shift(-2))
        assert_close(out[k].flood, g.flood.shift(3))
    assert W.shift_columns(series, ["station"], "time", {"dis": 0}) is series


@pytest.mark.parametrize("window,ahead,want", [
    (3, 1, (0, 0)), (3, 2, (0, 0)), (3, 3, (-1, 1)), (3, 5, (-1, 3)), (5, 1, (0, 0)), (5, 2, (-2, 1)),
    (5, 3, (-2, 2)), (7, 1, (0, 0)), (7, 2, (0, 1)),
])
def test_discharge_offsets(window, ahead, want):
    assert W.discharge_offsets(window, ahead) == want


def test_rain_history_uses_dates_not_rows(spark):
    rows = [("d", dt.date(2001, 1, i), float(i), 1.0) for i in (1, 2, 5, 6)]
    df = spark.createDataFrame(rows, "district string, time date, max double, mean double")
    out = {r.time.day: r for r in W.rain_history(df, steps=4).collect()}
    assert out[5].rainfall_cum_2 == 1.0 and out[5].rainfall_cum_3 == 2.0
    assert out[6].rainfall_max_1 == 6.0 and out[6].rainfall_cum_1 == 2.0
    assert out[1].rainfall_cum_3 == 1.0


def test_runs_start_at_one(spark):
    rows = [("s", d, v) for d, v in zip(days(6), [0, 0, 1, 1, 0, 1])]
    df = spark.createDataFrame(rows, "s string, time date, p int")
    assert [r.run for r in W.run_ids(df, ["s"], "time", "p").orderBy("time").collect()] == [1, 1, 2, 2, 3, 4]


def test_scalers(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 5.0), ("b", 2.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    scaled = sorted(r.x for r in W.minmax_scale(df, ["k"], ["x"]).where("k = 'a'").collect())
    assert scaled == [0.0, 0.5, 1.0]
    assert {r.x for r in W.minmax_scale(df, ["k"], ["x"]).where("k = 'b'").collect()} == {None}
    assert {r.x for r in robust_scale(df, ["k"], ["x"]).where("k = 'b'").collect()} == {0.0}
    every = sorted(r.x for r in robust_scale_all(df, ["x"]).collect())
    assert every == [-1.0, 0.0, 0.0, 1.0, 3.0]


def test_exact_quantiles_with_ties_hot_keys_and_nulls(spark):
    rng = np.random.default_rng(5)
    hot = [("hot", float(v)) for v in rng.integers(0, 30, 3000)] + [("hot", None)]
    tail = [("tail", float(v)) for v in rng.lognormal(0, 4, 500)]
    df = spark.createDataFrame(hot + tail + [("one", 7.0)], "k string, x double")
    qs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    pdf = df.toPandas()
    for accuracy in (100, 100_000):  # 100 forces the sketched brackets
        got = {(r.k, r.q): r.value for r in exact_quantiles(df, ["k"], "x", qs, accuracy=accuracy).collect()}
        for k, g in pdf.groupby("k"):
            for q in qs:
                assert got[k, q] == pytest.approx(g.x.quantile(q), rel=1e-12)


@pytest.mark.parametrize("most_cells", [2, 50])
def test_quantiles_are_narrowed_pass_by_pass(spark, monkeypatch, tmp_path, most_cells):
    """A million rows in a coarse sketch: no task orders more values of a quantile than stated."""
    from freshet.operators import quantiles

    seen = []
    monkeypatch.setattr(quantiles, "_upto", lambda cells, by, order, f=quantiles._upto: seen.append(cells) or f(cells, by, order))
    n = 1_000_000
    x = F.when(F.col("id") % 3 == 0, F.pmod(F.hash("id"), F.lit(10_000)) / 7).otherwise(F.rand(5) * F.exp(F.randn(6) * 3))
    df = spark.range(n).select((F.col("id") % 10 == 0).cast("int").alias("k"), x.alias("x")).unionByName(
        spark.createDataFrame([(7, float(v)) for v in [*range(40), *range(10**9, 10**9 + 40)]] + [(8, float("inf")), (8, float("-inf")), (8, 1.0)], "k int, x double")
    )
    df.write.parquet(str(tmp_path / "values"))
    df = spark.read.parquet(str(tmp_path / "values"))
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.q): r.value for r in quantiles.exact_quantiles(df, ["k"], "x", qs, accuracy=20, most_cells=most_cells).collect()}
    values = df.toPandas()
    for k in (0, 1, 7):
        want = np.quantile(values[values["k"] == k]["x"].to_numpy(), qs)
        assert [got[k, q] for q in qs] == pytest.approx(want.tolist(), rel=1e-12)
    assert (got[8, 0.0], got[8, 0.5], got[8, 1.0]) == (float("-inf"), 1.0, float("inf"))
    for cells in seen[:-1]:
        assert cells.groupBy("k", "q").count().agg(F.max("count")).first()[0] <= quantiles.BINS
    assert len(seen) > 1 and seen[-1].groupBy("k", "q").count().agg(F.max("count")).first()[0] <= most_cells



def test_resample_equals_pandas_and_fills_empty_bins(spark):
    keep = [0, 1, 2, 9, 10, 11, 20]
    rows = [("d", days(30)[i], float(i), float(i)) for i in keep]
    df = spark.createDataFrame(rows, "district string, time date, rain double, x double")
    got = RS.resample(df, ["district"], 3, ["rain"], ["x"]).orderBy("time").toPandas()
    pdf = df.toPandas().assign(time=lambda p: pd.to_datetime(p.time)).set_index("time")
    assert list(got.rain) == list(pdf.rain.resample("3D").sum())
    assert_close(got.x, pdf.x.resample("3D").max().reset_index(drop=True))
    assert list(pd.to_datetime(got.time)) == list(pdf.rain.resample("3D").sum().index)


@pytest.mark.parametrize("first", ["2000-01-01", "2000-01-31", "2001-06-15", "2003-12-31"])
def test_half_year_blocks_equal_pandas(spark, first):
    time = pd.date_range(first, periods=900, freq="D")
    values = np.random.default_rng(1).random(900).round(6)
    df = spark.createDataFrame(
        [("s", t.date(), float(v)) for t, v in zip(time, values)], "s string, time date, x double"
    )
    got = [r.block_max for r in RS.block_maxima(df, ["s"], "x").orderBy("block").collect()]
    want = pd.Series(values, index=time).groupby(pd.Grouper(freq="6ME")).max()
    assert got == list(want)


def test_date_spine(spark):
    rows = [("a", days(1)[0]), ("a", days(5)[4]), ("b", days(1)[0])]
    df = spark.createDataFrame(rows, "k string, time date")
    counts = {r.k: r["count"] for r in RS.date_spine(df, ["k"]).groupBy("k").count().collect()}
    assert counts == {"a": 5, "b": 1}


def test_linear_interpolation_equals_pandas(series):
    out = by_station(impute.interpolate_linear(series, ["station"], ["dis"]))
    back = by_station(impute.interpolate_linear(series, ["station"], ["dis"], backfill=True))
    for k, g in by_station(series).items():
        want = g.dis.interpolate(method="linear")
        assert_close(out[k].dis, want)
        assert_close(back[k].dis, want.bfill())


def test_spline_passes_points_and_reproduces_cubics(spark):
    n = 30
    cubic = [0.01 * i**3 - 0.2 * i**2 + i + 4 for i in range(n)]
    gaps = {0, 3, 4, 5, 11, 20, 28, 29}
    rows = [("s", d, None if i in gaps else cubic[i]) for i, d in enumerate(days(n))]
    df = spark.createDataFrame(rows, "station string, time date, dis double")
    got = by_station(impute.interpolate_spline(df, ["station"], ["dis"]))["s"].dis
    assert np.isnan(got[0])  # leading gaps stay
    np.testing.assert_allclose(got[1:], cubic[1:], rtol=1e-9)
    filled = by_station(impute.interpolate_spline(df, ["station"], ["dis"], backfill=True))["s"].dis
    assert filled[0] == cubic[1]


def test_quadratic_interpolation_reproduces_parabolas(spark):
    parabola = [0.5 * i * i - 3 * i + 2 for i in range(20)]
    rows = [("s", d, parabola[i] if i in (2, 5, 6, 11, 17) else None) for i, d in enumerate(days(20))]
    df = spark.createDataFrame(rows, "station string, time date, dis double")
    got = by_station(impute.interpolate_quadratic(df, ["station"], "dis"))["s"].dis
    np.testing.assert_allclose(got[2:18], parabola[2:18])
    assert list(got[:2]) == [parabola[2]] * 2 and got[18] == parabola[17]


def test_wavelet_energy_and_constants(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=64)
    n = 64 + 400
    padded = np.concatenate([np.full(200, x.mean()), x, np.full(200, x.mean())])
    rows = [("s", (START + dt.timedelta(days=i)), float(v)) for i, v in enumerate(padded)]
    df = spark.createDataFrame(rows, "s string, time date, x double")
    out = wavelet.swt(df, ["s"], ["x"]).toPandas()
    bands = out[[c for c in out if c.startswith("x_")]]
    assert (bands**2).to_numpy().sum() == pytest.approx((padded**2).sum(), rel=1e-6)
    flat = df.withColumn("x", F.lit(3.0))
    const = wavelet.swt(flat, ["s"], ["x"]).toPandas()
    for j in (1, 2, 3):
        assert np.abs(const[f"x_details_{j}"]).max() < 1e-9
    assert np.abs(const["x_smooths_3"] - 3).max() < 1e-9
    assert len(out) == n


def test_spectrum_finds_a_sine(spark):
    rows = [("s", START + dt.timedelta(days=i), float(2 * np.sin(2 * np.pi * 3 * i / 365.25))) for i in range(1461)]
    df = spark.createDataFrame(rows, "s string, time date, x double")
    out = {r.cycles: r.amplitude for r in wavelet.spectrum(df, ["s"], "x", [1, 2, 3, 4]).collect()}
    assert out[3] == pytest.approx(1.0, abs=0.01) and max(out[1], out[2], out[4]) < 0.02


@pytest.mark.parametrize("sent", [100_000, 0])
def test_values_of_a_hot_group_are_not_gathered(spark, monkeypatch, sent):
    """Few brackets go to the values; of many each goes to parts of its group."""
    from freshet.operators import quantiles

    monkeypatch.setattr(quantiles, "SENT_BRACKETS", sent, raising=False)
    plans = []
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df, f=quantiles.cut_lineage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    df = spark.range(4000).select(F.when(F.col("id") < 3900, "hot").otherwise("b").alias("k"), (F.col("id") % 3900 * 7 % 3900).cast("double").alias("x"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to be broadcast
    try:
        got = {(r.k, r.q): r.value for r in quantiles.exact_quantiles(df, ["k"], "x", [0.1, 0.5]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    values = df.toPandas()
    for k, g in values.groupby("k"):
        assert [got[k, q] for q in (0.1, 0.5)] == pytest.approx(g.x.quantile([0.1, 0.5]).tolist(), rel=1e-12)
    met = next(p for p in plans if "Generate explode(_b" in p)
    assert ("BroadcastHashJoin" in met and "SortMergeJoin" not in met) if sent else "SortMergeJoin [k#" in met and ", _part#" in met

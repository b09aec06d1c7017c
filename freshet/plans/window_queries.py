"""Queries over rolling, shifting, scaling, resampling, filling and frequency features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.functions.expressions import rounded
from freshet.operators import impute, resample as RS, wavelet, windows as W
from freshet.operators.quantiles import exact_quantiles, robust_scale, robust_scale_all
from freshet.plans import views as V
from freshet.plans.registry import query
from freshet.sources.tables import read_table

KEYS = ["district", "station"]


def _frame(fn: str, col: str, a: int, b: int) -> str:
    def side(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"

    return f"{fn}({col}) OVER (PARTITION BY district, station ORDER BY time ROWS BETWEEN {side(a)} AND {side(b)})"


def _full(col: str, a: int, b: int, n: int | None = None) -> str:
    return f"CASE WHEN {_frame('COUNT', col, a, b)} >= {n or b - a + 1} THEN {_frame('MAX', col, a, b)} END"


@query("centered_max", "v_daily_gap", f"""
SELECT district, station, time, dis, {_full('dis', -3, 3, 3)} AS max_dt_3days FROM v_daily_gap""")
def centered_max(spark, d):
    return W.centred_max(V.v_daily_gap(spark, d), KEYS, "time", "dis")


@query("future_max", "v_daily_gap", "SELECT district, station, time, dis, " + ", ".join(
    f"{_full('dis', 1, k)} AS max_future_{k}days" for k in range(3, 8)) + " FROM v_daily_gap")
def future_max(spark, d):
    return W.future_max(V.v_daily_gap(spark, d), KEYS, "time", "dis")


@query("discharge_features", "v_series", f"SELECT district, station, time, dis, {_full('dis', -3, 3, 3)} AS max_dt_3days, "
       + ", ".join(f"{_full('dis', 1, k)} AS max_future_{k}days" for k in range(3, 8)) + " FROM v_series")
def discharge_features(spark, d):
    return W.discharge_features(V.v_series(spark, d), KEYS, "time")


@query("trailing_max", "v_days", f"""
SELECT district, station, time, {_full('flood', -13, 0)} AS "NB_flood14days", {_full('dis', -13, 0)} AS "NB_maxdis"
FROM v_days""")
def trailing_max(spark, d):
    outs = {"flood": "NB_flood14days", "dis": "NB_maxdis"}
    return W.trailing_max(V.v_days(spark, d), KEYS, "time", outs).select(*KEYS, "time", *outs.values())


@query("label_spread", "v_days", f"""
SELECT district, station, time, dis, flood FROM (
  SELECT district, station, time, dis, {_full('flood', 0, 2)} AS flood FROM v_days) WHERE flood IS NOT NULL""")
def label_spread(spark, d):
    return W.spread_label_back(V.v_days(spark, d), KEYS, "time")


@query("horizon_label", "v_series v_impact", f"""
SELECT district, station, time, dis, flood_old, flood FROM (
  SELECT district, station, time, flood_old, LEAD(dis, 2) OVER (PARTITION BY district, station ORDER BY time) AS dis,
         {_full('flood_old', 3, 7)} AS flood
  FROM (SELECT s.*, COALESCE(i.flood, 0) AS flood_old FROM v_series s
        LEFT JOIN v_impact i ON i.district = s.district AND i.time = s.time))
WHERE flood IS NOT NULL AND dis IS NOT NULL""")
def horizon_label(spark, d):
    series = V.v_series(spark, d).join(V.v_impact(spark, d), ["district", "time"], "left").withColumn(
        "flood", F.coalesce("flood", F.lit(0))
    )
    return W.horizon_label(series, KEYS, "time", "dis", 5, 3)


_RAIN = ", ".join(
    f"MAX(rain_max) OVER (PARTITION BY district ORDER BY time RANGE BETWEEN INTERVAL {t} DAY PRECEDING AND CURRENT ROW)"
    f" AS rainfall_max_{t}, ROUND(SUM(rain_mean) OVER (PARTITION BY district ORDER BY time RANGE BETWEEN"
    f" INTERVAL {t} DAY PRECEDING AND CURRENT ROW), 6) AS rainfall_cum_{t}" for t in range(10)
)


@query("rain_lag_features", "v_rain", f"SELECT district, time, {_RAIN} FROM v_rain")
def rain_lag_features(spark, d):
    history = W.rain_history(V.v_rain(spark, d), peak="rain_max", mean="rain_mean")
    return history.select(*[
        F.round(c, 6).alias(c) if c.startswith("rainfall_cum") else F.col(c) for c in history.columns
    ])


@query("runs", "v_days", """
SELECT district, station, time, high, SUM(ch) OVER (PARTITION BY district, station ORDER BY time) AS run FROM (
  SELECT *, CASE WHEN high = LAG(high) OVER (PARTITION BY district, station ORDER BY time) THEN 0 ELSE 1 END AS ch
  FROM (SELECT d.district, d.station, d.time, CASE WHEN d.dis >= t.cut THEN 1 ELSE 0 END AS high FROM v_days d
        JOIN (SELECT district, station, QUANTILE_CONT(dis, 0.75) AS cut FROM v_days GROUP BY 1, 2) t
        ON t.district = d.district AND t.station = d.station))""")
def runs(spark, d):
    """Runs of days in the upper quarter of their own series."""
    series = V.v_days(spark, d)
    cuts = series.groupBy(*KEYS).agg(F.percentile("dis", F.lit(0.75)).alias("cut"))
    days = series.join(cuts, KEYS).select(*KEYS, "time", (F.col("dis") >= F.col("cut")).cast("int").alias("high"))
    return W.run_ids(days, KEYS, "time", "high")


@query("minmax_scale", "v_series", """
SELECT district, station, time, ROUND((dis - lo) / NULLIF(hi - lo, 0), 6) AS dis FROM (
  SELECT *, MIN(dis) OVER (PARTITION BY district, station) AS lo, MAX(dis) OVER (PARTITION BY district, station) AS hi
  FROM v_series)""")
def minmax_scale(spark, d):
    return W.minmax_scale(V.v_series(spark, d), KEYS, ["dis"]).select(*KEYS, "time", F.round("dis", 6).alias("dis"))


@query("robust_scale", "v_series", """
SELECT s.district, s.station, s.time, ROUND((dis - q[2]) / CASE WHEN q[3] - q[1] = 0 THEN 1 ELSE q[3] - q[1] END, 6) AS dis
FROM v_series s JOIN (SELECT district, station, QUANTILE_CONT(dis, [0.25, 0.5, 0.75]) AS q FROM v_series GROUP BY 1, 2) t
ON t.district = s.district AND t.station = s.station""")
def robust_scale_series(spark, d):
    return robust_scale(V.v_series(spark, d), KEYS, ["dis"]).select(*KEYS, "time", F.round("dis", 6).alias("dis"))


@query("robust_scale_panel", sql="""
SELECT l_orderkey, l_linenumber, ROUND((l_extendedprice - q[2]) / (q[3] - q[1]), 6) AS price,
       ROUND((l_quantity - r[2]) / (r[3] - r[1]), 6) AS quantity
FROM lineitem, (SELECT QUANTILE_CONT(l_extendedprice, [0.25, 0.5, 0.75]) AS q,
                       QUANTILE_CONT(l_quantity, [0.25, 0.5, 0.75]) AS r FROM lineitem)""")
def robust_scale_panel(spark, d):
    """Scaling over the whole table: its quantiles are found without gathering the column."""
    lines = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")
    )
    return robust_scale_all(lines, ["price", "quantity"]).select(
        "l_orderkey", "l_linenumber", *rounded(["price", "quantity"])
    )


@query("exact_quantiles", sql="""
SELECT l_returnflag AS station, q, ROUND(v, 6) AS value FROM (
  SELECT l_returnflag, UNNEST([0.1, 0.5, 0.99]::DOUBLE[]) AS q,
         UNNEST(QUANTILE_CONT(l_extendedprice, [0.1, 0.5, 0.99])) AS v FROM lineitem GROUP BY 1)""")
def exact_quantile_groups(spark, d):
    lines = read_table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "station")
    return exact_quantiles(lines, ["station"], "l_extendedprice", [0.1, 0.5, 0.99]).select(
        "station", "q", F.round("value", 6).alias("value")
    )


def _resample_sql(w: int) -> str:
    return f"""
WITH f AS (SELECT district, MIN(time) AS f, MAX(time) AS l FROM v_rain GROUP BY 1),
spine AS (SELECT district, f, UNNEST(RANGE(0, CAST(FLOOR(DATE_DIFF('day', f, l) / {w}) AS BIGINT) + 1)) AS b FROM f),
agg AS (SELECT r.district, CAST(FLOOR(DATE_DIFF('day', f.f, r.time) / {w}) AS BIGINT) AS b, SUM(rain_max) AS rainfall,
               MAX(soil1) AS soil1, MAX(rain_mean) AS rain_mean
        FROM v_rain r JOIN f ON f.district = r.district GROUP BY 1, 2)
SELECT s.district, CAST(s.f + CAST(s.b * {w} AS INTEGER) AS DATE) AS time, COALESCE(a.rainfall, 0.0) AS rainfall,
       a.soil1, a.rain_mean
FROM spine s LEFT JOIN agg a ON a.district = s.district AND a.b = s.b"""


def _register_resample(w: int) -> None:
    @query(f"resample_w{w}", "v_rain", _resample_sql(w))
    def resampled(spark, d) -> DataFrame:
        rain = V.v_rain(spark, d).withColumnRenamed("rain_max", "rainfall")
        return RS.resample(rain, ["district"], w, ["rainfall"], ["soil1", "rain_mean"])


for _w in (3, 5, 7):
    _register_resample(_w)


@query("resample_gaps", "v_nation_series", """
WITH s AS (SELECT n.* FROM v_nation_series n
  JOIN (SELECT district, QUANTILE_CONT(dis, 0.9) AS cut FROM v_nation_series GROUP BY 1) t ON t.district = n.district
  WHERE n.dis >= t.cut),
f AS (SELECT district, MIN(time) AS f, MAX(time) AS l FROM s GROUP BY 1),
spine AS (SELECT district, f, UNNEST(RANGE(0, CAST(FLOOR(DATE_DIFF('day', f, l) / 3) AS BIGINT) + 1)) AS b FROM f),
agg AS (SELECT s.district, CAST(FLOOR(DATE_DIFF('day', f.f, s.time) / 3) AS BIGINT) AS b, SUM(dis) AS total,
               MAX(dis) AS dis FROM s JOIN f ON f.district = s.district GROUP BY 1, 2)
SELECT s.district, CAST(s.f + CAST(s.b * 3 AS INTEGER) AS DATE) AS time, ROUND(COALESCE(a.total, 0.0), 2) AS total, a.dis
FROM spine s LEFT JOIN agg a ON a.district = s.district AND a.b = s.b""")
def resample_gaps(spark, d):
    """Days in the upper tenth of their series only, so that most bins are empty."""
    series = V.v_nation_series(spark, d)
    cuts = series.groupBy("district").agg(F.percentile("dis", F.lit(0.9)).alias("cut"))
    high = series.join(cuts, "district").where(F.col("dis") >= F.col("cut")).drop("cut").withColumn("total", F.col("dis"))
    return RS.resample(high, ["district"], 3, ["total"], ["dis"]).withColumn("total", F.round("total", 2))


@query("date_spine", "v_nation_series", """
SELECT district, CAST(UNNEST(GENERATE_SERIES(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE) AS time
FROM v_nation_series GROUP BY 1""")
def date_spine(spark, d):
    return RS.date_spine(V.v_nation_series(spark, d), ["district"])


def _forecast_sql(w: int, n: int) -> str:
    daily, interval = W.discharge_offsets(w, n)
    lead = f"LEAD(dis, {-daily}) OVER (PARTITION BY district ORDER BY time)" if daily else "dis"
    lag = f"LAG(dis, {interval}) OVER x" if interval else "dis"
    return f"""
WITH base AS (SELECT s.district, s.time, s.dis, r.rain_max AS rainfall, r.soil1 AS soil, COALESCE(i.flood, 0) AS flood
  FROM (SELECT district, time, MAX(dis) AS dis FROM v_daily GROUP BY 1, 2) s
  LEFT JOIN v_rain r ON r.district = s.district AND r.time = s.time
  LEFT JOIN v_impact i ON i.district = s.district AND i.time = s.time),
led AS (SELECT district, time, {lead} AS dis, rainfall, soil, flood FROM base),
f AS (SELECT district, MIN(time) AS f, MAX(time) AS l FROM led GROUP BY 1),
spine AS (SELECT district, f, UNNEST(RANGE(0, CAST(FLOOR(DATE_DIFF('day', f, l) / {w}) AS BIGINT) + 1)) AS b FROM f),
agg AS (SELECT l.district, CAST(FLOOR(DATE_DIFF('day', f.f, l.time) / {w}) AS BIGINT) AS b, SUM(rainfall) AS rainfall,
        MAX(dis) AS dis, MAX(soil) AS soil, MAX(flood) AS flood FROM led l JOIN f ON f.district = l.district GROUP BY 1, 2),
bins AS (SELECT s.district, CAST(s.f + CAST(s.b * {w} AS INTEGER) AS DATE) AS time, COALESCE(a.rainfall, 0.0) AS rainfall,
         a.dis, a.soil, a.flood FROM spine s LEFT JOIN agg a ON a.district = s.district AND a.b = s.b),
moved AS (SELECT district, time, {lag} AS dis, LAG(rainfall, {n}) OVER x AS rainfall, LAG(soil, {n}) OVER x AS soil, flood
  FROM bins WINDOW x AS (PARTITION BY district ORDER BY time))
SELECT * FROM moved WHERE dis IS NOT NULL AND rainfall IS NOT NULL AND soil IS NOT NULL AND flood IS NOT NULL"""


def forecast_frame(spark, d, w: int, n: int) -> DataFrame:
    """District frame of one forecast configuration: lead, resample, lag, drop incomplete rows."""
    daily = V.v_daily(spark, d).groupBy("district", "time").agg(F.max("dis").alias("dis"))
    rain = V.v_rain(spark, d).select(
        "district", "time", F.col("rain_max").alias("rainfall"), F.col("soil1").alias("soil")
    )
    base = daily.join(rain, ["district", "time"], "left").join(
        V.v_impact(spark, d), ["district", "time"], "left"
    ).withColumn("flood", F.coalesce("flood", F.lit(0)))
    day_offset, interval_offset = W.discharge_offsets(w, n)
    led = W.shift_columns(base, ["district"], "time", {"dis": day_offset})
    bins = RS.resample(led, ["district"], w, ["rainfall"], ["dis", "soil", "flood"])
    offsets = {"dis": interval_offset, "rainfall": n, "soil": n}
    return W.shift_columns(bins, ["district"], "time", offsets).na.drop()


def _register_forecast(w: int, n: int) -> None:
    @query(f"lagged_forecast_w{w}_a{n}", "v_daily v_rain v_impact", _forecast_sql(w, n))
    def framed(spark, d) -> DataFrame:
        return forecast_frame(spark, d, w, n)


# The forecast configurations, window -> largest number of intervals ahead.
MAX_AHEAD = {3: 5, 5: 3, 7: 2}
for _w, _n in MAX_AHEAD.items():
    for _a in range(1, _n + 1):
        _register_forecast(_w, _a)


@query("block_maxima_6m", "v_series", """
SELECT district, station, CAST(CEIL((YEAR(time) * 12 + MONTH(time) - f) / 6.0) AS INT) AS block, MAX(dis) AS block_max
FROM v_series JOIN (SELECT district AS dd, station AS ss, MIN(YEAR(time) * 12 + MONTH(time)) AS f FROM v_series GROUP BY 1, 2)
ON dd = district AND ss = station GROUP BY 1, 2, 3""")
def block_maxima_6m(spark, d):
    return RS.block_maxima(V.v_series(spark, d), KEYS, "dis")


@query("block_maxima_year", "v_series", """
SELECT district, station, YEAR(time) AS block, MAX(dis) AS block_max FROM v_series GROUP BY 1, 2, 3""")
def block_maxima_year(spark, d):
    return RS.block_maxima(V.v_series(spark, d), KEYS, "dis", "year")


@query("block_quantiles", "v_series", """
WITH m AS (SELECT district, station, YEAR(time) AS y, MAX(dis) AS x FROM v_series GROUP BY 1, 2, 3)
SELECT district, station, ROUND(QUANTILE_CONT(x, 0.5), 6) AS "Q50", ROUND(QUANTILE_CONT(x, 0.8), 6) AS "Q80",
       ROUND(QUANTILE_CONT(x, 0.9), 6) AS "Q90" FROM m GROUP BY 1, 2""")
def block_quantiles(spark, d):
    found = RS.block_quantiles(RS.block_maxima(V.v_series(spark, d), KEYS, "dis", "year"), KEYS, [50, 80, 90])
    return found.select(*KEYS, *[F.col("thresholds")[i].alias(f"Q{p}") for i, p in enumerate((50, 80, 90))])


_LINEAR = """
WITH k AS (SELECT *, LAST_VALUE(dis IGNORE NULLS) OVER p AS pv,
    LAST_VALUE(CASE WHEN dis IS NOT NULL THEN time END IGNORE NULLS) OVER p AS pt,
    FIRST_VALUE(dis IGNORE NULLS) OVER n AS nv,
    FIRST_VALUE(CASE WHEN dis IS NOT NULL THEN time END IGNORE NULLS) OVER n AS nt FROM v_daily_gap
  WINDOW p AS (PARTITION BY district, station ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY district, station ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT district, station, time, COALESCE(dis, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL
    THEN pv + (nv - pv) * (DATE_DIFF('day', pt, time) / DATE_DIFF('day', pt, nt)) END, pv{head}) AS dis FROM k"""


@query("interpolate_linear", "v_daily_gap", _LINEAR.format(head=""))
def interpolate_linear(spark, d):
    return impute.interpolate_linear(V.v_daily_gap(spark, d), KEYS, ["dis"])


@query("interpolate_backfill", "v_daily_gap", _LINEAR.format(head=", nv"))
def interpolate_backfill(spark, d):
    return impute.interpolate_linear(V.v_daily_gap(spark, d), KEYS, ["dis"], backfill=True)


def _spline_sql(equations: str, value: str, least: int, head: str = "") -> str:
    """Tridiagonal equations solved by one recursion forwards and one backwards, then `value` in the gaps."""
    same = "{0}.district = {1}.district AND {0}.station = {1}.station".format
    return f"""
WITH RECURSIVE_ pts AS MATERIALIZED (SELECT district, station, CAST(DATE_DIFF('day', DATE '1970-01-01', time) AS DOUBLE) AS x, dis AS y,
    ROW_NUMBER() OVER (PARTITION BY district, station ORDER BY time) AS k, COUNT(*) OVER (PARTITION BY district, station) AS n
  FROM v_daily_gap WHERE dis IS NOT NULL),
gap AS MATERIALIZED (SELECT *, LEAD(x) OVER w - x AS h, (LEAD(y) OVER w - y) / (LEAD(x) OVER w - x) AS d FROM pts
  WHERE n >= {least} WINDOW w AS (PARTITION BY district, station ORDER BY k)),
{equations},
fwd AS (
  SELECT district, station, k, n, upper_ / main_ AS c, right_ / main_ AS e FROM eq WHERE k = 1
  UNION ALL
  SELECT q.district, q.station, q.k, q.n, q.upper_ / (q.main_ - q.lower_ * f.c), (q.right_ - q.lower_ * f.e) / (q.main_ - q.lower_ * f.c)
  FROM fwd f JOIN eq q ON {same("q", "f")} AND q.k = f.k + 1),
met AS MATERIALIZED (SELECT * FROM fwd),
bwd AS (
  SELECT district, station, k, e AS s FROM met WHERE k = n
  UNION ALL
  SELECT f.district, f.station, f.k, f.e - f.c * b.s FROM bwd b JOIN met f ON {same("f", "b")} AND f.k = b.k - 1),
sol AS MATERIALIZED (SELECT * FROM bwd),
g AS (SELECT district, station, time, dis, CAST(DATE_DIFF('day', DATE '1970-01-01', time) AS DOUBLE) AS x,
    COUNT(dis) OVER (PARTITION BY district, station ORDER BY time) AS k FROM v_daily_gap),
{value}"""


_CUBIC = _spline_sql("""
side AS (SELECT *, LAG(h) OVER w AS hb, LAG(d) OVER w AS db, LEAD(h) OVER w AS ha, LEAD(d) OVER w AS da, LAG(h, 2) OVER w AS hbb, LAG(d, 2) OVER w AS dbb
  FROM gap WINDOW w AS (PARTITION BY district, station ORDER BY k)),
eq AS MATERIALIZED (SELECT district, station, k, n,
    CASE WHEN k = 1 THEN 0 WHEN k = n THEN hb + hbb ELSE h END AS lower_,
    CASE WHEN k = 1 THEN ha WHEN k = n THEN hbb ELSE 2 * (hb + h) END AS main_,
    CASE WHEN k = 1 THEN h + ha WHEN k = n THEN 0 ELSE hb END AS upper_,
    CASE WHEN k = 1 THEN ((h + 2 * (h + ha)) * ha * d + h * h * da) / (h + ha)
         WHEN k = n THEN ((hb + 2 * (hb + hbb)) * hbb * db + hb * hb * dbb) / (hb + hbb)
         ELSE 3 * (h * db + hb * d) END AS right_ FROM side)""", """
piece AS (SELECT p.district, p.station, p.k, p.n, p.x, p.y, p.h, p.d, a.s, b.s AS s2
  FROM gap p JOIN sol a ON a.district = p.district AND a.station = p.station AND a.k = p.k
  JOIN sol b ON b.district = p.district AND b.station = p.station AND b.k = p.k + 1)
SELECT g.district, g.station, g.time, ROUND(COALESCE(g.dis, p.y + (g.x - p.x) * (p.s + (g.x - p.x) * (
    (3 * p.d - 2 * p.s - p.s2) / p.h + (g.x - p.x) * (p.s + p.s2 - 2 * p.d) / (p.h * p.h)))), 3) AS dis
FROM g LEFT JOIN (SELECT *, CASE WHEN k = n - 1 THEN n ELSE k END AS to_k FROM piece) p
  ON p.district = g.district AND p.station = g.station AND g.k BETWEEN p.k AND p.to_k""", 4)

_ORDER_TWO = _spline_sql("""
cut AS MATERIALIZED (SELECT district, station, k, n, CASE WHEN k = 1 THEN x WHEN k = n - 1 THEN x + h ELSE x + h / 2 END AS u FROM gap WHERE k < n),
span AS MATERIALIZED (SELECT *, u AS lo, LEAD(u) OVER w AS hi, COALESCE(LAG(u) OVER w, u) AS pre, COALESCE(LEAD(u, 2) OVER w, LEAD(u) OVER w) AS post
  FROM cut WINDOW w AS (PARTITION BY district, station ORDER BY k)),
met_at AS (SELECT p.district, p.station, p.k, p.n, p.y, (s.hi - p.x) ** 2 / ((s.hi - s.lo) * (s.hi - s.pre)) AS a,
    (p.x - s.lo) ** 2 / ((s.hi - s.lo) * (s.post - s.lo)) AS b
  FROM gap p LEFT JOIN span s ON s.district = p.district AND s.station = p.station AND s.k = p.k - 1 AND p.k < p.n),
eq AS MATERIALIZED (SELECT district, station, k, n, COALESCE(a, 0) AS lower_, COALESCE(1 - a - b, 1) AS main_, COALESCE(b, 0) AS upper_, y AS right_ FROM met_at)""", """
piece AS (SELECT s.*, a.s AS c1, b.s AS c2, c.s AS c3 FROM span s
  JOIN sol a ON a.district = s.district AND a.station = s.station AND a.k = s.k
  JOIN sol b ON b.district = s.district AND b.station = s.station AND b.k = s.k + 1
  JOIN sol c ON c.district = s.district AND c.station = s.station AND c.k = s.k + 2 WHERE s.hi IS NOT NULL),
f AS (SELECT district, station, y FROM pts WHERE k = 1)
SELECT g.district, g.station, g.time, ROUND(COALESCE(g.dis, CASE WHEN g.k = 0 THEN f.y END,
    p.c1 * (p.hi - g.x) ** 2 / ((p.hi - p.lo) * (p.hi - p.pre)) + p.c3 * (g.x - p.lo) ** 2 / ((p.hi - p.lo) * (p.post - p.lo))
    + p.c2 * (1 - (p.hi - g.x) ** 2 / ((p.hi - p.lo) * (p.hi - p.pre)) - (g.x - p.lo) ** 2 / ((p.hi - p.lo) * (p.post - p.lo)))), 3) AS dis
FROM g LEFT JOIN f ON f.district = g.district AND f.station = g.station
LEFT JOIN piece p ON p.district = g.district AND p.station = g.station AND g.x >= p.lo AND (g.x < p.hi OR p.k = p.n - 2)""", 3)


@query("interpolate_spline", "v_daily_gap", _CUBIC)
def interpolate_spline(spark, d):
    return impute.interpolate_spline(V.v_daily_gap(spark, d), KEYS, ["dis"]).select(*KEYS, "time", *rounded(["dis"], 3))


@query("interpolate_spline_order2", "v_daily_gap", _ORDER_TWO)
def interpolate_spline_order2(spark, d):
    filled = impute.interpolate_spline(V.v_daily_gap(spark, d), KEYS, ["dis"], backfill=True, order=2)
    return filled.select(*KEYS, "time", *rounded(["dis"], 3))


@query("interpolate_quadratic", "v_daily_gap", """
WITH pts AS (SELECT district, station, time, dis, ROW_NUMBER() OVER w AS k FROM v_daily_gap WHERE dis IS NOT NULL
             WINDOW w AS (PARTITION BY district, station ORDER BY time)),
g AS (SELECT district, station, time, dis, COUNT(dis) OVER (PARTITION BY district, station ORDER BY time) AS k FROM v_daily_gap),
j AS (SELECT g.district, g.station, g.time, g.dis, g.k, a.dis AS y1, b.dis AS y2, COALESCE(p.dis, c.dis) AS y3,
        CAST(DATE_DIFF('day', a.time, g.time) AS DOUBLE) AS t, CAST(DATE_DIFF('day', a.time, b.time) AS DOUBLE) AS u,
        CAST(DATE_DIFF('day', a.time, COALESCE(p.time, c.time)) AS DOUBLE) AS v, f.dis AS head
      FROM g LEFT JOIN pts a ON a.district = g.district AND a.station = g.station AND a.k = g.k
      LEFT JOIN pts b ON b.district = g.district AND b.station = g.station AND b.k = g.k + 1
      LEFT JOIN pts p ON p.district = g.district AND p.station = g.station AND p.k = g.k - 1
      LEFT JOIN pts c ON c.district = g.district AND c.station = g.station AND c.k = g.k + 2
      LEFT JOIN pts f ON f.district = g.district AND f.station = g.station AND f.k = 1)
SELECT district, station, time, COALESCE(dis, y1 * (t-u) * (t-v) / (u*v) + y2 * t * (t-v) / (u*(u-v))
  + y3 * t * (t-u) / (v*(v-u)), y1 + (y2-y1) * t / u, y1, head) AS dis FROM j""")
def interpolate_quadratic(spark, d):
    return impute.interpolate_quadratic(V.v_daily_gap(spark, d), KEYS, "dis")


def _swt_sql() -> str:
    """Level by level on series that continue with their mean, a second route to the same values."""
    def level(j: int, taps: list[float]) -> str:
        step = 2 ** (j - 1)
        terms = []
        for k, tap in enumerate(taps):
            o = (4 - k) * step
            if o == 0:
                terms.append(f"x * {tap!r}")
            else:
                fn = "LEAD" if o > 0 else "LAG"
                terms.append(f"COALESCE({fn}(x, {abs(o)}) OVER w, 0) * {tap!r}")
        return "(" + " + ".join(terms) + ") / SQRT(2.0E0)"

    sql = ["""
WITH s AS (SELECT district, station, time, dis, ROW_NUMBER() OVER (PARTITION BY district, station ORDER BY time) AS n,
           AVG(dis) OVER (PARTITION BY district, station) AS m, COUNT(*) OVER (PARTITION BY district, station) AS c FROM v_daily),
a0 AS (SELECT district, station, n, dis AS x FROM s
       UNION ALL SELECT district, station, UNNEST(RANGE(-199, 1)), m FROM s WHERE n = 1
       UNION ALL SELECT district, station, UNNEST(RANGE(c + 1, c + 201)), m FROM s WHERE n = 1)"""]
    for j in (1, 2, 3):
        w = "WINDOW w AS (PARTITION BY district, station ORDER BY n)"
        sql.append(f", d{j} AS (SELECT district, station, n, {level(j, wavelet.DB4_HIGH)} AS y FROM a{j - 1} {w})")
        sql.append(f", a{j} AS (SELECT district, station, n, {level(j, wavelet.DB4_LOW)} AS x FROM a{j - 1} {w})")
    sql.append("""
SELECT s.district, s.station, s.time, ROUND(d1.y, 3) AS dis_details_1, ROUND(d2.y, 3) AS dis_details_2,
       ROUND(d3.y, 3) AS dis_details_3, ROUND(a3.x, 3) AS dis_smooths_3 FROM s""")
    for t in ("d1", "d2", "d3", "a3"):
        sql.append(f" JOIN {t} ON {t}.district = s.district AND {t}.station = s.station AND {t}.n = s.n")
    return "".join(sql)


@query("wavelet_swt", "v_daily", _swt_sql())
def wavelet_swt(spark, d):
    transformed = wavelet.swt(V.v_daily(spark, d), KEYS, ["dis"])
    return transformed.select(*KEYS, "time", *rounded([c for c in transformed.columns if c.startswith("dis_")], 3))


@query("spectrum", "v_daily", """
SELECT district, station, k AS cycles, ROUND(SQRT(POW(AVG(dis * COS(a)), 2) + POW(AVG(dis * SIN(a)), 2)), 4) AS amplitude
FROM (SELECT district, station, dis, k, 2 * PI() / 365.25E0 * k * DATE_DIFF('day', DATE '1970-01-01', time) AS a
      FROM v_daily, RANGE(1, 11) r(k)) GROUP BY 1, 2, 3""")
def spectrum(spark, d):
    found = wavelet.spectrum(V.v_daily(spark, d), KEYS, "dis", list(range(1, 11)))
    return found.select(*KEYS, "cycles", F.round("amplitude", 4).alias("amplitude"))

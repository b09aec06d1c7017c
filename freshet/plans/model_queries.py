"""Queries over thresholds, scores, blocks, folds, exploration, comparison and space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from freshet.functions.expressions import SEASONS, correlation, rounded, year_season
from freshet.operators import blocks as B, compare as C, explore as E, learn as L, reshape as R, scores as S, spatial as G, sweep as SW
from freshet.operators.panel import clip_to_events
from freshet.operators.resample import block_maxima, block_quantiles, resample
from freshet.operators.windows import discharge_features, horizon_label, horizon_labels, minmax_scale
from freshet.plans import workflows, views as V
from freshet.plans.registry import query
from freshet.session import use_checkpoint_dir
from freshet.sources.sinks import write_results, write_table
from freshet.sources.tables import read_ranked_results, read_results, read_table
from freshet.plans.views import CELLS_SQL, EVENT_SCORES_SQL, MODELS, SCORES_SQL

KEYS = ["district", "station"]
SKILLS = ["f1", "pod", "far", "pofd", "csi"]
EVENT_SKILLS = ["pod", "far", "pofd", "csi"]


def _r(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"ROUND({c}, {digits}) AS {c}" for c in columns)


# -- feature frame used by the threshold models ------------------------------------------------

_MODEL_SQL = """
model AS (SELECT s.district, s.station, s.time, s.dis, COALESCE(i.flood, 0) AS flood,
  CASE WHEN COUNT(dis) OVER c >= 3 THEN MAX(dis) OVER c END AS max_dt_3days,
  CASE WHEN COUNT(dis) OVER f >= 3 THEN MAX(dis) OVER f END AS max_future_3days
  FROM v_series s LEFT JOIN v_impact i ON i.district = s.district AND i.time = s.time
  WINDOW c AS (PARTITION BY s.district, s.station ORDER BY s.time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
         f AS (PARTITION BY s.district, s.station ORDER BY s.time ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""


def model_frame(spark, d) -> DataFrame:
    features = discharge_features(V.v_series(spark, d), KEYS, "time", horizons=(3,))
    return features.join(V.v_impact(spark, d), ["district", "time"], "left").withColumn(
        "flood", F.coalesce("flood", F.lit(0))
    )


def _thresholds_sql(source: str, keys: str, col: str, percents: list[int], out: str) -> str:
    """Rounded quantiles of half-year maxima of `col`, one row per (keys, percent)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    prefixed = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
{out} AS (SELECT {keys}, UNNEST({percents}) AS percent, ROUND(UNNEST(qs), 6) AS threshold FROM (
  SELECT {keys}, QUANTILE_CONT(m, {[p / 100 for p in percents]}) AS qs FROM (
    SELECT {prefixed}, CEIL((YEAR(a.time) * 12 + MONTH(a.time) - b.f) / 6.0) AS blk, MAX(a.{col}) AS m
    FROM {source} a JOIN (SELECT {keys}, MIN(YEAR(time) * 12 + MONTH(time)) AS f FROM {source} GROUP BY ALL) b ON {on}
    GROUP BY ALL) GROUP BY {keys}))"""


_SWEEP_SQL = f"""
WITH {_MODEL_SQL}, {_thresholds_sql('model', 'district, station', 'max_dt_3days', SW.PERCENTS, 'thr')},
cells AS (SELECT m.district, m.station, t.percent, t.threshold, {CELLS_SQL}
  FROM (SELECT m.*, t.percent, t.threshold, CASE WHEN m.max_dt_3days >= t.threshold THEN 1 ELSE 0 END AS predicted
        FROM model m JOIN thr t ON t.district = m.district AND t.station = m.station) m
  JOIN thr t ON t.district = m.district AND t.station = m.station AND t.percent = m.percent GROUP BY ALL),
scored AS (SELECT *, {SCORES_SQL} FROM cells)"""


@query("sweep_scores", "v_series v_impact", _SWEEP_SQL + f"""
SELECT district, station, percent, threshold, hits, misses, false_alarms, corr_neg, {_r(SKILLS)} FROM scored""")
def sweep_scores(spark, d):
    scores = SW.threshold_scores(model_frame(spark, d), KEYS, "max_dt_3days")
    return scores.select(*KEYS, "percent", "threshold", *S.CELLS, *rounded(SKILLS))


@query("quantile_threshold_best", "v_series v_impact", _SWEEP_SQL + f"""
SELECT district, station, percent, threshold, hits, misses, false_alarms, corr_neg, {_r(SKILLS)} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY district, station ORDER BY f1 DESC, percent) AS r FROM scored) WHERE r = 1""")
def quantile_threshold_best(spark, d):
    scores = SW.threshold_scores(model_frame(spark, d), KEYS, "max_dt_3days")
    return SW.best_by(scores, KEYS, "f1", ["percent"]).select(
        *KEYS, "percent", "threshold", *S.CELLS, *rounded(SKILLS)
    )


_SUPPORT = """
kept AS (SELECT district FROM model GROUP BY district HAVING SUM(flood) / COUNT(DISTINCT station) >= 2)"""


def _fit_sql(model: str, predictor: str) -> str:
    return f"""
WITH {_MODEL_SQL}, {_SUPPORT.replace('FROM model', f'FROM {model}') if model == 'model' else model + _SUPPORT.replace('FROM model', 'FROM shifted')},
src AS (SELECT * FROM {'model' if model == 'model' else 'shifted'} WHERE district IN (SELECT district FROM kept)),
split AS (SELECT *, COALESCE(SUM(flood) OVER (PARTITION BY district, station ORDER BY time
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen,
          FLOOR(SUM(flood) OVER (PARTITION BY district, station) - CEIL(0.2E0 * SUM(flood) OVER (PARTITION BY district, station))) AS bound
          FROM src),
ok AS (SELECT * FROM split WHERE bound >= 1), train AS (SELECT * FROM ok WHERE seen < bound),
{_thresholds_sql('train', 'district, station', 'max_dt_3days', SW.PERCENTS, 'thr')},
tc AS (SELECT district, station, percent, threshold, {CELLS_SQL} FROM (
  SELECT t.*, h.percent, h.threshold, CASE WHEN t.{predictor} >= h.threshold THEN 1 ELSE 0 END AS predicted
  FROM train t JOIN thr h ON h.district = t.district AND h.station = t.station) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY district ORDER BY f1 DESC, station, percent) AS r
         FROM (SELECT *, {SCORES_SQL} FROM tc)) WHERE r = 1),
test AS (SELECT o.district, o.station, b.percent, b.threshold, {CELLS_SQL} FROM (
  SELECT o.*, CASE WHEN o.{predictor} >= b.threshold THEN 1 ELSE 0 END AS predicted FROM ok o
  JOIN best b ON b.district = o.district AND b.station = o.station WHERE o.seen >= o.bound) o
  JOIN best b ON b.district = o.district GROUP BY ALL)
SELECT district, station, percent, threshold, hits, misses, false_alarms, corr_neg, {_r(SKILLS)},
       hits + misses + false_alarms + corr_neg AS n_test, hits + misses AS n_floods
FROM (SELECT *, {SCORES_SQL} FROM test)"""


@query("threshold_fit", "v_series v_impact", _fit_sql("model", "max_dt_3days"))
def threshold_fit(spark, d):
    fitted = SW.fit_threshold(model_frame(spark, d), "max_dt_3days")
    return fitted.select(*KEYS, "percent", "threshold", *S.CELLS, *rounded(SKILLS), "n_test", "n_floods")


_SHIFTED = """shifted AS (SELECT district, station, time, dis, max_dt_3days, pred AS max_future_3days, lab AS flood FROM (
  SELECT *, LEAD(max_future_3days, 1) OVER w AS pred,
    CASE WHEN COUNT(flood) OVER (PARTITION BY district, station ORDER BY time ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) >= 3
    THEN MAX(flood) OVER (PARTITION BY district, station ORDER BY time ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) END AS lab
  FROM model WINDOW w AS (PARTITION BY district, station ORDER BY time)) WHERE pred IS NOT NULL AND lab IS NOT NULL), """


def shifted_frame(spark, d) -> DataFrame:
    return horizon_label(model_frame(spark, d), KEYS, "time", "max_future_3days", 3, 2)


@query("threshold_fit_ahead", "v_series v_impact", _fit_sql(_SHIFTED, "max_future_3days"))
def threshold_fit_ahead(spark, d):
    """Forecast two intervals ahead: label and predictor shifted before the split."""
    fitted = SW.fit_threshold(shifted_frame(spark, d), "max_future_3days")
    return fitted.select(*KEYS, "percent", "threshold", *S.CELLS, *rounded(SKILLS), "n_test", "n_floods")


_FOLDS = """
folded AS (SELECT *, 1 + (seen >= k + CASE WHEN m >= 2 THEN LEAST(1, m) ELSE 0 END)::INT
    + (seen >= 2*k + CASE WHEN m >= 2 THEN LEAST(2, m) ELSE 0 END)::INT
    + (seen >= 3*k + CASE WHEN m >= 2 THEN LEAST(3, m) ELSE 0 END)::INT
    + (seen >= 4*k + CASE WHEN m >= 2 THEN LEAST(4, m) ELSE 0 END)::INT AS fold
  FROM (SELECT *, n // 5 AS k, n % 5 AS m FROM (
    SELECT *, CAST(SUM(flood) OVER (PARTITION BY district, station) AS BIGINT) AS n,
      COALESCE(SUM(flood) OVER (PARTITION BY district, station ORDER BY time
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM {src}) WHERE n >= 5))"""


def _cv_sql(prefix: str, src: str, predictor: str) -> str:
    return f"""
WITH {_MODEL_SQL}, {prefix} {_FOLDS.format(src=src)},
train AS (SELECT f.*, r.k AS test_fold FROM folded f JOIN RANGE(1, 6) r(k) ON f.fold <> r.k),
{_thresholds_sql('train', 'district, station, test_fold', 'max_dt_3days', SW.PERCENTS, 'thr')},
tc AS (SELECT district, station, test_fold, percent, threshold, {CELLS_SQL} FROM (
  SELECT t.*, h.percent, h.threshold, CASE WHEN t.{predictor} >= h.threshold THEN 1 ELSE 0 END AS predicted
  FROM train t JOIN thr h ON h.district = t.district AND h.station = t.station AND h.test_fold = t.test_fold) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY district, station, test_fold ORDER BY f1 DESC, percent) AS r
         FROM (SELECT *, {SCORES_SQL} FROM tc)) WHERE r = 1),
test AS (SELECT district, station, test_fold, percent, {CELLS_SQL} FROM (
  SELECT f.*, b.test_fold, b.percent, CASE WHEN f.{predictor} >= b.threshold THEN 1 ELSE 0 END AS predicted
  FROM folded f JOIN best b ON b.district = f.district AND b.station = f.station AND b.test_fold = f.fold) GROUP BY ALL),
folds AS (SELECT *, hits + misses AS n_floods, hits + misses + false_alarms + corr_neg AS n_test, {SCORES_SQL} FROM test)"""


_FOLD_OUT = f"""
SELECT district, station, test_fold, percent, hits, misses, false_alarms, corr_neg, n_test, n_floods, {_r(SKILLS)} FROM folds"""
_STATION_COLS = ["f1", *S.CELLS, "csi", "pod", "far", "pofd", "n_floods"]
_STATION_OUT = """
SELECT district, station, """ + ", ".join(
    f"ROUND(avg_{c}, 6) AS avg_{c}, ROUND(std_{c}, 6) AS std_{c}" for c in _STATION_COLS) + """ FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY district ORDER BY avg_f1 DESC, station) AS r FROM (
    SELECT district, station, """ + ", ".join(
    (f"AVG({c} / n_test) AS avg_{c}, STDDEV_SAMP({c} / n_test) AS std_{c}" if c in S.CELLS
     else f"AVG({c}) AS avg_{c}, STDDEV_SAMP({c}) AS std_{c}") for c in _STATION_COLS) + """
    FROM folds GROUP BY 1, 2)) WHERE r = 1"""


@query("threshold_cv_folds", "v_series v_impact", _cv_sql("", "model", "max_dt_3days") + _FOLD_OUT)
def threshold_cv_folds(spark, d):
    folds = SW.cross_validate_thresholds(model_frame(spark, d), "max_dt_3days")
    return folds.select(*KEYS, "test_fold", "percent", *S.CELLS, "n_test", "n_floods", *rounded(SKILLS))


@query("threshold_cv", "v_series v_impact", _cv_sql("", "model", "max_dt_3days") + _STATION_OUT)
def threshold_cv(spark, d):
    best = workflows.benchmark(model_frame(spark, d))
    return best.select(*KEYS, *rounded([f"{p}_{c}" for c in _STATION_COLS for p in ("avg", "std")]))


@query("threshold_cv_ahead", "v_series v_impact", _cv_sql(_SHIFTED, "shifted", "max_future_3days") + _STATION_OUT)
def threshold_cv_ahead(spark, d):
    best = workflows.benchmark(model_frame(spark, d), "max_future_3days", n_ahead=2)
    return best.select(*KEYS, *rounded([f"{p}_{c}" for c in _STATION_COLS for p in ("avg", "std")]))


# -- event-based scores -------------------------------------------------------------------------

_CLIPPED = """
clip AS (SELECT * FROM model WHERE time > (SELECT MIN(time) - INTERVAL 7 DAY FROM v_impact)
                               AND time < (SELECT MAX(time) + INTERVAL 7 DAY FROM v_impact))"""


def _event_sql(thresholds: str, hits: str) -> str:
    """Runs found day by day for every threshold, as the definition reads."""
    return f"""
WITH {_MODEL_SQL}, {_CLIPPED}, {thresholds},
p AS (SELECT c.district, c.station, c.time, c.flood, t.percent, t.threshold,
             CASE WHEN c.max_dt_3days >= t.threshold THEN 1 ELSE 0 END AS predicted
      FROM clip c JOIN thr t ON t.district = c.district AND t.station = c.station),
r AS (SELECT *, SUM(ch) OVER (PARTITION BY district, station, percent ORDER BY time) AS run FROM (
  SELECT *, CASE WHEN predicted = LAG(predicted) OVER (PARTITION BY district, station, percent ORDER BY time)
                 THEN 0 ELSE 1 END AS ch FROM p)),
g AS (SELECT district, station, percent, threshold, run, MAX(predicted) AS warning,
             COUNT(*) FILTER (WHERE flood = 1 AND predicted = 1) AS hd,
             COUNT(*) FILTER (WHERE flood = 1 AND predicted = 0) AS ms FROM r GROUP BY ALL),
cells AS (SELECT district, station, percent, threshold, CAST({hits} AS BIGINT) AS hits, CAST(SUM(ms) AS BIGINT) AS misses,
                 CAST(SUM(warning) - {hits} AS BIGINT) AS false_alarms FROM g GROUP BY ALL),
ev AS (SELECT *, hits + misses AS corr_neg, {EVENT_SCORES_SQL} FROM cells)"""


_PER_RUN, _PER_DAY = "COUNT(*) FILTER (WHERE hd > 0)", "SUM(hd)"
_EVENT_OUT = f"""
SELECT district, station, percent, threshold, hits, misses, false_alarms, corr_neg, {_r(EVENT_SKILLS)} FROM ev"""
_YEAR_THR = """
thr AS (SELECT district, station, UNNEST([50, 80, 90]) AS percent, ROUND(UNNEST(qs), 6) AS threshold FROM (
  SELECT district, station, QUANTILE_CONT(m, [0.5, 0.8, 0.9]) AS qs FROM (
    SELECT district, station, YEAR(time) AS y, MAX(dis) AS m FROM v_series GROUP BY ALL) GROUP BY 1, 2))"""
_HALF_THR = _thresholds_sql("v_series", "district, station", "dis", SW.EVENT_PERCENTS, "thr")


def _clipped(spark, d) -> DataFrame:
    return clip_to_events(model_frame(spark, d), V.v_impact(spark, d))


def _event_select(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "percent", "threshold", *S.CELLS, *rounded(EVENT_SKILLS))


@query("event_scores", "v_series v_impact", _event_sql(_HALF_THR, _PER_RUN) + _EVENT_OUT)
def event_scores(spark, d):
    thresholds = block_quantiles(block_maxima(V.v_series(spark, d), KEYS, "dis"), KEYS, SW.EVENT_PERCENTS)
    return _event_select(
        SW.event_sweep(_clipped(spark, d), thresholds, KEYS, "max_dt_3days", SW.EVENT_PERCENTS)
    )


@query("event_scores_daily_hits", "v_series v_impact", _event_sql(_HALF_THR, _PER_DAY) + _EVENT_OUT)
def event_scores_daily_hits(spark, d):
    thresholds = block_quantiles(block_maxima(V.v_series(spark, d), KEYS, "dis"), KEYS, SW.EVENT_PERCENTS)
    return _event_select(
        SW.event_sweep(_clipped(spark, d), thresholds, KEYS, "max_dt_3days", SW.EVENT_PERCENTS, hits="per_day")
    )


@query("event_scores_single", "v_series v_impact", _event_sql(_YEAR_THR.replace("[50, 80, 90]", "[80]").replace(
    "[0.5, 0.8, 0.9]", "[0.8]"), _PER_RUN) + f"""
SELECT district, station, hits, misses, false_alarms, corr_neg, {_r(EVENT_SKILLS)} FROM ev""")
def event_scores_single(spark, d):
    """One threshold through explicit runs, the plain form of the event-based table."""
    thresholds = block_quantiles(block_maxima(V.v_series(spark, d), KEYS, "dis", "year"), KEYS, [80])
    days = _clipped(spark, d).join(thresholds, KEYS).withColumn(
        "predicted", F.coalesce((F.col("max_dt_3days") >= F.col("thresholds")[0]).cast("int"), F.lit(0))
    )
    return S.event_scores(days, KEYS, "time").select(*KEYS, *S.CELLS, *rounded(EVENT_SKILLS))


@query("fixed_threshold_scores", "v_series v_impact", _event_sql(_YEAR_THR, _PER_RUN) + f"""
SELECT n.district, n.nb_event, e.station, 'Q' || e.percent || '_pred' AS quantile, {_r(EVENT_SKILLS)}
FROM (SELECT district, COUNT(flood) AS nb_event FROM v_impact GROUP BY 1) n LEFT JOIN ev e ON e.district = n.district""")
def fixed_threshold_scores(spark, d):
    """Annual-maximum Q50/Q80/Q90 thresholds with the number of recorded events."""
    percents = [50, 80, 90]
    thresholds = block_quantiles(block_maxima(V.v_series(spark, d), KEYS, "dis", "year"), KEYS, percents)
    scores = SW.event_sweep(_clipped(spark, d), thresholds, KEYS, "max_dt_3days", percents)
    events = V.v_impact(spark, d).groupBy("district").agg(F.count("flood").alias("nb_event"))
    named = scores.withColumn("quantile", F.concat(F.lit("Q"), F.col("percent").cast("string"), F.lit("_pred")))
    return events.join(named, "district", "left").select(
        "district", "nb_event", "station", "quantile", *rounded(EVENT_SKILLS)
    )


_OBJECTIVE = "0.5E0 * far + 0.5E0 * (1 - pod)"


@query("threshold_objective", "v_series v_impact", _event_sql(_HALF_THR, _PER_RUN) + f"""
SELECT district, station, percent, ROUND(o, 6) AS objective, {_r(EVENT_SKILLS)} FROM (
  SELECT *, {_OBJECTIVE} AS o, ROW_NUMBER() OVER (PARTITION BY district ORDER BY {_OBJECTIVE} NULLS LAST, station, percent) AS r
  FROM ev) WHERE r = 1""")
def threshold_objective(spark, d):
    thresholds = block_quantiles(block_maxima(V.v_series(spark, d), KEYS, "dis"), KEYS, SW.EVENT_PERCENTS)
    scored = SW.event_sweep(_clipped(spark, d), thresholds, KEYS, "max_dt_3days", SW.EVENT_PERCENTS)
    return SW.optimise_threshold(scored).select(*KEYS, "percent", *rounded(["objective", *EVENT_SKILLS]))


@query("min_far_threshold", "v_series v_impact", _event_sql(_HALF_THR, _PER_DAY) + f"""
SELECT district, station, percent, {_r(EVENT_SKILLS)} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY district ORDER BY far NULLS LAST, station, percent) AS r FROM ev) WHERE r = 1""")
def min_far_threshold(spark, d):
    thresholds = block_quantiles(block_maxima(V.v_series(spark, d), KEYS, "dis"), KEYS, SW.EVENT_PERCENTS)
    scored = SW.event_sweep(
        _clipped(spark, d), thresholds, KEYS, "max_dt_3days", SW.EVENT_PERCENTS, hits="per_day"
    )
    best = SW.best_by(scored, ["district"], "far", ["station", "percent"], highest=False)
    return best.select(*KEYS, "percent", *rounded(EVENT_SKILLS))


# -- blocks, folds, splits ----------------------------------------------------------------------

_WEEK = 7
_DISTRICT_DAYS = """
dd AS (SELECT district, time, MAX(dis) AS dis, MAX(flood) AS flood FROM v_days GROUP BY 1, 2)"""
_BINS = f"""
f0 AS (SELECT district, MIN(time) AS f FROM dd GROUP BY 1),
bins AS (SELECT district, CAST(f + CAST(b * {_WEEK} AS INTEGER) AS DATE) AS time, dis, flood FROM (
  SELECT d.district, f0.f, CAST(FLOOR(DATE_DIFF('day', f0.f, d.time) / {_WEEK}) AS BIGINT) AS b, MAX(dis) AS dis,
         MAX(flood) AS flood FROM dd d JOIN f0 ON f0.district = d.district GROUP BY ALL))"""


def _blocks_sql(window: int | None) -> str:
    src, reach, days = ("bins", B.half_width(window), window) if window else ("dd", B.half_width(None), 1)
    return f"""
WITH {_DISTRICT_DAYS}, {_BINS},
num AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY district ORDER BY time) AS rn,
        COUNT(*) OVER (PARTITION BY district) AS n FROM {src}),
evs AS (SELECT *, SUM(o) OVER (PARTITION BY district ORDER BY rn) AS block FROM (
  SELECT *, CASE WHEN rn - LAG(rn) OVER (PARTITION BY district ORDER BY rn) <= {reach} THEN 0 ELSE 1 END AS o
  FROM num WHERE flood = 1)),
isl AS (SELECT district, block, MIN(rn) - {reach} AS a, MAX(rn) + {reach} AS z, MAX(n) AS n, MIN(time) AS ft, MAX(time) AS lt
        FROM evs GROUP BY 1, 2),
gap AS (SELECT *, CEIL(DATE_DIFF('day', lt, LEAD(ft) OVER w) / {days}.0) AS g1,
        CEIL(DATE_DIFF('day', LAG(lt) OVER w, ft) / {days}.0) AS g0 FROM isl WINDOW w AS (PARTITION BY district ORDER BY block)),
ovl AS (SELECT *, CASE WHEN g1 <= {2 * reach} THEN {2 * reach} - g1 + 1 ELSE 0 END AS e1,
        CASE WHEN g0 <= {2 * reach} THEN {2 * reach} - g0 + 1 ELSE 0 END AS e0 FROM gap),
trimmed AS (SELECT *, GREATEST(a, 1) + FLOOR(e0 / 3) AS lo, LEAST(z, n) - (e1 - FLOOR(e1 / 3)) AS hi FROM ovl),
untrimmed AS (SELECT *, GREATEST(a, 1) AS lo, LEAST(z, n) AS hi FROM isl)"""


def district_days(spark, d) -> DataFrame:
    return V.v_days(spark, d).groupBy("district", "time").agg(F.max("dis").alias("dis"), F.max("flood").alias("flood"))


def district_bins(spark, d) -> DataFrame:
    return resample(district_days(spark, d), ["district"], _WEEK, [], ["dis", "flood"])


@query("event_blocks", "v_days", _blocks_sql(_WEEK) + """
SELECT n.district, n.time, n.dis, n.flood, CAST(t.block AS BIGINT) AS block FROM num n
JOIN untrimmed t ON t.district = n.district AND n.rn BETWEEN t.lo AND t.hi""")
def event_blocks(spark, d):
    return B.event_blocks(district_bins(spark, d), _WEEK, trim=False)


@query("event_blocks_trimmed", "v_days", _blocks_sql(_WEEK) + """
SELECT n.district, n.time, n.dis, n.flood, CAST(t.block AS BIGINT) AS block FROM num n
JOIN trimmed t ON t.district = n.district AND n.rn BETWEEN t.lo AND t.hi""")
def event_blocks_trimmed(spark, d):
    return B.event_blocks(district_bins(spark, d), _WEEK)


@query("event_blocks_daily", "v_days", _blocks_sql(None) + """
SELECT n.district, n.time, n.flood, CAST(t.block AS BIGINT) AS block FROM num n
JOIN trimmed t ON t.district = n.district AND n.rn BETWEEN t.lo AND t.hi""")
def event_blocks_daily(spark, d):
    return B.event_blocks(district_days(spark, d), None).select("district", "time", "flood", "block")


@query("block_folds", "v_days", _blocks_sql(None) + """
SELECT district, block, (DENSE_RANK() OVER (PARTITION BY district ORDER BY block) - 1) % 5 + 1 AS fold,
       MIN(time) FILTER (WHERE flood = 1) AS earliest_event, MAX(time) FILTER (WHERE flood = 1) AS latest_event,
       COUNT(*) AS n_rows
FROM (SELECT n.district, n.time, n.flood, CAST(t.block AS BIGINT) AS block FROM num n
      JOIN trimmed t ON t.district = n.district AND n.rn BETWEEN t.lo AND t.hi) GROUP BY 1, 2""")
def block_folds(spark, d):
    folded = B.block_folds(B.event_blocks(district_days(spark, d), None))
    return B.events_around(folded, ["district", "block", "fold"])


@query("block_support", "v_days", _blocks_sql(None) + """,
f AS (SELECT district, block, (DENSE_RANK() OVER (PARTITION BY district ORDER BY block) - 1) % 5 AS fold FROM isl),
c AS (SELECT district, COUNT(*) AS n, MAX(k) AS big FROM (SELECT district, fold, COUNT(*) OVER (PARTITION BY district, fold) AS k
      FROM f) GROUP BY 1)
SELECT district, n AS n_blocks, CASE WHEN n - big >= 5 THEN 5 WHEN n - big > 2 THEN n - big ELSE 0 END AS inner_folds,
  CASE WHEN n < 5 THEN 'fewer blocks than folds' WHEN n - big <= 2 THEN 'too few training blocks' ELSE 'ok' END AS reason
FROM c""")
def block_support(spark, d):
    return B.block_support(B.event_blocks(district_days(spark, d), None))


@query("balanced_folds", "v_days", _blocks_sql(_WEEK) + """,
sizes AS (SELECT n.district, CAST(t.block AS BIGINT) AS block, COUNT(*) AS n_rows FROM num n
          JOIN trimmed t ON t.district = n.district AND n.rn BETWEEN t.lo AND t.hi GROUP BY 1, 2),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY district ORDER BY n_rows DESC, block) AS k,
           COUNT(*) OVER (PARTITION BY district) AS n_blocks FROM sizes),
RECURSIVE_deal AS (
  SELECT district, 0::BIGINT AS k, list_transform(range(LEAST(5, MAX(n_blocks))), lambda i: 0::BIGINT) AS loads,
         NULL::BIGINT AS block, 0::BIGINT AS n_rows, NULL::INTEGER AS inner_fold
  FROM ranked GROUP BY district
  UNION ALL
  SELECT d.district, r.k, list_transform(d.loads, lambda x, i: x + CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN r.n_rows ELSE 0 END),
         r.block, r.n_rows, CAST(list_position(d.loads, list_min(d.loads)) - 1 AS INTEGER)
  FROM deal d JOIN ranked r ON r.district = d.district AND r.k = d.k + 1)
SELECT district, block, n_rows, inner_fold FROM deal WHERE block IS NOT NULL""")
def balanced_folds(spark, d):
    """Whole blocks dealt to the lightest fold, the largest first; the SQL deals them one by one."""
    return L.group_folds(B.event_blocks(district_bins(spark, d), _WEEK))


@query("fold_train_rows", "v_days", _blocks_sql(_WEEK) + """,
f AS (SELECT n.district, n.time, n.flood, (DENSE_RANK() OVER (PARTITION BY n.district ORDER BY t.block) - 1) % 5 + 1 AS fold
      FROM num n JOIN trimmed t ON t.district = n.district AND n.rn BETWEEN t.lo AND t.hi)
SELECT k AS test_fold, district, COUNT(*) AS n_train, CAST(SUM(flood) AS BIGINT) AS floods_train FROM f
JOIN RANGE(1, 6) r(k) ON f.fold <> k GROUP BY 1, 2""")
def fold_train_rows(spark, d):
    """Training rows of each outer fold are the panel minus the fold."""
    folded = B.block_folds(B.event_blocks(district_bins(spark, d), _WEEK))
    every = folded.withColumn("test_fold", F.explode(F.sequence(F.lit(1), F.lit(B.N_FOLDS))))
    return every.where(F.col("fold") != F.col("test_fold")).groupBy("test_fold", "district").agg(
        F.count(F.lit(1)).alias("n_train"), F.sum("flood").alias("floods_train")
    )


@query("flood_count_folds", "v_days", "WITH " + _FOLDS.format(src="v_days") + """
SELECT district, station, time, flood, fold FROM folded""")
def flood_count_folds(spark, d):
    return B.flood_count_folds(V.v_days(spark, d), KEYS, "time").select(*KEYS, "time", "flood", "fold")


@query("chrono_split", "v_days", """
SELECT district, station, time, flood, seen < bound AS is_train FROM (
  SELECT *, COALESCE(SUM(flood) OVER (PARTITION BY district, station ORDER BY time
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen,
    FLOOR(SUM(flood) OVER (PARTITION BY district, station) - CEIL(0.2E0 * SUM(flood) OVER (PARTITION BY district, station))) AS bound
  FROM v_days) WHERE bound >= 1""")
def chrono_split(spark, d):
    return B.chronological_split(V.v_days(spark, d), KEYS, "time").select(*KEYS, "time", "flood", "is_train")


@query("support_report", "v_nation_series v_nation_impact", """
WITH p AS (SELECT s.district, 'all' AS station, COALESCE(i.flood, 0) AS flood FROM v_nation_series s
           LEFT JOIN v_nation_impact i ON i.district = s.district AND i.time = s.time)
SELECT district, SUM(flood) / COUNT(DISTINCT station) AS events_per_station, CAST(SUM(flood) AS BIGINT) AS max_events,
  CASE WHEN COUNT(DISTINCT flood) < 2 THEN 'one class' WHEN SUM(flood) / COUNT(DISTINCT station) < 2 THEN 'too few events'
       WHEN SUM(flood) < 5 THEN 'fewer events than folds' ELSE 'ok' END AS reason FROM p GROUP BY 1""")
def support_report(spark, d):
    panel = V.v_nation_series(spark, d).join(V.v_nation_impact(spark, d), ["district", "time"], "left").select(
        "district", F.lit("all").alias("station"), F.coalesce("flood", F.lit(0)).alias("flood")
    )
    return B.support_report(panel)


@query("sequences", "v_days", _blocks_sql(_WEEK) + """,
q AS (SELECT n.district, CAST(t.block AS BIGINT) AS block, n.time, n.flood,
  LIST([n.dis]) OVER (PARTITION BY n.district, t.block ORDER BY n.time ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sequence
  FROM num n JOIN trimmed t ON t.district = n.district AND n.rn BETWEEN t.lo AND t.hi)
SELECT district, block, time, flood, sequence[1][1] AS x1, sequence[4][1] AS x4, sequence[7][1] AS x7
FROM q WHERE LEN(sequence) = 7""")
def sequences(spark, d):
    blocked = B.event_blocks(district_bins(spark, d), _WEEK)
    steps = B.sequence_steps(_WEEK)
    made = B.sequences(blocked, ["district", "block"], "time", ["dis"], steps)
    return made.select(
        "district", "block", "time", "flood",
        *[F.col("sequence")[i - 1][0].alias(f"x{i}") for i in (1, 4, 7)],
    )


@query("class_weights", "v_days", """
SELECT district, station, time, ROUND((SELECT COUNT(*) FROM v_days) / (2.0E0 * c.n), 6) AS weight
FROM v_days d JOIN (SELECT flood, COUNT(*) AS n FROM v_days GROUP BY 1) c ON c.flood = d.flood""")
def class_weights(spark, d):
    return S.class_weights(V.v_days(spark, d)).select(*KEYS, "time", F.round("weight", 6).alias("weight"))


# -- exploration --------------------------------------------------------------------------------

_SEASON_SQL = """CASE WHEN MONTH(time) IN (6,7,8) THEN 'summer' WHEN MONTH(time) IN (9,10,11) THEN 'fall'
 WHEN MONTH(time) IN (12,1,2) THEN 'winter' ELSE 'spring' END"""


@query("event_totals", "v_impact", """
SELECT district, CAST(SUM(flood) AS BIGINT) AS n_floods, COUNT(flood) AS nb_event FROM v_impact GROUP BY 1""")
def event_totals(spark, d):
    return V.v_impact(spark, d).groupBy("district").agg(
        F.sum("flood").alias("n_floods"), F.count("flood").alias("nb_event")
    ).orderBy("n_floods", "district")


@query("district_means", "v_rain", """
SELECT district, """ + ", ".join(f"ROUND(AVG({c}), 6) AS {c}" for c in ("rain_max", "rain_mean", "soil1", "soil2"))
       + " FROM v_rain GROUP BY 1")
def district_means(spark, d):
    columns = ["rain_max", "rain_mean", "soil1", "soil2"]
    return V.v_rain(spark, d).groupBy("district").agg(*[F.round(F.avg(c), 6).alias(c) for c in columns])


@query("season_profile", "v_rain", f"""
WITH k AS (SELECT DISTINCT district FROM v_rain), s AS (SELECT UNNEST({SEASONS}) AS season)
SELECT k.district, s.season, ROUND(AVG(r.rain_mean), 6) AS rain FROM k CROSS JOIN s
LEFT JOIN (SELECT *, {_SEASON_SQL} AS season FROM v_rain) r ON r.district = k.district AND r.season = s.season GROUP BY 1, 2""")
def season_profile(spark, d):
    return E.by_season(V.v_rain(spark, d), ["district"], F.round(F.avg("rain_mean"), 6), "rain")


@query("season_matrix", "v_impact", """
SELECT district, """ + ", ".join(
    f"CAST(SUM(flood) FILTER (WHERE season = '{s}') AS BIGINT) AS {s}" for s in SEASONS) + f"""
FROM (SELECT *, {_SEASON_SQL} AS season FROM v_impact) GROUP BY 1""")
def season_matrix(spark, d):
    return E.season_matrix(V.v_impact(spark, d), ["district"], F.sum("flood"))


@query("year_profile", "v_impact v_rain", """
SELECT CAST(y AS INT) AS year, f.n AS n_floods, r.rain
FROM (SELECT UNNEST(RANGE(MIN(YEAR(time)), MAX(YEAR(time)) + 1)) AS y FROM v_rain) t
LEFT JOIN (SELECT YEAR(time) AS yy, CAST(SUM(flood) AS BIGINT) AS n FROM v_impact GROUP BY 1) f ON f.yy = y
LEFT JOIN (SELECT YEAR(time) AS yy, ROUND(AVG(rain_mean), 6) AS rain FROM v_rain GROUP BY 1) r ON r.yy = y""")
def year_profile(spark, d):
    floods = E.by_year(V.v_impact(spark, d), F.sum("flood"), "n_floods", zero=True)
    rain = E.by_year(V.v_rain(spark, d), F.round(F.avg("rain_mean"), 6), "rain")
    return rain.join(floods, "year", "left").select("year", "n_floods", "rain").orderBy("year")


@query("year_season_keys", "v_impact", f"""
SELECT DISTINCT YEAR(time) || ' ' || {_SEASON_SQL} AS year_season, {_SEASON_SQL} AS season FROM v_impact""")
def year_season_keys(spark, d):
    keys = V.v_impact(spark, d).select(year_season(F.col("time")).alias("year_season")).distinct()
    return keys.select("year_season", F.split("year_season", " ", 2)[1].alias("season"))


@query("avg_per_period", "v_impact", f"""
WITH k AS (SELECT DISTINCT district FROM v_impact),
y AS (SELECT district, YEAR(time) AS p, SUM(flood) AS n FROM v_impact GROUP BY 1, 2),
s AS (SELECT district, YEAR(time) || ' ' || {_SEASON_SQL} AS p, SUM(flood) AS n FROM v_impact GROUP BY 1, 2),
ya AS (SELECT k.district, AVG(COALESCE(y.n, 0)) AS per_year FROM k CROSS JOIN (SELECT DISTINCT p FROM y) q
       LEFT JOIN y ON y.district = k.district AND y.p = q.p GROUP BY 1),
sa AS (SELECT k.district, SPLIT_PART(q.p, ' ', 2) AS season, AVG(COALESCE(s.n, 0)) AS per_season FROM k
       CROSS JOIN (SELECT DISTINCT p FROM s) q LEFT JOIN s ON s.district = k.district AND s.p = q.p GROUP BY 1, 2)
SELECT sa.district, sa.season, ROUND(ya.per_year, 6) AS per_year, ROUND(sa.per_season, 6) AS per_season
FROM sa JOIN ya ON ya.district = sa.district""")
def avg_per_period(spark, d):
    impact = V.v_impact(spark, d)
    yearly = E.average_per_period(impact, ["district"], "year", F.sum("flood")).withColumnRenamed("average", "per_year")
    seasonal = E.average_per_period(impact, ["district"], "year_season", F.sum("flood"))
    return seasonal.withColumnRenamed("average", "per_season").join(yearly, "district").select(
        "district", "season", *rounded(["per_year", "per_season"])
    )


@query("variance_per_period", "v_series", """
WITH n AS (SELECT district, time, (dis - lo) / NULLIF(hi - lo, 0) AS x FROM (SELECT *,
  MIN(dis) OVER (PARTITION BY district, station) AS lo, MAX(dis) OVER (PARTITION BY district, station) AS hi FROM v_series)),
v AS (SELECT district, YEAR(time) AS y, VAR_SAMP(x) AS v FROM n GROUP BY 1, 2)
SELECT v.district, ROUND(AVG(v.v), 6) AS variance_dis, ANY_VALUE(m.m) AS mean_dis
FROM v JOIN (SELECT district, ROUND(AVG(x), 6) AS m FROM n GROUP BY 1) m ON m.district = v.district GROUP BY 1""")
def variance_per_period(spark, d):
    """Mean over years of the variance of normalised discharge, and its mean."""
    scaled = minmax_scale(V.v_series(spark, d), KEYS, ["dis"])
    variance = E.average_per_period(scaled, ["district"], "year", F.var_samp("dis"), zero=False)
    means = scaled.groupBy("district").agg(F.round(F.avg("dis"), 6).alias("mean_dis"))
    return variance.select("district", F.round("average", 6).alias("variance_dis")).join(means, "district")


@query("axis_bounds", "v_rain", """
SELECT FLOOR(MIN(m) / 5.0) * 5.0 AS lower, CEIL(MAX(m) / 5.0) * 5.0 AS upper FROM (
  SELECT district, AVG(rain_max) AS m FROM v_rain GROUP BY 1)""")
def axis_bounds(spark, d):
    means = V.v_rain(spark, d).groupBy("district").agg(F.avg("rain_max").alias("m"))
    return E.axis_bounds(means, "m", 5.0)


# -- comparison of models ---------------------------------------------------------------------

_PAIRS = " UNION ALL ".join(f"SELECT model, district, '{s}' AS score, {s} AS x FROM v_results" for s in ("f1", "csi"))


@query("sign_test", "v_results", f"""
WITH l AS ({_PAIRS})
SELECT a.model AS model_a, b.model AS model_b, a.score, COUNT(*) FILTER (WHERE a.x > b.x) AS wins, COUNT(*) AS n,
  ROUND((COUNT(*) FILTER (WHERE a.x > b.x) - COUNT(*) / 2.0) / (0.5 * SQRT(COUNT(*))), 6) AS z,
  (COUNT(*) FILTER (WHERE a.x > b.x) - COUNT(*) / 2.0) / (0.5 * SQRT(COUNT(*))) >= 1.645 AS significant
FROM l a JOIN l b ON a.district = b.district AND a.score = b.score AND a.model <> b.model GROUP BY 1, 2, 3""")
def sign_test(spark, d):
    return C.sign_test(V.v_results(spark, d), MODELS, ["f1", "csi"]).withColumn("z", F.round("z", 6))


_ORDER = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS)) + " END"


@query("best_model", "v_results", f"""
SELECT district, model AS best_model, f1, csi, ROUND(hits / t, 6) AS hits, ROUND(misses / t, 6) AS misses,
       ROUND(false_alarms / t, 6) AS false_alarms, ROUND(corr_neg / t, 6) AS corr_neg
FROM (SELECT *, hits + misses + false_alarms + corr_neg AS t,
        ROW_NUMBER() OVER (PARTITION BY district ORDER BY f1 DESC, {_ORDER}) AS r FROM v_results WHERE f1 > 0) WHERE r = 1""")
def best_model(spark, d):
    best = C.best_model(S.add_rates(V.v_results(spark, d)), MODELS)
    return best.select("district", "best_model", "f1", "csi", *rounded(S.CELLS))


def ranked_results(spark, d, folder: str) -> DataFrame:
    """Results and their ranking by mean f1 written to `folder`, and the best read back."""
    results = V.v_results(spark, d).withColumns({"window": F.lit(1), "n_ahead": F.lit(1), "wt": F.lit(False)})
    write_results(results, f"{folder}/results")
    keys = ["model", "window", "n_ahead", "wt"]
    means = read_results(spark, f"{folder}/results").groupBy(*keys).agg(F.round(F.avg("f1"), 9).alias("mean_f1"))
    # One row per configuration is ranked.
    placed = means.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_f1").desc(), "model")))
    write_table(placed, f"{folder}/ranking")
    return read_ranked_results(spark, f"{folder}/results", f"{folder}/ranking", 2)


@query("best_results", "v_results", """
WITH means AS (SELECT model, ROUND(AVG(f1), 9) AS mean_f1 FROM v_results GROUP BY 1),
placed AS (SELECT *, ROW_NUMBER() OVER (ORDER BY mean_f1 DESC, model) AS rank FROM means)
SELECT p.rank, p.mean_f1, r.model, r.district, r.f1, r.csi FROM v_results r JOIN placed p USING (model) WHERE p.rank <= 2""")
def best_results(spark, d):
    """The two best configurations' results, found through the ranking; only their folders are read."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/results-{uuid.uuid4().hex}"
    return ranked_results(spark, d, folder).select("rank", "mean_f1", "model", "district", "f1", "csi")


@query("proportions", "v_results", """
SELECT model, district, """ + ", ".join(
    f"ROUND({c} / (hits + misses + false_alarms + corr_neg), 6) AS {c}" for c in S.CELLS) + " FROM v_results")
def proportions(spark, d):
    return S.add_rates(V.v_results(spark, d)).select("model", "district", *rounded(S.CELLS))


_WINDOWS, _AHEADS = [3, 5, 7], [1, 3, 5]


def window_scores(spark, d) -> DataFrame:
    """Score of the Q80 half-year threshold per nation for nine label windows."""
    series = V.v_nation_series(spark, d).join(V.v_nation_impact(spark, d), ["time", "district"], "left").withColumn(
        "flood", F.coalesce("flood", F.lit(0))
    )
    thresholds = block_quantiles(block_maxima(series, ["district"], "dis"), ["district"], [80])
    configs = [(w, n) for w in _WINDOWS for n in _AHEADS]
    days = horizon_labels(series, ["district"], "time", "dis", configs).join(thresholds, "district").withColumn(
        "predicted", (F.col("dis") >= F.col("thresholds")[0]).cast("int")
    )
    return S.daily_scores(days, ["window", "n_ahead", "district"])


def _window_scores_sql() -> str:
    parts = []
    for w in _WINDOWS:
        for n in _AHEADS:
            lead = f"LEAD(dis, {n - 1}) OVER (PARTITION BY district ORDER BY time)" if n > 1 else "dis"
            frame = f"(PARTITION BY district ORDER BY time ROWS BETWEEN {n} FOLLOWING AND {n + w - 1} FOLLOWING)"
            parts.append(f"""SELECT district, {w} AS "window", {n} AS n_ahead, dis, flood FROM (
  SELECT district, {lead} AS dis, CASE WHEN COUNT(flood) OVER {frame} >= {w} THEN MAX(flood) OVER {frame} END AS flood FROM ser)
  WHERE dis IS NOT NULL AND flood IS NOT NULL""")
    return f"""
WITH ser AS (SELECT s.district, s.time, s.dis, COALESCE(i.flood, 0) AS flood FROM v_nation_series s
  LEFT JOIN v_nation_impact i ON i.time = s.time AND i.district = s.district),
{_thresholds_sql('v_nation_series', 'district', 'dis', [80], 'thr')},
lab AS ({' UNION ALL '.join(parts)}),
ws AS (SELECT *, {SCORES_SQL} FROM (SELECT "window", n_ahead, district, {CELLS_SQL} FROM (
  SELECT l.*, CASE WHEN l.dis >= t.threshold THEN 1 ELSE 0 END AS predicted FROM lab l JOIN thr t ON t.district = l.district)
  GROUP BY ALL))"""


@query("score_matrix", "v_nation_series v_nation_impact", _window_scores_sql() + """
SELECT "window", """ + ", ".join(
    f"ROUND(AVG(csi) FILTER (WHERE n_ahead = {a}), 6) AS avg_{a}, ROUND(MEDIAN(csi) FILTER (WHERE n_ahead = {a}), 6) AS median_{a}"
    for a in _AHEADS) + ' FROM ws GROUP BY 1')
def score_matrix(spark, d):
    matrix = C.score_matrix(window_scores(spark, d), "csi", _AHEADS)
    return matrix.select("window", *rounded([f"{m}_{a}" for a in _AHEADS for m in ("avg", "median")]))


@query("score_bins", "v_results", """
SELECT CASE WHEN b = 11 THEN '55+' ELSE (b * 5) || '-' || (b * 5 + 4) END AS "interval", COUNT(r.district) AS n_districts, ROUND(AVG(f1), 12) AS avg_f1,
       ROUND(MEDIAN(f1), 12) AS med_f1
FROM RANGE(0, 12) t(b) LEFT JOIN (SELECT * FROM v_results WHERE model = 'Q80') r ON LEAST(r.n_floods // 5, 11) = b GROUP BY b""")
def score_bins(spark, d):
    binned = C.score_bins(V.v_results(spark, d).where(F.col("model") == "Q80"), "n_floods", "f1")
    return binned.select("interval", "n_districts", *rounded(["avg_f1", "med_f1"], 12))


@query("score_summary", "v_results", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", ROUND(AVG({c}), 12) AS mean, ROUND(MEDIAN({c}), 12) AS median FROM v_results" for c in SKILLS))
def score_summary(spark, d):
    return C.score_summary(V.v_results(spark, d), SKILLS).select(
        "column", *rounded(["mean", "median"], 12)
    )


@query("min_far_ties", "v_results", """
SELECT r.model, r.district, r.far, r.pod FROM v_results r
JOIN (SELECT district, MIN(far) AS m FROM v_results GROUP BY 1) g ON g.district = r.district AND r.far = g.m""")
def min_far_ties(spark, d):
    return C.group_minima(V.v_results(spark, d), ["district"], "far").select("model", "district", "far", "pod")


@query("scores_with_counts", "v_results v_nation_impact", """
SELECT r.model, r.district, r.f1, n.events FROM v_results r
JOIN (SELECT district, COUNT(*) AS events FROM v_nation_impact GROUP BY 1) n ON n.district = r.district""")
def scores_with_counts(spark, d):
    counts = V.v_nation_impact(spark, d).groupBy("district").agg(F.count(F.lit(1)).alias("events"))
    joined = V.v_results(spark, d).join(counts, "district")
    return joined.select("model", "district", "f1", "events").orderBy("events", "district", "model")


@query("common_districts", "v_results", """
SELECT r.district, r.f1 FROM v_results r WHERE r.model = 'Q80'
AND r.district IN (SELECT district FROM v_results WHERE model = 'Q95' AND f1 > 0)""")
def common_districts(spark, d):
    """Scores of one model for the districts another model also covers."""
    results = V.v_results(spark, d)
    keys = results.where((F.col("model") == "Q95") & (F.col("f1") > 0)).select("district")
    return results.where(F.col("model") == "Q80").join(keys, "district", "left_semi").select("district", "f1")


@query("valid_scores", "v_results", """
SELECT model, district, f1 AS score FROM v_results WHERE n_floods >= 5""")
def valid_scores(spark, d):
    """Scores stored as text with sentinels for districts that had too few events."""
    marked = V.v_results(spark, d).withColumn(
        "score", F.when(F.col("n_floods") < 3, "none").when(F.col("n_floods") < 5, "1000").otherwise(
            F.col("f1").cast("string"))
    )
    return R.valid_scores(marked, "score").select("model", "district", "score")


_CORR = """
c AS (SELECT district, fold, var, ROUND(ABS(CORR(x, flood)), 9) AS coef FROM (
  SELECT b.district, b.fold, b.flood, UNNEST(['dis', 'rain_max', 'soil1', 'soil2']) AS var,
         UNNEST([b.dis, r.rain_max, r.soil1, r.soil2]) AS x
  FROM (SELECT n.*, (DENSE_RANK() OVER (PARTITION BY n.district ORDER BY t.block) - 1) % 5 + 1 AS fold FROM num n
        JOIN trimmed t ON t.district = n.district AND n.rn BETWEEN t.lo AND t.hi) b
  JOIN v_rain r ON r.district = b.district AND r.time = b.time) GROUP BY 1, 2, 3)"""


@query("coef_rank", "v_days v_rain", _blocks_sql(None) + "," + _CORR + """,
r AS (SELECT *, RANK() OVER (PARTITION BY district, fold ORDER BY coef DESC)
        + (COUNT(*) OVER (PARTITION BY district, fold, coef) - 1) / 2.0 AS rank FROM c)
SELECT district, var, """ + ", ".join(f"MAX(rank) FILTER (WHERE fold = {k}) AS rank_{k}" for k in range(1, 6)) + """,
       SUM(rank) AS rank_sum FROM r GROUP BY 1, 2 HAVING COUNT(*) = 5""")
def coef_rank(spark, d):
    """Importance ranks over folds, for coefficients given as label correlations per fold."""
    folded = B.block_folds(B.event_blocks(district_days(spark, d), None))
    joined = folded.join(V.v_rain(spark, d), ["district", "time"])
    columns = ["dis", "rain_max", "soil1", "soil2"]
    coefs = joined.groupBy("district", "fold").agg(
        *[F.round(F.abs(correlation(F.col(c), F.col("flood"))), 9).alias(c) for c in columns]
    ).unpivot(["district", "fold"], columns, "var", "coef")
    ranks = C.average_rank(coefs, ["district", "fold"], F.col("coef"))
    return C.ranks_over_folds(ranks, ["district"], list(range(1, 6)))


# -- space --------------------------------------------------------------------------------------

def _nearest(axis: str) -> str:
    return f"""(SELECT s.station, (SELECT c.v FROM (SELECT DISTINCT {axis} AS v FROM v_grid) c
        ORDER BY ABS(c.v - s.{axis}), c.v DESC LIMIT 1) AS v FROM v_stations s)"""


@query("nearest_cell_series", "v_grid v_stations", f"""
SELECT a.station, g.time, g.dis24 AS dis FROM {_nearest('lat')} a JOIN {_nearest('lon')} b ON a.station = b.station
JOIN v_grid g ON g.lat = a.v AND g.lon = b.v""")
def nearest_cell_series(spark, d):
    return G.nearest_cell_series(V.v_grid(spark, d), V.v_stations(spark, d))


_ZONES = """
cz AS (SELECT lat, lon, zone FROM (SELECT c.lat, c.lon, e.zone, COUNT(*) AS k
  FROM (SELECT DISTINCT lat, lon FROM v_grid) c JOIN v_zone_edges e
  ON (e.y1 > c.lat) <> (e.y2 > c.lat) AND c.lon < (e.x2 - e.x1) * (c.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY 1, 2, 3)
  WHERE k % 2 = 1)"""


def _zones(spark, d) -> DataFrame:
    return G.cell_zones(V.v_grid(spark, d), V.v_zone_edges(spark, d))


@query("zonal_stats", "v_grid v_zone_edges", f"""
WITH {_ZONES}
SELECT z.zone, g.time, MAX(dis24) AS max, ROUND(AVG(dis24), 6) AS mean FROM v_grid g
JOIN cz z ON z.lat = g.lat AND z.lon = g.lon GROUP BY 1, 2""")
def zonal_stats(spark, d):
    stats = G.zonal_stats(V.v_grid(spark, d), _zones(spark, d))
    return stats.withColumn("mean", F.round("mean", 6))


@query("zonal_static", "v_grid v_zone_edges", f"""
WITH {_ZONES}
SELECT z.zone, ROUND(AVG(dis24), 6) AS mean, ROUND(MEDIAN(dis24), 6) AS median FROM v_grid g
JOIN cz z ON z.lat = g.lat AND z.lon = g.lon GROUP BY 1""")
def zonal_static(spark, d):
    return G.zonal_static(V.v_grid(spark, d), _zones(spark, d)).select("zone", *rounded(["mean", "median"]))


@query("zone_period_reduce", "v_grid v_zone_edges", f"""
WITH {_ZONES},
c AS (SELECT lat, lon, CAST(DATE_TRUNC('week', time) AS DATE) AS period, AVG(dis24) AS v FROM v_grid GROUP BY 1, 2, 3)
SELECT z.zone, c.period, ROUND(AVG(v), 6) AS mean, ROUND(MAX(v), 6) AS max FROM c JOIN cz z ON z.lat = c.lat AND z.lon = c.lon
GROUP BY 1, 2""")
def zone_period_reduce(spark, d):
    week = F.date_trunc("week", F.col("time")).cast("date")
    reduced = G.zone_period_reduce(V.v_grid(spark, d), _zones(spark, d), week, "mean", ["mean", "max"])
    return reduced.select("zone", "period", *rounded(["mean", "max"]))


@query("zone_period_sum", "v_grid v_zone_edges", f"""
WITH {_ZONES}
SELECT z.zone, CAST(DATE_TRUNC('month', g.time) AS DATE) AS period, ROUND(SUM(dis24), 2) AS sum FROM v_grid g
JOIN cz z ON z.lat = g.lat AND z.lon = g.lon GROUP BY 1, 2""")
def zone_period_sum(spark, d):
    month = F.trunc("time", "month")
    reduced = G.zone_period_reduce(V.v_grid(spark, d), _zones(spark, d), month, "sum", ["sum"])
    return reduced.select("zone", "period", F.round("sum", 2).alias("sum"))


def _intersects_sql(basins: str) -> str:
    """CTEs and a select of (hybas_id, zone) for polygons that share a point."""
    overlap = " AND ".join(
        f"LEAST(e.{c}1, e.{c}2) <= GREATEST(b.{c}1, b.{c}2) AND LEAST(b.{c}1, b.{c}2) <= GREATEST(e.{c}1, e.{c}2)" for c in "xy"
    )
    return f"""inside AS (SELECT b.hybas_id, e.zone FROM {basins} b JOIN v_zone_edges e
  ON (e.y1 > b.y1) <> (e.y2 > b.y1) AND b.x1 < (e.x2 - e.x1) * (b.y1 - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY b.hybas_id, b.x1, b.y1, e.zone HAVING COUNT(*) % 2 = 1),
corner AS (SELECT b.hybas_id, e.zone FROM v_zone_edges e JOIN {basins} b
  ON (b.y1 > e.y1) <> (b.y2 > e.y1) AND e.x1 < (b.x2 - b.x1) * (e.y1 - b.y1) / (b.y2 - b.y1) + b.x1
  GROUP BY b.hybas_id, e.x1, e.y1, e.zone HAVING COUNT(*) % 2 = 1),
crossing AS (SELECT b.hybas_id, e.zone FROM {basins} b JOIN v_zone_edges e ON {overlap} AND
  ((e.x2-e.x1)*(b.y1-e.y1) - (e.y2-e.y1)*(b.x1-e.x1)) * ((e.x2-e.x1)*(b.y2-e.y1) - (e.y2-e.y1)*(b.x2-e.x1)) <= 0 AND
  ((b.x2-b.x1)*(e.y1-b.y1) - (b.y2-b.y1)*(e.x1-b.x1)) * ((b.x2-b.x1)*(e.y2-b.y1) - (b.y2-b.y1)*(e.x2-b.x1)) <= 0),
meets AS (SELECT DISTINCT hybas_id, zone FROM (SELECT * FROM inside UNION ALL SELECT * FROM corner UNION ALL SELECT * FROM crossing))"""


@query("basin_intersects", "v_basin_edges v_zone_edges", f"WITH {_intersects_sql('v_basin_edges')} SELECT hybas_id, zone FROM meets")
def basin_intersects(spark, d):
    basins = V.v_basin_edges(spark, d).drop("brand")
    return G.polygon_intersects(basins, "hybas_id", V.v_zone_edges(spark, d), "zone")


@query("upstream_closure", "v_basin v_seeds", """
WITH RECURSIVE_ up AS (SELECT zone, hybas_id FROM v_seeds
  UNION SELECT u.zone, b.hybas_id FROM up u JOIN v_basin b ON b.next_down = u.hybas_id AND b.up_area <= 25000)
SELECT zone, hybas_id FROM up""")
def upstream_closure(spark, d):
    return G.upstream_closure(V.v_basin(spark, d), V.v_seeds(spark, d))


@query("catchments", "v_basin v_basin_edges v_zone_edges", f"""
WITH RECURSIVE_ dry AS (SELECT * FROM v_basin WHERE hybas_id % 7 <> 0),
edges AS (SELECT e.* FROM v_basin_edges e JOIN dry USING (hybas_id)),
{_intersects_sql("edges")},
up AS (SELECT zone, hybas_id FROM meets
  UNION SELECT u.zone, b.hybas_id FROM up u JOIN dry b ON b.next_down = u.hybas_id AND b.up_area <= 25000),
sides AS (SELECT u.zone, LEAST({{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}) AS a, GREATEST({{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}) AS b
  FROM up u JOIN edges e ON e.hybas_id = u.hybas_id)
SELECT zone, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM sides GROUP BY zone, a, b HAVING COUNT(*) = 1""")
def catchments(spark, d):
    """Zones to basins without lakes, upstream, then dissolved."""
    basins = V.v_basin(spark, d).withColumn("lake", (F.col("hybas_id") % 7 == 0).cast("int"))
    return G.catchments(basins, V.v_basin_edges(spark, d).drop("brand"), V.v_zone_edges(spark, d))


@query("dissolve_boundary", "v_basin_edges", """
SELECT zone, x1, y1, x2, y2 FROM (
  SELECT brand AS zone,
    CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN x1 ELSE x2 END AS x1,
    CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN y1 ELSE y2 END AS y1,
    CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN x2 ELSE x1 END AS x2,
    CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN y2 ELSE y1 END AS y2
  FROM v_basin_edges) GROUP BY ALL HAVING COUNT(*) = 1""")
def dissolve_boundary(spark, d):
    edges = V.v_basin_edges(spark, d)
    members = V.v_basin_edges(spark, d).select("hybas_id", F.col("brand").alias("zone")).distinct()
    return G.dissolve_boundary(edges.drop("brand"), members, "hybas_id", "zone")


@query("boundary_rings", "v_basin_edges", """
WITH RECURSIVE_ sides AS (SELECT hybas_id, SUM(x1 * y2 - x2 * y1) < 0 AS turned FROM v_basin_edges GROUP BY 1),
directed AS (SELECT brand AS zone, CASE WHEN turned THEN x2 ELSE x1 END AS x1, CASE WHEN turned THEN y2 ELSE y1 END AS y1,
  CASE WHEN turned THEN x1 ELSE x2 END AS x2, CASE WHEN turned THEN y1 ELSE y2 END AS y2 FROM v_basin_edges JOIN sides USING (hybas_id)),
once AS (SELECT zone, x1, y1, x2, y2, COUNT(*) OVER (PARTITION BY zone, LEAST({'x': x1, 'y': y1}, {'x': x2, 'y': y2}),
  GREATEST({'x': x1, 'y': y1}, {'x': x2, 'y': y2})) AS k FROM directed),
e AS MATERIALIZED (SELECT zone, x1, y1, x2, y2, ROW_NUMBER() OVER (ORDER BY zone, x1, y1, x2, y2) AS id FROM once WHERE k = 1),
turns AS (SELECT i.id, o.id AS following, ATAN2(i.y1 - i.y2, i.x1 - i.x2) - ATAN2(o.y2 - o.y1, o.x2 - o.x1) AS t
  FROM e i JOIN e o ON o.zone = i.zone AND o.x1 = i.x2 AND o.y1 = i.y2),
succ AS MATERIALIZED (SELECT id, ARG_MIN(following, CASE WHEN t <= 0 THEN t + 2 * PI() ELSE t END) AS following FROM turns GROUP BY 1),
walk AS (SELECT id AS head, id AS cur, 0 AS k FROM e
  UNION ALL SELECT w.head, s.following, w.k + 1 FROM walk w JOIN succ s ON s.id = w.cur WHERE s.following > w.head),
ends AS (SELECT head FROM walk w JOIN succ s ON s.id = w.cur WHERE s.following = w.head)
SELECT h.zone, h.x1 AS x, h.y1 AS y, COUNT(*) AS n_vertices, ROUND(SUM(e.x1 * e.y2 - e.x2 * e.y1) / 2, 6) AS area,
  SUM(e.x1 * e.y2 - e.x2 * e.y1) > 0 AS "outer", ROUND(SUM(w.k * e.x1), 6) AS path_x, ROUND(SUM(w.k * e.y1), 6) AS path_y
FROM walk w JOIN ends USING (head) JOIN e ON e.id = w.cur JOIN e h ON h.id = w.head GROUP BY w.head, h.zone, h.x1, h.y1""")
def boundary_rings(spark, d):
    """Outlines and holes of the dissolved zones as ordered rings; the paths weigh vertices by their place."""
    edges = V.v_basin_edges(spark, d)
    members = edges.select("hybas_id", F.col("brand").alias("zone")).distinct()
    found = G.rings(G.directed_boundary(edges.drop("brand"), members, "hybas_id", "zone"), "zone")

    def path(c: str):
        placed = F.transform("vertices", lambda v, k: k * v[c])
        return F.round(F.aggregate(placed, F.lit(0.0), lambda s, x: s + x), 6)

    return found.where("closed").select("zone", "x", "y", "n_vertices", F.round("area", 6).alias("area"), "outer", path("x").alias("path_x"), path("y").alias("path_y"))


@query("station_points", "v_stations", """
SELECT s.station, s.lon, s.lat FROM v_stations s
WHERE s.station IN (SELECT l_suppkey FROM lineitem)""")
def station_points(spark, d):
    panel = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("station"))
    return G.station_points(V.v_stations(spark, d), panel).select("station", "point.lon", "point.lat")


@query("polygon_attributes", "v_basin_edges v_basin", """
SELECT e.hybas_id, e.x1, e.y1, e.x2, e.y2, b.up_area FROM v_basin_edges e
LEFT JOIN (SELECT * FROM v_basin WHERE up_area <= 25000) b ON b.hybas_id = e.hybas_id""")
def polygon_attributes(spark, d):
    """Polygon edges with the attributes of small basins; other polygons stay without."""
    small = V.v_basin(spark, d).where(F.col("up_area") <= 25000).select("hybas_id", "up_area")
    return V.v_basin_edges(spark, d).drop("brand").join(small, "hybas_id", "left")

"""The model tables (series, impact, rain, grid, ...) derived from the star-schema tables.

Every view exists twice: as a DataFrame function and as SQL text for the oracle. Event
days are defined by quantiles of each district's own records, so events stay rare at
any scale without dropping rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from freshet.operators.resample import block_quantiles
from freshet.operators.sweep import sweep_scores
from freshet.sources.tables import read_table

# Share of a district's days that do not count as an event.
IMPACT_QUANTILE = 0.98


def _day(column: str):
    return F.col(column).cast("date")


def supplier_district(spark: SparkSession, d: str) -> DataFrame:
    """District of every supplier, hashed part by part where it is joined.

    Spark guesses the size of a join by the product of its sides, so that beside this one it would broadcast lineitem.
    """
    nation = read_table(spark, d, "nation").join(
        read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return read_table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "n_name", "r_name"
    ).hint("shuffle_hash")


def customer_district(spark: SparkSession, d: str) -> DataFrame:
    """District of every customer; beside it Spark would broadcast orders."""
    nation = read_table(spark, d, "nation").join(
        read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return read_table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_name", "r_name"
    ).hint("shuffle_hash")


def v_series(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem")
    return (
        lines.join(supplier_district(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("r_name").alias("district"), F.col("l_returnflag").alias("station"),
                 _day("l_shipdate").alias("time"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("dis"))
    )


def v_nation_series(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem")
    return (
        lines.join(supplier_district(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("n_name").alias("district"), _day("l_shipdate").alias("time"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("dis"))
    )


def v_calendar(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(_day("l_shipdate").alias("time")).distinct()


def v_daily_gap(spark: SparkSession, d: str) -> DataFrame:
    """Every series on every calendar day; the calendar is one array of days."""
    series = v_series(spark, d)
    days = v_calendar(spark, d).agg(F.collect_list("time")).scalar()
    spine = series.select("district", "station").distinct().withColumn("time", F.explode(days))
    return spine.join(series, ["district", "station", "time"], "left")


def v_daily(spark: SparkSession, d: str) -> DataFrame:
    return v_daily_gap(spark, d).withColumn("dis", F.coalesce("dis", F.lit(0.0)))


def _impact(spark: SparkSession, d: str, level: str) -> DataFrame:
    """Days on which the quantity of all lines is extreme for the district."""
    lines = read_table(spark, d, "lineitem")
    daily = (
        lines.join(supplier_district(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(_day("l_shipdate").alias("time"), F.col(level).alias("district"))
        .agg(F.sum("l_quantity").alias("loss"))
    )
    cut = daily.groupBy("district").agg(
        F.round(F.percentile("loss", F.lit(IMPACT_QUANTILE)), 6).alias("cut")
    )
    return daily.join(cut, "district").where(F.col("loss") >= F.col("cut")).select(
        "time", "district", F.lit(1).alias("flood")
    )


def v_impact(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, "r_name")


def v_nation_impact(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, "n_name")


def v_rain(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem")
    return (
        lines.join(supplier_district(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("r_name").alias("district"), _day("l_shipdate").alias("time"))
        .agg(
            F.max("l_quantity").alias("rain_max"),
            F.round(F.avg("l_quantity"), 9).alias("rain_mean"),
            F.round(F.avg("l_discount"), 9).alias("soil1"),
            F.round(F.avg("l_tax"), 9).alias("soil2"),
            F.max("l_discount").alias("soil3"),
            F.max("l_tax").alias("soil4"),
        )
    )


def v_days(spark: SparkSession, d: str) -> DataFrame:
    """Complete daily series with the event flag."""
    return v_daily(spark, d).join(v_impact(spark, d), ["time", "district"], "left").withColumn(
        "flood", F.coalesce("flood", F.lit(0))
    )


def v_neigh(spark: SparkSession, d: str) -> DataFrame:
    """Nations whose keys are consecutive within a region share a border."""
    nation = read_table(spark, d, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    beside = nation.select(
        F.col("n_name").alias("district"), F.array(F.lag("n_name").over(w), F.lead("n_name").over(w)).alias("_b")
    )
    sides = beside.select("district", F.explode("_b").alias("neighbour"))
    return sides.where(F.col("neighbour").isNotNull())


def v_basin(spark: SparkSession, d: str) -> DataFrame:
    """Binary drainage tree over the parts; each brand's smallest part is an outlet."""
    return read_table(spark, d, "part").select(
        F.col("p_partkey").alias("hybas_id"),
        F.floor(F.col("p_partkey") / 2).alias("next_down"),
        (F.col("p_size") * 1000).alias("up_area"),
    )


def v_seeds(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").groupBy(F.col("p_brand").alias("zone")).agg(
        F.min("p_partkey").alias("hybas_id")
    )


def v_basin_edges(spark: SparkSession, d: str) -> DataFrame:
    """Unit squares on a 40-wide lattice, one per part, as four directed edges.

    Squares of one row touch; centres are shifted by 0.25 so no vertex meets a zone edge.
    """
    x = (F.col("p_partkey") % 40) * 0.25 + 0.13
    y = F.floor(F.col("p_partkey") / 40) * 0.25 + 0.17
    square = read_table(spark, d, "part").select(
        F.col("p_partkey").alias("hybas_id"), F.col("p_brand").alias("brand"),
        x.alias("a"), y.alias("b"),
        ((F.col("p_partkey") % 40 + 1) * 0.25 + 0.13).alias("c"),
        ((F.floor(F.col("p_partkey") / 40) + 1) * 0.25 + 0.17).alias("e"),
    )
    corners = [("a", "b", "c", "b"), ("c", "b", "c", "e"), ("c", "e", "a", "e"), ("a", "e", "a", "b")]
    sides = F.array(*[
        F.struct(F.col(p).alias("x1"), F.col(q).alias("y1"), F.col(r).alias("x2"), F.col(s).alias("y2"))
        for p, q, r, s in corners
    ])
    return square.select("hybas_id", "brand", F.explode(sides).alias("s")).select("hybas_id", "brand", "s.*")


def v_grid(spark: SparkSession, d: str) -> DataFrame:
    return (
        read_table(spark, d, "events")
        .groupBy(
            (F.col("user_id") % 15).cast("double").alias("lat"),
            F.floor(F.col("user_id") / 15).cast("double").alias("lon"),
            _day("ts").alias("time"),
        )
        .agg(F.round(F.sum("value"), 2).alias("dis24"))
    )


def v_stations(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("station"),
        ((F.col("s_suppkey") * 37) % 1000 / 100.0).alias("lon"),
        ((F.col("s_suppkey") * 61) % 1500 / 100.0).alias("lat"),
    )


# A triangle, a rectangle and two far boxes that are one zone; no edge touches a grid point.
ZONE_EDGES = [
    ("Z1", 0.5, 0.5, 8.4, 0.6), ("Z1", 8.4, 0.6, 4.3, 13.7), ("Z1", 4.3, 13.7, 0.5, 0.5),
    ("Z2", 5.5, 7.5, 9.5, 7.5), ("Z2", 9.5, 7.5, 9.5, 14.5),
    ("Z2", 9.5, 14.5, 5.5, 14.5), ("Z2", 5.5, 14.5, 5.5, 7.5),
    ("Z3", 0.2, -5.2, 0.4, -5.2), ("Z3", 0.4, -5.2, 0.4, -5.1), ("Z3", 0.4, -5.1, 0.2, -5.1), ("Z3", 0.2, -5.1, 0.2, -5.2),
    ("Z3", 2.65, 0.45, 2.7, 0.45), ("Z3", 2.7, 0.45, 2.7, 0.55), ("Z3", 2.7, 0.55, 2.65, 0.55), ("Z3", 2.65, 0.55, 2.65, 0.45),
]


def v_zone_edges(spark: SparkSession, d: str | None = None) -> DataFrame:
    return spark.createDataFrame(ZONE_EDGES, "zone string, x1 double, y1 double, x2 double, y2 double")


# Threshold models compared per nation, in the order that wins ties.
MODEL_PERCENTS = [50, 70, 80, 90, 95]
MODELS = [f"Q{p}" for p in MODEL_PERCENTS]


def v_results(spark: SparkSession, d: str) -> DataFrame:
    """Daily scores per nation of five models: discharge above a quantile of the nation's days."""
    series = v_nation_series(spark, d).join(v_nation_impact(spark, d), ["time", "district"], "left").withColumn(
        "flood", F.coalesce("flood", F.lit(0))
    )
    daily = series.select("district", F.col("dis").alias("block_max"))
    thresholds = block_quantiles(daily, ["district"], MODEL_PERCENTS)
    scores = sweep_scores(series, thresholds, ["district"], "dis", MODEL_PERCENTS)
    return scores.select(
        F.concat(F.lit("Q"), F.col("percent").cast("string")).alias("model"), "district",
        "hits", "misses", "false_alarms", "corr_neg",
        *[F.round(c, 6).alias(c) for c in ("f1", "pod", "far", "pofd", "csi")],
        (F.col("hits") + F.col("misses")).alias("n_floods"),
    )


_SCORES_SQL = """
CASE WHEN 2*hits+false_alarms+misses = 0 THEN 0.0 ELSE 2.0*hits/(2*hits+false_alarms+misses) END AS f1,
hits / CASE WHEN hits+misses = 0 THEN 0.0001 ELSE hits+misses END AS pod,
false_alarms / CASE WHEN hits+false_alarms = 0 THEN 0.0001 ELSE hits+false_alarms END AS far,
false_alarms / CASE WHEN false_alarms+corr_neg = 0 THEN 0.0001 ELSE false_alarms+corr_neg END AS pofd,
hits / CASE WHEN hits+false_alarms+misses = 0 THEN 0.0001 ELSE hits+false_alarms+misses END AS csi
"""

_EVENT_SCORES_SQL = """
hits / NULLIF(hits+misses, 0) AS pod,
false_alarms / NULLIF(hits+false_alarms, 0) AS far,
false_alarms / NULLIF(false_alarms+hits+misses, 0) AS pofd,
hits / NULLIF(hits+false_alarms+misses, 0) AS csi
"""

_CELLS_SQL = """
COUNT(*) FILTER (WHERE flood = 1 AND predicted = 1) AS hits,
COUNT(*) FILTER (WHERE flood = 1 AND predicted = 0) AS misses,
COUNT(*) FILTER (WHERE flood = 0 AND predicted = 1) AS false_alarms,
COUNT(*) FILTER (WHERE flood = 0 AND predicted = 0) AS corr_neg
"""


_LINES = """lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""


def _impact_sql(level: str) -> str:
    daily = f"""SELECT CAST(l_shipdate AS DATE) AS time, {level} AS district, SUM(l_quantity) AS loss
      FROM {_LINES} GROUP BY 1, 2"""
    return f"""
SELECT d.time, d.district, 1 AS flood FROM ({daily}) d
JOIN (SELECT district, ROUND(QUANTILE_CONT(loss, {IMPACT_QUANTILE}), 6) AS cut FROM ({daily}) GROUP BY district) t
ON d.district = t.district WHERE d.loss >= t.cut"""


_VIEWS: dict[str, tuple[list[str], str]] = {
    "v_series": ([], f"""
SELECT r_name AS district, l_returnflag AS station, CAST(l_shipdate AS DATE) AS time,
       ROUND(SUM(l_extendedprice), 2) AS dis FROM {_LINES} GROUP BY 1, 2, 3"""),
    "v_nation_series": ([], f"""
SELECT n_name AS district, CAST(l_shipdate AS DATE) AS time, ROUND(SUM(l_extendedprice), 2) AS dis
FROM {_LINES} GROUP BY 1, 2"""),
    "v_calendar": ([], "SELECT DISTINCT CAST(l_shipdate AS DATE) AS time FROM lineitem"),
    "v_daily_gap": (["v_series", "v_calendar"], """
SELECT k.district, k.station, c.time, s.dis
FROM (SELECT DISTINCT district, station FROM v_series) k CROSS JOIN v_calendar c
LEFT JOIN v_series s ON s.district = k.district AND s.station = k.station AND s.time = c.time"""),
    "v_daily": (["v_daily_gap"], "SELECT district, station, time, COALESCE(dis, 0.0) AS dis FROM v_daily_gap"),
    "v_impact": ([], _impact_sql("r_name")),
    "v_nation_impact": ([], _impact_sql("n_name")),
    "v_rain": ([], f"""
SELECT r_name AS district, CAST(l_shipdate AS DATE) AS time, MAX(l_quantity) AS rain_max,
       ROUND(AVG(l_quantity), 9) AS rain_mean, ROUND(AVG(l_discount), 9) AS soil1, ROUND(AVG(l_tax), 9) AS soil2,
       MAX(l_discount) AS soil3, MAX(l_tax) AS soil4 FROM {_LINES} GROUP BY 1, 2"""),
    "v_days": (["v_daily", "v_impact"], """
SELECT d.*, COALESCE(i.flood, 0) AS flood FROM v_daily d
LEFT JOIN v_impact i ON i.time = d.time AND i.district = d.district"""),
    "v_neigh": ([], """
SELECT district, neighbour FROM (
  SELECT n_name AS district, LAG(n_name) OVER w AS neighbour FROM nation
  WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)
  UNION ALL SELECT n_name, LEAD(n_name) OVER w FROM nation
  WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) WHERE neighbour IS NOT NULL"""),
    "v_basin": ([], """
SELECT p_partkey AS hybas_id, CAST(FLOOR(p_partkey / 2) AS BIGINT) AS next_down, p_size * 1000 AS up_area
FROM part"""),
    "v_seeds": ([], "SELECT p_brand AS zone, MIN(p_partkey) AS hybas_id FROM part GROUP BY 1"),
    "v_basin_edges": ([], """
SELECT hybas_id, brand, unnest([{'x1': a, 'y1': b, 'x2': c, 'y2': b}, {'x1': c, 'y1': b, 'x2': c, 'y2': e},
  {'x1': c, 'y1': e, 'x2': a, 'y2': e}, {'x1': a, 'y1': e, 'x2': a, 'y2': b}], recursive := true)
FROM (SELECT p_partkey AS hybas_id, p_brand AS brand, (p_partkey % 40) * 0.25E0 + 0.13E0 AS a,
  FLOOR(p_partkey / 40) * 0.25E0 + 0.17E0 AS b, (p_partkey % 40 + 1) * 0.25E0 + 0.13E0 AS c,
  (FLOOR(p_partkey / 40) + 1) * 0.25E0 + 0.17E0 AS e FROM part)"""),
    "v_grid": ([], """
SELECT CAST(user_id % 15 AS DOUBLE) AS lat, CAST(FLOOR(user_id / 15) AS DOUBLE) AS lon, CAST(ts AS DATE) AS time,
       ROUND(SUM(value), 2) AS dis24 FROM events GROUP BY 1, 2, 3"""),
    "v_stations": ([], """
SELECT s_suppkey AS station, CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 100.0E0 AS lon,
       CAST((s_suppkey * 61) % 1500 AS DOUBLE) / 100.0E0 AS lat FROM supplier"""),
    "v_zone_edges": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"('{z}', " + ", ".join(f"{v}E0" for v in rest) + ")" for z, *rest in ZONE_EDGES
    ) + ") AS t(zone, x1, y1, x2, y2)"),
    "v_results": (["v_nation_series", "v_nation_impact"], f"""
SELECT model, district, hits, misses, false_alarms, corr_neg, ROUND(f1, 6) AS f1, ROUND(pod, 6) AS pod,
       ROUND(far, 6) AS far, ROUND(pofd, 6) AS pofd, ROUND(csi, 6) AS csi, hits + misses AS n_floods
FROM (SELECT *, {_SCORES_SQL} FROM (
  SELECT 'Q' || q AS model, s.district, {_CELLS_SQL}
  FROM (SELECT s.district, s.time, t.q, COALESCE(i.flood, 0) AS flood,
               CASE WHEN s.dis >= t.cut THEN 1 ELSE 0 END AS predicted
        FROM v_nation_series s
        JOIN (SELECT district, UNNEST({MODEL_PERCENTS}) AS q, ROUND(UNNEST(cuts), 6) AS cut FROM (
              SELECT district, QUANTILE_CONT(dis, {[p / 100 for p in MODEL_PERCENTS]}) AS cuts FROM v_nation_series
              GROUP BY district)) t ON t.district = s.district
        LEFT JOIN v_nation_impact i ON i.time = s.time AND i.district = s.district) s
  GROUP BY 1, 2))"""),
}


def view_sql(names: list[str], select: str) -> str:
    """`select` with the named views, and the views they need, as common table expressions."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for dependency in _VIEWS[name][0]:
            add(dependency)
        done.append(name)

    for name in names:
        add(name)
    recursive = "RECURSIVE " if "RECURSIVE_" in select else ""
    # Several parts of a statement read a view; each is computed once.
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({_VIEWS[n][1]})" for n in done)
    body = select.replace("RECURSIVE_", "").strip()
    joiner = ",\n" if body.upper().startswith("WITH ") else "\n"
    if body.upper().startswith("WITH "):
        body = body[5:]
    if not ctes:
        return f"WITH {recursive}{body}" if joiner == ",\n" else body
    return f"WITH {recursive}{ctes}{joiner}{body}"


SCORES_SQL, EVENT_SCORES_SQL, CELLS_SQL = _SCORES_SQL, _EVENT_SCORES_SQL, _CELLS_SQL

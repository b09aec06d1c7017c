"""Queries over scans, reshaping and the panel joins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from freshet.functions.expressions import fold_accents, relative_change, season_of
from freshet.operators import panel as P, reshape as R
from freshet.operators.compare import group_minima
from freshet.plans.registry import query
from freshet.plans import views as V
from freshet.schemas import variable_columns
from freshet.sources.tables import archive_period, read_table, union_all, union_countries


@query("scan_prune_filter", sql="""
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS time, CAST(l_quantity AS BIGINT) AS quantity,
       l_extendedprice AS price, l_returnflag AS station
FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2019-12-01'
  AND l_returnflag <> 'N' AND l_linestatus = 'F' AND l_quantity >= 10""")
def scan_prune_filter(spark, d):
    lines = read_table(spark, d, "lineitem").where(
        (F.col("l_returnflag") != "N") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 10)
    )
    # The timestamp bounds reach the parquet scan; the closed date range then holds exactly.
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("2000-01-01", "2019-12-02"))
    lines = lines.where((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < end))
    dated = lines.withColumn("time", F.col("l_shipdate").cast("date"))
    return archive_period(dated).select(
        "l_orderkey", "l_linenumber", "time", F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("station"),
    )


@query("scan_events", sql="""
SELECT event_id, CAST(ts AS DATE) AS time, value, value / 1000000 AS value_km2 FROM events
WHERE event_type <> 'signup' AND value >= 50""")
def scan_events(spark, d):
    events = read_table(spark, d, "events").where((F.col("event_type") != "signup") & (F.col("value") >= 50))
    return events.select(
        "event_id", F.col("ts").cast("date").alias("time"), "value", (F.col("value") / 1000000).alias("value_km2")
    )


@query("columns_by_pattern", sql="""
SELECT l_orderkey, l_linenumber, l_shipdate, l_tax, l_quantity, l_extendedprice, l_discount FROM lineitem""")
def columns_by_pattern(spark, d):
    """Key and date columns by name pattern, then the double columns with the last one first."""
    lines = R.drop_like(read_table(spark, d, "lineitem"), "partkey|suppkey|flag|status")
    return lines.select(*R.columns_like(lines, "orderkey|linenumber|shipdate"), *R.double_columns(lines, True))


@query("union_country", "v_series", """
SELECT district, station, time, dis, CASE WHEN district IN ('AFRICA', 'ASIA') THEN 'Kenya' ELSE 'Uganda' END AS "Country"
FROM v_series""")
def union_country(spark, d):
    series = V.v_series(spark, d)
    east = F.col("district").isin("AFRICA", "ASIA")
    return union_countries({"Kenya": series.where(east), "Uganda": series.where(~east)})


@query("batch_union", sql="""
SELECT CAST(l_shipdate AS DATE) AS time, l_quantity, NULL::DOUBLE AS l_tax FROM lineitem WHERE YEAR(l_shipdate) < 1997
UNION ALL SELECT CAST(l_shipdate AS DATE), l_quantity, l_tax FROM lineitem
WHERE YEAR(l_shipdate) BETWEEN 1997 AND 1999
UNION ALL SELECT CAST(l_shipdate AS DATE), l_quantity, l_tax FROM lineitem WHERE YEAR(l_shipdate) > 1999""")
def batch_union(spark, d):
    """Yearly batches whose first part lacks a column."""
    lines = read_table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("time"), "l_quantity", "l_tax"
    )
    year = F.year("time")
    return union_all([
        lines.where(year < 1997).drop("l_tax"), lines.where(year.between(1997, 1999)), lines.where(year > 1999)
    ]).select("time", "l_quantity", "l_tax")


@query("link_unpivot", sql="""
WITH w AS (SELECT LOWER(s_name) AS name, MIN(p_brand) AS st1, MAX(p_brand) AS st2,
                  MIN(p_type) FILTER (WHERE p_size > 49) AS st3
           FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT name AS district, st1 AS station FROM w WHERE st1 IS NOT NULL
UNION ALL SELECT name, st2 FROM w WHERE st2 IS NOT NULL
UNION ALL SELECT name, st3 FROM w WHERE st3 IS NOT NULL""")
def link_unpivot(spark, d):
    """A wide link table (some links empty) to one row per link."""
    lines = read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    supplier = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    part = read_table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    wide = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey")
        .agg(F.min("p_brand").alias("st1"), F.max("p_brand").alias("st2"),
             F.min(F.when(F.col("p_size") > 49, F.col("p_type"))).alias("st3"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return R.links_long(wide, "s_name", ["st1", "st2", "st3"])


@query("series_melt", "v_daily", """
SELECT time, 'dis_A' AS "Stations", SUM(dis) FILTER (WHERE station = 'A') AS dis FROM v_daily GROUP BY time
UNION ALL SELECT time, 'dis_N', SUM(dis) FILTER (WHERE station = 'N') FROM v_daily GROUP BY time
UNION ALL SELECT time, 'dis_R', SUM(dis) FILTER (WHERE station = 'R') FROM v_daily GROUP BY time""")
def series_melt(spark, d):
    wide = V.v_daily(spark, d).groupBy("time").agg(*[
        F.round(F.sum(F.when(F.col("station") == s, F.col("dis"))), 2).alias(f"dis_{s}") for s in "ANR"
    ])
    return R.series_long(wide, "time", ["dis_A", "dis_N", "dis_R"])


@query("panel_build", "v_series v_impact v_rain", """
SELECT s.time, s.district, s.station, s.dis, COALESCE(i.flood, 0) AS flood, r.rain_max, r.rain_mean, r.soil1, r.soil2,
       r.soil3, r.soil4, s.station || s.district AS station_dis,
       CASE WHEN s.district IN ('AFRICA', 'ASIA') THEN 'Kenya' ELSE 'Uganda' END AS "Country",
       CASE WHEN MONTH(s.time) IN (6,7,8) THEN 'summer' WHEN MONTH(s.time) IN (9,10,11) THEN 'fall'
            WHEN MONTH(s.time) IN (12,1,2) THEN 'winter' ELSE 'spring' END AS season
FROM v_series s LEFT JOIN v_impact i ON i.time = s.time AND i.district = s.district
LEFT JOIN v_rain r ON r.time = s.time AND r.district = s.district
WHERE s.district IN (SELECT district FROM v_impact)""")
def panel_build(spark, d):
    country = F.when(F.col("district").isin("AFRICA", "ASIA"), "Kenya").otherwise("Uganda")
    return P.build_panel(V.v_series(spark, d), None, V.v_impact(spark, d), V.v_rain(spark, d), None, country)


@query("panel_links", "v_nation_series v_neigh v_nation_impact", """
WITH l AS (SELECT s.district AS station, s.time, s.dis, k.neighbour AS district
           FROM v_nation_series s JOIN v_neigh k ON k.district = s.district)
SELECT l.station, l.time, l.dis, l.district, COALESCE(i.flood, 0) AS flood FROM l
LEFT JOIN v_nation_impact i ON i.time = l.time AND i.district = l.district""")
def panel_links(spark, d):
    """Discharge of every station linked to a district, with the district's events."""
    discharge = V.v_nation_series(spark, d).withColumnRenamed("district", "station")
    links = V.v_neigh(spark, d).select(F.col("district").alias("station"), F.col("neighbour").alias("district"))
    return P.attach_impact(P.link_discharge(discharge, links), V.v_nation_impact(spark, d))


@query("panel_clip_to_events", "v_series v_impact", """
SELECT s.district, s.station, s.time, s.dis FROM v_series s
WHERE s.time > (SELECT MIN(time) - INTERVAL 7 DAY FROM v_impact)
  AND s.time < (SELECT MAX(time) + INTERVAL 7 DAY FROM v_impact)""")
def panel_clip_to_events(spark, d):
    return P.clip_to_events(V.v_series(spark, d), V.v_impact(spark, d))


@query("date_slice", "v_series", """
SELECT district, station, time, dis FROM v_series
WHERE time BETWEEN DATE '1996-05-01' AND DATE '2000-11-15' AND district <> 'EUROPE'""")
def date_slice(spark, d):
    return archive_period(V.v_series(spark, d), start="1996-05-01", end="2000-11-15").where(
        F.col("district") != "EUROPE"
    )


@query("panel_completeness", "v_series", """
SELECT district, station, COUNT(*) AS n_rows,
       (SELECT DATE_DIFF('day', MIN(time), MAX(time)) + 1 FROM v_series) AS n_days
FROM v_series GROUP BY 1, 2
HAVING COUNT(*) <> (SELECT DATE_DIFF('day', MIN(time), MAX(time)) + 1 FROM v_series)""")
def panel_completeness(spark, d):
    return P.completeness(V.v_series(spark, d), ["district", "station"])


@query("active_districts", "v_nation_series v_nation_impact", """
WITH hits AS MATERIALIZED (SELECT DISTINCT district, time FROM v_nation_impact),
active AS MATERIALIZED (SELECT DISTINCT s.district FROM v_nation_series s JOIN hits USING (district, time))
SELECT s.district, s.time, s.dis FROM v_nation_series s JOIN active USING (district)""")
def active_districts(spark, d):
    """Districts whose event total over the observed days is not zero."""
    panel = P.attach_impact(V.v_nation_series(spark, d), V.v_nation_impact(spark, d))
    return P.drop_quiet_districts(panel).select("district", "time", "dis")


@query("station_pivot", "v_series", """
SELECT district, time,
  MAX(dis) FILTER (WHERE n = 1) AS dis_station1, MAX(dis) FILTER (WHERE n = 2) AS dis_station2,
  MAX(dis) FILTER (WHERE n = 3) AS dis_station3
FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY district ORDER BY station) AS n FROM v_series) GROUP BY 1, 2""")
def station_pivot(spark, d):
    return R.stations_wide(V.v_series(spark, d), {"dis": "dis_station"})


@query("event_quality_filter", sql="""
SELECT DISTINCT CAST(o_orderdate AS DATE) AS time, LOWER(o_orderstatus) AS district, 1 AS flood,
       o_totalprice, (o_totalprice - 250000) / 250000 * 100 AS change
FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01'
  AND (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 6 - CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) > 3
       ELSE CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) - 3 > 0 END)""")
def event_quality_filter(spark, d):
    """Text dates parsed per country, start cut-off, quality per country, rows de-duplicated."""
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    orders = read_table(spark, d, "orders")
    uga = orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), "o_orderstatus", "o_totalprice",
        (6 - digit).alias("score"),
    )
    ken = orders.where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date"), "o_orderstatus", "o_totalprice",
        (digit - 3).alias("score"),
    )
    kept = union_all([
        R.quality_events(uga, "uga", "score").withColumn("time", F.to_date("Date", "dd/MM/yyyy")),
        R.quality_events(ken, "ken", "score").withColumn("time", F.to_date("Date", "MM/dd/yyyy")),
    ]).where(F.col("time") >= F.lit("1997-01-01").cast("date"))
    return kept.select(
        "time", F.lower("o_orderstatus").alias("district"), F.lit(1).alias("flood"), "o_totalprice",
        relative_change(F.col("o_totalprice"), F.lit(250000.0)).alias("change"),
    ).distinct()


@query("impact_records", sql="""
SELECT DISTINCT CAST(o_orderdate AS DATE) AS time, LOWER(c_mktsegment) AS district, 1 AS flood
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) >= DATE '2000-01-01'""")
def impact_records(spark, d):
    orders = read_table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    raw = orders.join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.col("c_mktsegment").alias("Area"),
        F.lit(1).alias("flood"),
    )
    return P.prepare_impact(raw, "Area", "dd/MM/yyyy")


@query("first_non_null_dedupe", sql="""
SELECT LOWER(l_returnflag) AS district, MAKE_DATE(YEAR(l_shipdate), MONTH(l_shipdate), DAY(l_shipdate)) AS time,
       ARG_MIN(NULLIF(l_tax, 0), l_orderkey * 1000 + l_linenumber) FILTER (WHERE l_tax <> 0) AS tax,
       ARG_MIN(l_quantity, l_orderkey * 1000 + l_linenumber) AS quantity
FROM lineitem GROUP BY 1, 2""")
def first_non_null_dedupe(spark, d):
    lines = read_table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("District"),
        F.year("l_shipdate").alias("Year"), F.month("l_shipdate").alias("Month"), F.day("l_shipdate").alias("Day"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"), F.col("l_quantity").alias("quantity"),
    )
    return R.first_values(P.prepare_daily(lines), ["district", "time"], "ord", ["tax", "quantity"])


# Keys taken as misspelt, with their repairs.
KEY_REPAIR = {"supplier#000000001": "supplier#one", "supplier#000000002": "supplier#two"}


@query("key_normalise", sql="""
SELECT s_suppkey, CASE LOWER(s_name) """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KEY_REPAIR.items()) + """
  ELSE LOWER(s_name) END AS district FROM supplier""")
def key_normalise(spark, d):
    """Case lowered, the accented e folded, then misspelt keys repaired."""
    accented = read_table(spark, d, "supplier").withColumn("name", F.translate(F.col("s_name"), "e", "é"))
    folded = accented.select("s_suppkey", fold_accents(F.col("name")).alias("district"))
    return R.repair_keys(folded, "district", KEY_REPAIR)


@query("null_profile", "v_daily_gap", """
SELECT 'district' AS "column", COUNT(*) FILTER (WHERE district IS NULL) AS n_null FROM v_daily_gap
UNION ALL SELECT 'station', COUNT(*) FILTER (WHERE station IS NULL) FROM v_daily_gap
UNION ALL SELECT 'time', COUNT(*) FILTER (WHERE time IS NULL) FROM v_daily_gap
UNION ALL SELECT 'dis', COUNT(*) FILTER (WHERE dis IS NULL) FROM v_daily_gap""")
def null_profile(spark, d):
    return R.null_profile(V.v_daily_gap(spark, d))


@query("null_mask", "v_daily_gap", """
SELECT district, station, time, dis, dis IS NULL AS dis_imp FROM v_daily_gap""")
def null_mask(spark, d):
    gap = V.v_daily_gap(spark, d).withColumn("empty", F.lit(None).cast("double"))
    return R.null_mask(R.drop_null_columns(gap), ["dis"])


@query("product_features", "v_rain", """
SELECT district, time, rain_max, rain_mean, ROUND(soil1 * rain_max, 6) AS "rainSM_L1",
       ROUND(soil2 * soil4, 6) AS "soilM_2x4" FROM v_rain""")
def product_features(spark, d):
    made = R.product_features(
        V.v_rain(spark, d), "rain_max", "soil1", "soil2", "soil4", ["soil1", "soil2", "soil3", "soil4"]
    )
    return made.select(
        "district", "time", "rain_max", "rain_mean",
        F.round("rainSM_L1", 6).alias("rainSM_L1"), F.round("soilM_2x4", 6).alias("soilM_2x4"),
    )


@query("season_dummies", "v_rain", """
SELECT district, time, CASE WHEN MONTH(time) IN (3,4,5) THEN 1 ELSE 0 END AS spring,
       CASE WHEN MONTH(time) IN (6,7,8) THEN 1 ELSE 0 END AS summer,
       CASE WHEN MONTH(time) IN (12,1,2) THEN 1 ELSE 0 END AS winter FROM v_rain""")
def season_dummies(spark, d):
    rain = V.v_rain(spark, d).select("district", "time", season_of(F.col("time")).alias("season"))
    return R.season_dummies(rain)


@query("district_dummies", "v_rain", """
SELECT time, district, (district = 'AMERICA')::INT AS "AMERICA", (district = 'ASIA')::INT AS "ASIA",
       (district = 'EUROPE')::INT AS "EUROPE", (district = 'MIDDLE EAST')::INT AS "MIDDLE EAST" FROM v_rain""")
def district_dummies(spark, d):
    levels = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return R.level_dummies(V.v_rain(spark, d).select("time", "district"), "district", levels, "AFRICA")


@query("static_attributes", "v_rain v_nation_series", """
WITH veg AS (SELECT district, time, soil1 AS "EVI_mean" FROM v_rain),
st AS (SELECT r_name AS district, AVG(s_acctbal) AS occurrence, MAX(s_acctbal) AS mean
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT r.district, r.time, v."EVI_mean", ROUND(st.occurrence / 1000000, 9) AS perc_water, st.mean AS avg_slope
FROM v_rain r LEFT JOIN veg v ON v.district = r.district AND v.time = r.time
LEFT JOIN st ON st.district = r.district""")
def static_attributes(spark, d):
    """Vegetation by (district, day) and static attributes by district."""
    rain = V.v_rain(spark, d)
    veg = rain.select("district", "time", F.col("soil1").alias("EVI_mean"))
    east = F.col("district").isin("AFRICA", "ASIA")
    panel = P.attach_vegetation(rain.select("district", "time"), [veg.where(east), veg.where(~east)])
    supplier = read_table(spark, d, "supplier").join(
        V.supplier_district(spark, d), "s_suppkey"
    ).groupBy(F.col("r_name").alias("district")).agg(
        F.round(F.avg("s_acctbal") / 1000000, 9).alias("occurrence"), F.max("s_acctbal").alias("mean")
    )
    return P.attach_static(
        panel, supplier.select("district", "occurrence"), supplier.select("district", "mean")
    )


@query("neighbour_max", "v_nation_series v_neigh", """
WITH per_day AS MATERIALIZED (SELECT district, time, MAX(dis) AS dis FROM v_nation_series GROUP BY 1, 2),
beside AS MATERIALIZED (SELECT k.district, f.time, MAX(f.dis) AS "NB_dis" FROM v_neigh k JOIN per_day f ON f.district = k.neighbour GROUP BY 1, 2)
SELECT s.district, s.time, s.dis, m."NB_dis" FROM v_nation_series s LEFT JOIN beside m USING (district, time)""")
def neighbour_max(spark, d):
    return P.neighbour_maxima(V.v_nation_series(spark, d), V.v_neigh(spark, d), ["dis"])


@query("neighbour_edges", sql="""
WITH m AS (SELECT s.n_name AS a, c.n_name AS b
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN customer ON o_custkey = c_custkey JOIN nation s ON s_nationkey = s.n_nationkey
      JOIN nation c ON c_nationkey = c.n_nationkey WHERE s.n_name <> c.n_name)
SELECT DISTINCT LOWER(a) AS district, LOWER(b) AS neighbour FROM m""")
def neighbour_edges(spark, d):
    """Trade links between nations as a 1 / empty matrix, then back to edges."""
    lines = read_table(spark, d, "lineitem")
    buyer = V.customer_district(spark, d).select("c_custkey", F.col("n_name").alias("to_nation"))
    orders = read_table(spark, d, "orders").join(buyer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "to_nation"
    )
    pairs = (
        lines.join(V.supplier_district(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .where(F.col("n_name") != F.col("to_nation"))
        .select(F.col("n_name").alias("District"), "to_nation")
    )
    matrix = pairs.groupBy("District").pivot("to_nation").agg(F.max(F.lit(1)))
    return P.neighbour_edges(matrix)


@query("label_last", "v_days", "SELECT district, station, time, dis, flood FROM v_days")
def label_last(spark, d):
    """The label moved behind all other columns, as the learners expect it."""
    days = V.v_days(spark, d).select("flood", "district", "station", "time", "dis")
    moved = R.label_last(days)
    if moved.columns[-1] != "flood":
        raise ValueError("the label is not the last column")
    return moved


@query("vegetation_columns", "v_rain", 'SELECT district, time, soil1 AS "EVI_mean", soil2 AS "NDVI_mean" FROM v_rain')
def vegetation_columns(spark, d):
    """Only the columns of one downloaded variable, with its keys."""
    wide = V.v_rain(spark, d).withColumnsRenamed({"soil1": "EVI_mean", "soil2": "NDVI_mean"})
    return variable_columns(wide, "vegetation", ["district", "time"])


@query("row_max_station", "v_series", """
WITH w AS (SELECT district, time, MAX(dis) FILTER (WHERE n = 1) AS a, MAX(dis) FILTER (WHERE n = 2) AS b,
                  MAX(dis) FILTER (WHERE n = 3) AS c
           FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY district ORDER BY station) AS n FROM v_series) GROUP BY 1, 2)
SELECT district, time, GREATEST(a, b, c) AS best_dis FROM w""")
def row_max_station(spark, d):
    wide = R.stations_wide(V.v_series(spark, d), {"dis": "dis_station"}, 3)
    return R.row_max(wide, R.columns_like(wide, "dis_station"), "best_dis").select("district", "time", "best_dis")


@query("best_station_by_rank", "v_series", """
WITH t AS (SELECT district, station, ROUND(AVG(dis), 6) AS m FROM v_series GROUP BY 1, 2)
SELECT district, 'dis_station' || n AS best_station FROM (
  SELECT district, DENSE_RANK() OVER (PARTITION BY district ORDER BY station) AS n,
         ROW_NUMBER() OVER (PARTITION BY district ORDER BY m, station) AS r FROM t) WHERE r = 1""")
def best_station_by_rank(spark, d):
    """Name of the station column with the smallest value, one row per district."""
    means = V.v_series(spark, d).groupBy("district", "station").agg(F.round(F.avg("dis"), 6).alias("m"))
    wide = R.stations_wide(means.withColumn("time", F.lit(None).cast("date")), {"m": "dis_station"}, 3)
    return R.row_argmin(wide, R.columns_like(wide, "dis_station"), "best_station").select("district", "best_station")


@query("latest_rows", "v_series", """
SELECT district, station, time, dis, r FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY district, station ORDER BY time DESC) AS r FROM v_series) WHERE r <= 3
ORDER BY district, station, r""")
def latest_rows(spark, d):
    """The last three days of every series, sorted."""
    w = Window.partitionBy("district", "station").orderBy(F.col("time").desc())
    return V.v_series(spark, d).withColumn("r", F.row_number().over(w)).where(F.col("r") <= 3).orderBy(
        "district", "station", "r"
    )


@query("distinct_stations", "v_series", "SELECT DISTINCT station FROM v_series")
def distinct_stations(spark, d):
    return V.v_series(spark, d).select("station").distinct()


@query("lowest_discharge_days", "v_series", """
SELECT s.district, s.station, s.time, s.dis FROM v_series s
JOIN (SELECT district, station, MIN(dis) AS m FROM v_series GROUP BY 1, 2) g
ON g.district = s.district AND g.station = s.station AND s.dis = g.m""")
def lowest_discharge_days(spark, d):
    return group_minima(V.v_series(spark, d), ["district", "station"], "dis").select(
        "district", "station", "time", "dis"
    )

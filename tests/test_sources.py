"""Readers, writers and column helpers; plan shape of the native operators."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from freshet import schemas
from freshet.operators import compare as C, explore as E, panel as P, reshape as R
from freshet.plans import catalog
from freshet.sources import sinks, tables

DAY = dt.date(2001, 5, 1)


def test_csv_scan_latin1_and_nan(spark, tmp_path):
    text = "Day,Month,Year,District,PCODE,max,mean\n1,5,2001,Mutén,P1,NaN,2.5\n2,5,2001,Lira,P2,4.0,\n"
    (tmp_path / "rain.csv").write_bytes(text.encode("latin-1"))
    df = tables.read_csv(spark, str(tmp_path / "rain.csv"), schemas.RAINFALL, ["Day", "Month", "Year", "District", "max"])
    assert df.columns == ["Day", "Month", "Year", "District", "max"]
    rows = {r.district: r for r in P.prepare_daily(df).collect()}
    assert rows["mutén"].time == DAY and rows["mutén"].max is None and rows["lira"].max == 4.0


def test_union_fills_missing_columns_and_country(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "q")], "x int, y string")
    out = {r.x: (r.y, r.Country) for r in tables.union_countries({"Kenya": a, "Uganda": b}).collect()}
    assert out == {1: (None, "Kenya"), 2: ("q", "Uganda")}


def test_jdbc_options_need_a_known_country():
    tables_of = {"kenya": "discharge_ken"}
    options = tables.discharge_jdbc_options("kenya", tables_of, "jdbc:postgresql://db/x", 8)
    assert options["dbtable"] == "discharge_ken" and options["partitionColumn"] == "time"
    with pytest.raises(ValueError):
        tables.discharge_jdbc_options("chad", tables_of, "jdbc:postgresql://db/x")


def test_read_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert tables.read_or_build(spark, path, build).count() == 3
    assert tables.read_or_build(spark, path, build).count() == 3
    assert calls == [1]


def test_an_aborted_build_is_not_read(spark, tmp_path):
    """A first write that fails half way, and a folder without a marker, are built anew."""
    path = str(tmp_path / "cache")
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.read_or_build(spark, path, lambda: broken)
    (tmp_path / "cache" / "builds" / "half").mkdir(parents=True)
    spark.range(1).write.parquet(f"{path}/builds/half/part")
    assert tables.read_or_build(spark, path, lambda: spark.range(5)).count() == 5
    assert tables.read_or_build(spark, path, lambda: spark.range(7)).count() == 5
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    assert tables.read_or_build(spark, str(tmp_path / "plain"), lambda: spark.range(2)).count() == 2


def test_ranked_results_open_only_the_best_folders(spark, sf_dir, tmp_path):
    from freshet.plans.model_queries import ranked_results

    out = ranked_results(spark, sf_dir, str(tmp_path))
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().treeString()
    rows = out.collect()
    assert {r["rank"] for r in rows} == {1, 2} and len({r.model for r in rows}) == 2


def test_results_round_trip_prunes_partitions(spark, tmp_path):
    rows = [("LR", 3, 1, True, "d", 0.5), ("LR", 3, 1, False, "d", 0.4), ("SVC", 5, 2, True, "d", 0.3)]
    df = spark.createDataFrame(rows, "model string, window int, n_ahead int, wt boolean, district string, f1 double")
    path = str(tmp_path / "results")
    sinks.write_results(df, path)
    assert sorted(map(tuple, tables.read_results(spark, path).select(*df.columns).collect())) == sorted(rows)
    picked = tables.read_results(spark, path, ["LR"], True)
    assert [r.f1 for r in picked.collect()] == [0.5]
    assert re.search(r"PartitionFilters: \[.*model", picked._jdf.queryExecution().executedPlan().toString())


def test_station_cube_table_and_polygon_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", DAY, 1.0), ("b", DAY, 2.0)], "station string, time date, dis double")
    sinks.write_per_station(df, str(tmp_path / "st"))
    assert (tmp_path / "st" / "station=a").exists()
    assert spark.read.parquet(str(tmp_path / "st")).count() == 2
    cube = spark.createDataFrame([(0.0, 1.0, DAY, 2.0)], schemas.DISCHARGE_CUBE)
    sinks.write_cube_by_year(cube, str(tmp_path / "cube"))
    assert (tmp_path / "cube" / "year=2001").exists()
    sinks.write_table(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    edges = spark.createDataFrame([("z", 0.0, 0.0, 1.0, 0.0), ("z", 1.0, 0.0, 0.0, 0.0)],
                                  "zone string, x1 double, y1 double, x2 double, y2 double")
    assert sinks.edges_to_wkt(edges, "zone").first().wkt.startswith("MULTILINESTRING ((0.0 0.0, 1.0 0.0), (1.0")


def test_required_columns_and_variables(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2)], "k int, EVI_mean double, NDVI_mean double")
    assert schemas.variable_columns(df, "vegetation", ["k"]).columns == ["k", "EVI_mean", "NDVI_mean"]
    with pytest.raises(ValueError):
        schemas.require_columns(df, "District")
    with pytest.raises(ValueError):
        schemas.variable_columns(df, "snow", ["k"])


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, None, 3.0, 0)], "k int, dis_1 double, dis_2 double, z double, flood int")
    assert R.columns_like(df, "dis_") == ["dis_1", "dis_2"]
    assert R.double_columns(df, last_first=True) == ["z", "dis_1", "dis_2"]
    assert R.label_last(df).columns[-1] == "flood" and R.drop_null_columns(df).columns == ["k", "dis_1", "z", "flood"]
    assert R.select_like(df, "^d").columns == ["dis_1", "dis_2"] and R.drop_like(df, "dis").columns == ["k", "z", "flood"]
    row = R.row_max(R.row_argmin(df, ["dis_1", "dis_2", "z"], "low"), ["dis_1", "dis_2", "z"], "high").first()
    assert row.low == "dis_1" and row.high == 3.0


def test_impact_dedupes_after_normalising(spark):
    rows = [("01/05/2001", "Lira", 1), ("01/05/2001", "LIRA", 1), ("01/05/1999", "Lira", 1), ("02/05/2001", None, 1)]
    df = spark.createDataFrame(rows, "Date string, Area string, flood int")
    assert [tuple(r) for r in P.prepare_impact(df, "Area", "dd/MM/yyyy").collect()] == [(DAY, "lira", 1)]


def test_panel_repairs_keys_on_the_key_column(spark):
    dis = spark.createDataFrame([("s", DAY, 1.0)], "station string, time date, dis double")
    links = spark.createDataFrame([("wakiso", "s")], "district string, station string")
    impact = spark.createDataFrame([(DAY, "wakiso", 1)], "time date, district string, flood int")
    rain = spark.createDataFrame([("wasiko", DAY, 9.0)], "district string, time date, rainfall double")
    row = P.build_panel(dis, links, impact, rain, None, "Uganda", {"wasiko": "wakiso"}).first()
    assert row.rainfall == 9.0 and row.flood == 1 and row.season == "spring" and row.station_dis == "swakiso"


def test_neighbour_edges_from_a_matrix(spark):
    matrix = spark.createDataFrame([("A", None, "1"), ("B", "1", None)], "District string, A string, B string")
    assert {tuple(r) for r in P.neighbour_edges(matrix).collect()} == {("a", "b"), ("b", "a")}


@pytest.mark.parametrize("name", [
    "threshold_cv", "event_scores", "event_blocks_trimmed", "zonal_stats", "nearest_cell_series", "avg_per_period",
    "panel_clip_to_events", "basin_intersects", "sign_test", "robust_scale_panel", "wavelet_swt",
])
def test_plans_have_no_cross_joins_and_no_python(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert banned not in plan


def test_feature_chain_uses_one_sort_and_one_shuffle(spark):
    from freshet.operators.windows import discharge_features, trailing_max

    df = spark.createDataFrame([("d", "s", DAY, 1.0)], "district string, station string, time date, dis double")
    keys = ["district", "station"]
    made = trailing_max(discharge_features(df, keys, "time"), keys, "time", {"dis": "m14"})
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_filters_and_columns_reach_the_scan(spark, sf_dir, capsys):
    catalog.QUERIES["scan_prune_filter"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "l_discount" not in plan
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "uga.csv").write_text("name,pcode,Impact_data,Glofas_st,Glofas_st2,Glofas_st3,Glofas_st4,Total_Glofas,mountainuous,close_to_lake,Affected_noGlofas\nabim,UG314,1,G1,,,,1,0,,0\n")
    for schema in (schemas.LINK_UGA, schemas.LINK_KEN.split(", Total_Glofas")[0]):
        row = tables.read_csv(spark, str(tmp_path / "uga.csv"), schema).first()
        assert (row["name"], row["pcode"], row["Impact_data"], row["Glofas_st"], row["Glofas_st2"]) == ("abim", "UG314", 1, "G1", None)
    with pytest.raises(ValueError, match="Day"):
        tables.read_csv(spark, str(tmp_path / "uga.csv"), schemas.RAINFALL)


def test_matrix_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿District,Abim,Agago\nAbim,,1\nAgago,1,\n".encode())
    table = tables.read_matrix(spark, str(tmp_path / "m.csv"))
    assert table.columns == ["District", "Abim", "Agago"]
    assert {tuple(r) for r in table.collect()} == {("Abim", None, 1), ("Agago", 1, None)}


def test_wide_stations_keep_or_refuse_every_station(spark):
    rows = [("d", f"s{k}", dt.date(2000, 1, 1), float(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "district string, station string, time date, dis double")
    wide = R.stations_wide(df, {"dis": "dis_station"}).first()
    assert [wide[f"dis_station{n}"] for n in range(1, 7)] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    with pytest.raises(Exception, match="more than 4 stations in d"):
        R.stations_wide(df, {"dis": "dis_station"}, 4).collect()


def test_bins_and_years_lose_no_row(spark):
    counts = spark.createDataFrame([(k, 0.5) for k in (0, 4, 54, 55, 900)] + [(None, 0.5)], "n int, f1 double")
    binned = {r.interval: r.n_districts for r in C.score_bins(counts, "n", "f1").collect()}
    assert sum(binned.values()) == 6 and binned["55+"] == 2 and binned["0-4"] == 3
    events = spark.createDataFrame([(dt.date(y, 5, 1), 1) for y in (1992, 1995, 1995, 2030)], "time date, flood int")
    years = {r.year: r.n for r in E.by_year(events, F.sum("flood"), "n", zero=True).collect()}
    assert sum(years.values()) == 4 and min(years) == 1992 and max(years) == 2030

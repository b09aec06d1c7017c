"""Declared schemas of the input tables, so nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


# Column names and types of the input files, in file order (DDL text).
STATIONS = "ID string, Stationnam string, CountryNam string, XCorrected double, YCorrected double"
DISCHARGE_CUBE = "lat double, lon double, time date, dis24 double"
IMPACT_UGA = "Date string, Area string, flood int, data_quality_score int"
IMPACT_KEN = "Date string, County string, flood int, data_quality int"
LINK_KEN = (
    "pcode string, name string, Impact_data int, Glofas_st string, Glofas_st2 string, Glofas_st3 string,"
    " Glofas_st4 string, Total_Glofas int, mountainuous int, close_to_lake int, Affected_noGlofas int"
)
LINK_UGA = (
    "name string, pcode string, Impact_data int, Glofas_st string, Glofas_st2 string, Glofas_st3 string,"
    " Glofas_st4 string, Total_Glofas int, mountainuous int, close_to_lake int, Affected_noGlofas int"
)
VEGETATION = "Day int, Month int, Year int, District string, EVI_mean double, NDVI_mean double"
WATER = "district string, occurrence double"
SLOPE = "district string, mean double"
RAINFALL = "Day int, Month int, Year int, District string, PCODE string, max double, mean double"
SOIL_UGA = (
    "Day int, Month int, Year int, District string, SoilMoi0_10cm_inst_mean double,"
    " SoilMoi10_40cm_inst_mean double, SoilMoi40_100cm_inst_mean double, SoilMoi100_200cm_inst_mean double"
)
SOIL_KEN = (
    "Day int, Month int, Year int, ADMIN string, SoilMoi0_10cm_inst_mean double,"
    " SoilMoi10_40cm_inst_mean double, SoilMoi40_100cm_inst_mean double, SoilMoi100_200cm_inst_mean double"
)
AREAS_KEN = "pcode_leve string, pcode_le_1 string, name string, area double"
AREAS_UGA = (
    "OBJECTID int, ADM0_EN string, ADM0_PCODE string, name string, ADM1_PCODE string, area bigint"
)

# The columns kept per downloaded variable.
VARIABLE_COLUMNS = {
    "soil_moisture": [
        "SoilMoi0_10cm_inst", "SoilMoi10_40cm_inst", "SoilMoi40_100cm_inst", "SoilMoi100_200cm_inst",
    ],
    "vegetation": ["EVI_mean", "NDVI_mean"],
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: Spark ranks NaN highest, we skip it."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Fail before any job starts when an expected column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def variable_columns(df: DataFrame, variable: str, keys: list[str]) -> DataFrame:
    """Keep the keys and the columns that belong to the named variable."""
    if variable not in VARIABLE_COLUMNS:
        raise ValueError(f"unknown variable {variable!r}; one of {sorted(VARIABLE_COLUMNS)}")
    return require_columns(df, *keys, *VARIABLE_COLUMNS[variable]).select(*keys, *VARIABLE_COLUMNS[variable])

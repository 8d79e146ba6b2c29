"""Canonical schemas and column lists of the price store and its inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# The price table column order and its seven-part key.
PRICE_COLUMNS = [
    "state", "district", "market", "commodity_group", "commodity",
    "variety", "grade", "min_price", "max_price", "modal_price",
    "price_unit", "arrival_quantity", "arrival_unit", "arrival_date",
]
KEY_COLUMNS = [
    "arrival_date", "state", "district", "market", "commodity", "variety", "grade",
]
# The column lists and field names below are those of the stored
# table, the report files, the API records, the forecast and the profile JSON.
TEXT_COLUMNS = [
    "state", "district", "market", "commodity_group", "commodity",
    "variety", "grade", "price_unit", "arrival_unit",
]
NUMBER_COLUMNS = ["min_price", "max_price", "modal_price", "arrival_quantity"]
REQUIRED_RAW = ["state", "market", "commodity", "arrival_date"]
REQUIRED_API = ["state", "market", "commodity", "arrival_date", "modal_price"]
PRICE_FIELDS = ["min_price", "max_price", "modal_price", "price_unit"]
PRESERVED_FIELDS = ["commodity_group", "arrival_quantity", "arrival_unit"]
# A market series: the unit the advisory is computed for.
SERIES = ["state", "district", "market", "commodity"]

PRICE_SCHEMA = T.StructType([
    T.StructField("state", T.StringType(), False),
    T.StructField("district", T.StringType(), True),
    T.StructField("market", T.StringType(), False),
    T.StructField("commodity_group", T.StringType(), True),
    T.StructField("commodity", T.StringType(), False),
    T.StructField("variety", T.StringType(), True),
    T.StructField("grade", T.StringType(), True),
    T.StructField("min_price", T.DoubleType(), True),
    T.StructField("max_price", T.DoubleType(), True),
    T.StructField("modal_price", T.DoubleType(), False),
    T.StructField("price_unit", T.StringType(), True),
    T.StructField("arrival_quantity", T.DoubleType(), True),
    T.StructField("arrival_unit", T.StringType(), True),
    T.StructField("arrival_date", T.DateType(), False),
])

# Raw CSV report: 14 positional text columns.
RAW_CSV_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in PRICE_COLUMNS])

API_RECORD = T.StructType([
    T.StructField(c, T.StringType(), True)
    for c in ["state", "district", "market", "commodity", "variety", "grade",
              "arrival_date", "min_price", "max_price", "modal_price"]
])
API_ENVELOPE = T.StructType([
    T.StructField("status", T.StringType(), True),
    T.StructField("records", T.ArrayType(API_RECORD), True),
])

FORECAST_ENTRY = T.StructType([
    T.StructField("dt_txt", T.StringType(), True),
    T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType(), True)]), True),
    T.StructField("pop", T.DoubleType(), True),
    T.StructField("weather", T.ArrayType(T.StructType([
        T.StructField("description", T.StringType(), True)])), True),
])
FORECAST_DOC = T.StructType([
    T.StructField("location_id", T.LongType(), True),
    T.StructField("fetched_at", T.StringType(), True),  # when it was landed, if the lander says so
    T.StructField("cod", T.StringType(), True),
    T.StructField("list", T.ArrayType(FORECAST_ENTRY), True),
    T.StructField("city", T.StructType([
        T.StructField("name", T.StringType(), True),
        T.StructField("coord", T.StructType([
            T.StructField("lat", T.DoubleType(), True),
            T.StructField("lon", T.DoubleType(), True)]), True)]), True),
])

PROFILE = T.StructType([
    T.StructField("crop_name", T.StringType(), True),
    T.StructField("optimal_temp_range_c", T.ArrayType(T.DoubleType()), True),
    T.StructField("critical_temp_max_c", T.DoubleType(), True),
    T.StructField("critical_temp_min_c", T.DoubleType(), True),
    T.StructField("chilling_injury_threshold_c", T.DoubleType(), True),
    T.StructField("frost_sensitive", T.BooleanType(), True),
    T.StructField("heat_sensitive", T.BooleanType(), True),
    T.StructField("rain_sensitive", T.BooleanType(), True),
    T.StructField("waterlogging_sensitive", T.BooleanType(), True),
    T.StructField("rain_risk_mm_threshold", T.DoubleType(), True),
    T.StructField("critical_growth_stage_dat", T.ArrayType(T.IntegerType()), True),
    T.StructField("storage_life_days", T.IntegerType(), True),
    T.StructField("storage_temp_range_c", T.ArrayType(T.DoubleType()), True),
    T.StructField("storage_temp_by_use_c",
                  T.MapType(T.StringType(), T.ArrayType(T.DoubleType())), True),
    T.StructField("perishability", T.StringType(), True),
    T.StructField("harvest_window_days", T.IntegerType(), True),
    T.StructField("field_lifecycle_days", T.ArrayType(T.IntegerType()), True),
    T.StructField("price_volatility", T.StringType(), True),
    T.StructField("sell_or_wait_bias", T.StringType(), True),
    T.StructField("grading_note", T.StringType(), True),
    T.StructField("advisory_note", T.StringType(), True),
])
PROFILE_MAP = T.MapType(T.StringType(), PROFILE)

SYNC_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("synced_at", T.StringType(), True),
    T.StructField("records_added", T.IntegerType(), True),
])

"""Crop knowledge base: profile rows, JSON load and the driver-table mapping."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PROFILE_MAP

# The profile fields the rule engine reads, per crop key
# (crop_name, critical max C, critical min C, heat / rain / waterlogging
# sensitive, storage life days, perishability, sell-or-wait bias).
PROFILE_VALUES = [
    ("tomato", "Tomato", 32.2, 12.7, True, False, False, 10, "high", "sell_fast_if_perishable"),
    ("onion", "Onion", 30.0, 5.0, False, True, True, 300, "low", "can_wait_for_better_price"),
    ("potato", "Potato", 26.6, 2.0, False, True, True, 180, "medium", "can_wait_for_better_price"),
    ("cauliflower", "Cauliflower", 25.0, 5.0, True, True, False, 28, "high", "sell_fast_if_perishable"),
    ("green chilli", "Green Chilli", 35.0, 5.0, True, True, True, 21, "high", "sell_fast_if_perishable"),
    ("brinjal", "Brinjal", 35.0, 10.0, False, False, False, 14, "high", "sell_fast_if_perishable"),
]
# Driver-table commodity (part type) -> crop key.
DRIVER_CROP_OF_TYPE = [
    ("ECONOMY", "tomato"), ("MEDIUM", "onion"), ("STANDARD", "potato"),
    ("PROMO", "cauliflower"), ("SMALL", "green chilli"), ("LARGE", "brinjal"),
]

PROFILE_COLUMNS = [
    "crop_key", "crop_name", "critical_temp_max_c", "critical_temp_min_c",
    "heat_sensitive", "rain_sensitive", "waterlogging_sensitive",
    "storage_life_days", "perishability", "sell_or_wait_bias",
]
PROFILE_DDL = ("crop_key string, crop_name string, critical_temp_max_c double, "
               "critical_temp_min_c double, heat_sensitive boolean, "
               "rain_sensitive boolean, waterlogging_sensitive boolean, "
               "storage_life_days int, perishability string, sell_or_wait_bias string")


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, rows, columns) -> DataFrame:
    """A fixed table as one SQL VALUES relation (one call, no Python rows)."""
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def driver_profile_table(spark: SparkSession) -> DataFrame:
    """Profiles keyed by the lower-cased driver commodity (``p_type``)."""
    prof = {r[0]: r for r in PROFILE_VALUES}
    rows = [(p_type.lower(),) + prof[key] for p_type, key in DRIVER_CROP_OF_TYPE]
    return literal_table(spark, rows, ["commodity_key"] + PROFILE_COLUMNS).drop("crop_key")


def profile_document() -> str:
    """The knowledge base as one JSON object keyed by crop (as shipped)."""
    doc = {}
    for row in PROFILE_VALUES:
        rec = dict(zip(PROFILE_COLUMNS, row))
        key = rec.pop("crop_key")
        doc[key] = rec
    return json.dumps(doc)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A5: whole-file JSON object keyed by crop -> one row per crop.

    The file is tiny by construction (one profile per supported crop), so a
    whole-text read is bounded; ``explode`` turns the map into rows.
    """
    raw = spark.read.option("wholetext", True).text(path)
    return (raw.select(F.explode(F.from_json("value", PROFILE_MAP)).alias("crop_key", "p"))
            .select("crop_key", "p.*"))


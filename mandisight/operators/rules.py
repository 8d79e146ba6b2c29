"""Advisory assembly (F4, F5, I13): market summary + weather + crop profile.

The profile table has one row per supported crop (six rows as shipped) and
is broadcast by its measured size; the weather horizon has one row per location and joins on the
location key (the planner picks broadcast or shuffle by its measured
size). The market side keeps its series clustering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def attach_profile(df: DataFrame, profiles: DataFrame, commodity: str = "commodity",
                   strict: bool = True) -> DataFrame:
    """crop profile lookup on ``lower(commodity)``.

    ``strict`` drops crops without a profile (the reference raises); else a
    left join keeps them with ``missing_profile`` set.
    """
    j = df.join(profiles,  # small tables are broadcast by their measured size
                F.lower(F.col(commodity)) == profiles["commodity_key"],
                "inner" if strict else "left")
    if not strict:
        j = j.withColumn("missing_profile", F.col("commodity_key").isNull())
    return j.drop("commodity_key")


def assemble(summary: DataFrame, horizon: DataFrame, profiles: DataFrame,
             strict: bool = True) -> DataFrame:
    """series summary LEFT JOIN weather horizon, then the profile."""
    w = (horizon.withColumnRenamed("available", "weather_available")
         .withColumnRenamed("n_days", "forecast_days"))
    j = summary.join(w, "location_id", "left")
    return attach_profile(j, profiles, strict=strict)


def rule_engine(joined: DataFrame) -> DataFrame:
    """Flags, extremes, decision, facts and reasons as columns."""
    avail = F.coalesce(F.col("weather_available"), F.lit(False))
    max_t = F.when(avail, F.col("max_forecast_temp_c"))
    min_t = F.when(avail, F.col("min_forecast_temp_c"))
    rain = F.when(avail, F.coalesce(F.col("max_rain_probability_percent"), F.lit(0.0))).otherwise(F.lit(0.0))
    trend = F.coalesce(F.col("trend"), F.lit("unknown"))
    crop_name = F.coalesce(F.col("crop_name"), F.col("commodity"), F.lit("This crop"))
    out = joined.select(
        "*",
        max_t.alias("rule_max_temp_c"), min_t.alias("rule_min_temp_c"),
        rain.alias("rule_max_rain_percent"), trend.alias("market_signal"),
        crop_name.alias("rule_crop_name"))
    out = out.select(
        "*",
        R.heat_risk("rule_max_temp_c", "critical_temp_max_c", "heat_sensitive").alias("heat_risk"),
        R.rain_risk("rule_max_rain_percent", "rain_sensitive", "waterlogging_sensitive").alias("rain_risk"),
        R.cold_risk(avail, "rule_min_temp_c", "critical_temp_min_c").alias("cold_risk"))
    return out.select(
        "*",
        R.decision("heat_risk", "cold_risk", "rain_risk", "sell_or_wait_bias", "market_signal",
                   "storage_life_days", "perishability").alias("recommended_decision"),
        F.coalesce(F.col("perishability"), F.lit("unknown")).alias("crop_storage_signal"),
        R.facts("latest_modal_price", "seven_day_change_percent", "market_signal",
                "heat_risk", "cold_risk", "rain_risk", "rule_max_temp_c", "rule_min_temp_c",
                "rule_max_rain_percent", "rule_crop_name", "critical_temp_max_c",
                "critical_temp_min_c").alias("facts_for_explanation"),
        R.reasons("heat_risk", "cold_risk", "rain_risk", "perishability",
                  "rule_crop_name").alias("reasons"))

"""L6 advisory batch: every market series gets its rule-engine decision.

``summary`` (D3 -> H4 -> G3/G8/G9/I1/I2, per series) LEFT JOIN the weather
horizon (C8 -> G1 -> H5 -> G2, per location) JOIN the broadcast crop
profiles, then one projection computes flags, decision, facts and reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market, payload, rules, weather
from ..schemas import SERIES
from ..sources import driver_tables as dt
from ..sources.profiles import driver_profile_table


def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dt.prices(spark, sf_dir)
    order = market.default_day_order(dt.ingest_order())
    return market.summarize(p, SERIES, 7, order, carry=["location_id"])


def weather_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.daily(dt.forecast_blocks(spark, sf_dir))


def weather_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.horizon(dt.forecast_blocks(spark, sf_dir))


def advisory_table(spark: SparkSession, sf_dir: str, strict: bool = True) -> DataFrame:
    """One row per series: summary, weather, profile and rule result columns."""
    joined = rules.assemble(series_summary(spark, sf_dir), weather_horizon(spark, sf_dir),
                            driver_profile_table(spark), strict=strict)
    return rules.rule_engine(joined)


# Advisory request defaults (an empty field takes the default).
REQUEST_DEFAULTS = {"crop": "Tomato", "state": "Andhra Pradesh", "district": "Palamaner",
                    "market": "Palamaner APMC", "language": "Telugu"}


# The place taken where a request states none.
DEFAULT_LATITUDE, DEFAULT_LONGITUDE = 13.552040, 78.505798


def with_request_defaults(requests: DataFrame) -> DataFrame:
    """NULL or empty request fields take the advisory defaults, a missing place the default place."""
    out = requests
    for c, d in (("latitude", DEFAULT_LATITUDE), ("longitude", DEFAULT_LONGITUDE)):
        stated = F.col(c).cast("double") if c in requests.columns else F.lit(None).cast("double")
        out = out.withColumn(c, F.coalesce(stated, F.lit(d)))
    for c, d in REQUEST_DEFAULTS.items():
        if c in requests.columns:
            out = out.withColumn(c, F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(d)))
        else:
            out = out.withColumn(c, F.lit(d))
    return out


def advisory_for_requests(prices: DataFrame, requests: DataFrame, blocks: DataFrame,
                          profiles: DataFrame, order=None, strict: bool = False) -> DataFrame:
    """The advisory endpoint for a whole table of farmer requests.

    ``requests``: req_id, crop, state, district, market, language, location_id
    (the forecast location of the farmer). Requests whose market has no price
    history keep NULL prices and trend ``unknown`` (P12), with ``market_message``
    saying whether there is no record or no valid one (I21); weather is matched on
    the request's location; the profile on ``lower(crop)``. A request for a
    crop without a profile (the reference raises) stays, with
    ``missing_profile`` set and no advice; ``strict`` drops it.
    """
    # The forecast's own place keeps the plain names.
    req = with_request_defaults(requests).withColumnsRenamed(
        {"crop": "commodity", "latitude": "request_latitude", "longitude": "request_longitude"})
    summary = market.summarize(prices, SERIES, 7, order)
    joined = market.with_availability(req.join(summary, SERIES, "left"), prices)
    assembled = rules.assemble(joined, weather.horizon(blocks, with_days=True), profiles, strict=strict)
    out = payload.nested_payload(rules.rule_engine(assembled), [c for c in profiles.columns if c != "commodity_key"],
                                 F.col("language"))
    fast = payload.compact_payload(out, F.col("language"))
    lang = F.col("language")
    told = fast.select(
        "*",
        payload.prompt_text(F.col("fast")).alias("prompt"),
        payload.system_prompt(lang).alias("system_prompt"),
        payload.user_prompt(lang, F.col("fast")).alias("user_prompt"),
        payload.fallback_advisory("commodity", "market", "trend", "seven_day_change_percent",
                                  "latest_modal_price").alias("fallback_advisory"),
        *payload.market_card("market", "latest_modal_price", "latest_max_price", "latest_min_price"))
    if strict:
        return told
    advice = ["recommended_decision", "facts_for_explanation", "reasons", "payload", "fast", "prompt", "system_prompt",
              "user_prompt", "fallback_advisory"]
    return told.withColumns({c: F.when(~F.col("missing_profile"), F.col(c)) for c in advice})

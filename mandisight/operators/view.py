"""The farmer's view: labels in the chosen language (K6) and a raw advisory made ready to show (K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import present as K
from ..functions.numbers import parse_number_lenient

# What the view shows where an advisory states nothing.
MISSING = "—"
WIND_SPEED = "12 km/h"
NEAREST_MARKET = "Nearest Mandi"
CROP_TIPS = {
    "harvest_tip": "Harvest when grains reach full maturity.",
    "storage_tip": "Store in a cool, dry, ventilated space.",
    "best_selling_period": "Within the next 2 weeks",
    "fertilizer_advice": "Apply balanced NPK as per soil test results.",
    "water_requirement": "Moderate — irrigate every 5-7 days.",
}
NO_RECOMMENDATION = "Recommendation unavailable right now."
CONFIDENCE = 82
DEFAULT_LANGUAGE = "English"

#: A raw advisory as the service answers it (any part may be missing).
RAW_ADVISORY = (
    "weather struct<temperature: string, humidity: string, rainfall: string, wind_speed: string>, "
    "market struct<market_name: string, modal_price: string, current_price: string, max_price: string, "
    "min_price: string, trend: string, arrival_date: string>, "
    "crop struct<harvest_tip: string, storage_tip: string, best_selling_period: string, fertilizer_advice: string, "
    "water_requirement: string>, "
    "recommendation string, reasons array<string>, confidence int, risk_level string, audio_base64 string")


def translated(df: DataFrame, labels: DataFrame, language: str = "language", key: str = "key",
               default: str = DEFAULT_LANGUAGE) -> DataFrame:
    """K6: ``df`` with ``label``: the text of ``key`` in ``language``, else in the default language, else the key.

    Empty texts count as missing. ``labels`` (language, key, text) grows with the interface, not with the data; the
    planner broadcasts it by its measured size.
    """
    own = labels.select(F.col("language").alias(language), F.col("key").alias(key), F.col("text").alias("_own"))
    known = labels.where(F.col("language") == default).select(F.col("key").alias(key), F.col("text").alias("_default"))
    joined = df.join(own, [language, key], "left").join(known, key, "left")
    label = F.coalesce(K.first_non_empty("_own"), K.first_non_empty("_default"), F.col(key))
    return joined.select(*df.columns, label.alias("label"))


def advisory_view(raw: DataFrame, today: Column | None = None) -> DataFrame:
    """K4: raw advisories (``raw``: struct of RAW_ADVISORY) with the farmer's form (``form_crop``, ``form_market``,
    ``form_district``) -> ``view``, a struct of what is shown; NULL without an advisory.

    A NULL takes the default (JavaScript's ``??``); for names an empty text does as well (``||``). ``today`` is the
    date shown where the market states none.
    """
    w, m, c = F.col("raw.weather"), F.col("raw.market"), F.col("raw.crop")
    modal = parse_number_lenient(F.coalesce(m["modal_price"], m["current_price"]), K.DEFAULT_VIEW_MODAL)
    high = parse_number_lenient(m["max_price"], modal * F.lit(K.HIGH_FACTOR))
    low = parse_number_lenient(m["min_price"], modal * F.lit(K.LOW_FACTOR))
    trend = F.coalesce(m["trend"], F.lit(K.DEFAULT_TREND))
    risk = F.coalesce(F.col("raw.risk_level"), F.lit(K.DEFAULT_RISK))

    def stated(*texts, default: str) -> Column:
        return F.coalesce(K.first_non_empty(*texts), F.lit(default))

    reasons = F.array(
        F.format_string(K.REASON_TREND, stated("form_crop", default="Crop"),
                        F.lower(F.coalesce(K.first_non_empty(m["trend"]), trend)),
                        stated("form_market", default="your selected market"),
                        stated("form_district", default="your district")),
        F.format_string(K.REASON_WEATHER, F.coalesce(w["rainfall"], F.lit("low rainfall"))), F.lit(K.REASON_MARKET))
    day = F.date_format(today if today is not None else F.current_date(), "yyyy-MM-dd")
    view = F.struct(
        F.struct(*[F.coalesce(w[k], F.lit(MISSING)).alias(k) for k in ("temperature", "humidity", "rainfall")],
                 F.coalesce(w["wind_speed"], F.lit(WIND_SPEED)).alias("wind_speed"),
                 K.rain_class(w["rainfall"]).alias("condition")).alias("weather"),
        F.struct(F.coalesce(K.first_non_empty(m["market_name"], "form_market"), F.lit(NEAREST_MARKET)).alias("market_name"),
                 K.price_label(modal).alias("modal_price"), K.price_label(high).alias("highest_price"),
                 K.price_label(low).alias("lowest_price"), modal.alias("modal_price_value"),
                 high.alias("highest_price_value"), low.alias("lowest_price_value"),
                 F.coalesce(m["arrival_date"], day).alias("arrival_date"), trend.alias("trend")).alias("market"),
        F.struct(*[F.coalesce(c[k], F.lit(v)).alias(k) for k, v in CROP_TIPS.items()]).alias("crop"),
        F.coalesce(F.col("raw.recommendation"), F.lit(NO_RECOMMENDATION)).alias("recommendation"),
        F.coalesce(F.col("raw.reasons"), reasons).alias("reasons"),
        F.coalesce(F.col("raw.confidence"), F.lit(CONFIDENCE)).alias("confidence"), risk.alias("risk_level"),
        K.infer_decision(risk, trend, F.col("raw.recommendation")).alias("decision"),
        F.col("raw.audio_base64").alias("audio_base64"))
    return raw.withColumn("view", F.when(F.col("raw").isNotNull(), view))

"""Registered queries for payloads, texts and presentation views."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import present as K
from ..functions.numbers import cents_text, parse_number_lenient, plain_double_text, round_half_even, scaled_round
from ..functions.text import clean_text_for_speech, language_code
from ..operators import history, market, payload, view
from ..schemas import SERIES
from ..session import scratch_path
from ..sources import driver_tables as dt
from ..sources.labels import read_labels
from ..sources.profiles import driver_profile_table, literal_table
from . import advisory as adv

LANGUAGE = "Telugu"


def r4(c):
    return scaled_round(c, 4)


def d2s(c):
    return F.date_format(c, "yyyy-MM-dd")


def _adv(spark, sf_dir) -> DataFrame:
    return adv.advisory_table(spark, sf_dir)


def q_compact_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payload.compact_payload(_adv(spark, sf_dir), F.lit(LANGUAGE))
    f = F.col("fast")
    return p.select(*SERIES, f["lang"].alias("lang"), f["decision"].alias("decision"),
                    r4(f["price"]).alias("price"), r4(f["chg7d_pct"]).alias("chg7d_pct"),
                    f["trend"].alias("trend"), r4(f["max_temp_c"]).alias("max_temp_c"),
                    f["heat_risk"].alias("heat_risk"), f["rain_risk"].alias("rain_risk"),
                    f["perishable"].alias("perishable"),
                    f["storage_days"].cast("long").alias("storage_days"),
                    r4(f["crit_temp_c"]).alias("crit_temp_c"),
                    F.array_join(f["reasons"], "; ").alias("reasons"))


def q_full_payload_fields(spark, sf_dir):
    p = payload.full_payload(_adv(spark, sf_dir), F.lit(LANGUAGE))
    fc, ms, ws, rr = (F.col("payload.farmer_context"), F.col("payload.market_summary"),
                      F.col("payload.weather_summary"), F.col("payload.rule_engine_result"))
    return p.select(
        fc["language"].alias("language"), fc["state"].alias("state"), fc["district"].alias("district"),
        fc["market"].alias("market"), fc["crop"].alias("crop"),
        fc["weather_location"].alias("weather_location"),
        ms["available"].alias("market_available"),
        d2s(ms["period_from"]).alias("period_from"), d2s(ms["period_to"]).alias("period_to"),
        r4(ms["latest_modal_price"]).alias("latest_modal_price"),
        r4(ms["seven_day_average_modal_price"]).alias("seven_day_average_modal_price"),
        r4(ms["day_over_day_change_percent"]).alias("day_over_day_change_percent"),
        F.size(ms["recent_prices"]).cast("long").alias("n_recent_prices"),
        ws["available"].alias("weather_available"), ws["message"].alias("weather_message"),
        ws["forecast_days"].cast("long").alias("forecast_days"),
        r4(ws["latitude"]).alias("latitude"), r4(ws["longitude"]).alias("longitude"),
        rr["recommended_decision"].alias("recommended_decision"), rr["market_signal"].alias("market_signal"),
        rr["weather_risk"]["heat_risk"].alias("heat_risk"), rr["weather_risk"]["cold_risk"].alias("cold_risk"),
        rr["weather_risk"]["rain_risk"].alias("rain_risk"),
        r4(rr["weather_risk"]["max_forecast_temp_c"]).alias("max_forecast_temp_c"),
        r4(rr["weather_risk"]["min_forecast_temp_c"]).alias("min_forecast_temp_c"),
        r4(rr["weather_risk"]["max_rain_probability_percent"]).alias("max_rain_probability_percent"),
        rr["crop_storage_signal"].alias("crop_storage_signal"),
        F.size(rr["facts_for_explanation"]).cast("long").alias("n_facts"),
        F.size(rr["reasons"]).cast("long").alias("n_reasons"))


def q_request_payload(spark, sf_dir):
    """I14 + I21: every field of the nested payload of every request, with both market messages and both weather
    states among them."""
    a = adv.advisory_for_requests(
        dt.prices_with_gaps(spark, sf_dir), dt.payload_requests(spark, sf_dir), dt.forecast_blocks(spark, sf_dir),
        driver_profile_table(spark), order=market.default_day_order(dt.ingest_order()))
    p = F.col("payload")
    fc, ms, ws, ck, rr = (p[c] for c in ("farmer_context", "market_summary", "weather_summary", "crop_knowledge",
                                         "rule_engine_result"))

    def number(c):
        return F.coalesce(F.format_string("%.4f", r4(c)), F.lit("none"))

    def prices(c):
        return F.array_join(F.transform(c, lambda r: F.concat_ws(
            "/", F.date_format(r["date"], "yyyy-MM-dd"), *[number(r[k]) for k in ("modal_price", "max_price", "min_price")])), ", ")

    days = F.array_join(F.transform(ws["daily_forecast"], lambda d: F.concat_ws(
        "/", d["date"], *[number(d[k]) for k in ("min_temp_c", "max_temp_c", "rain_probability_max_percent")],
        d["conditions"])), "; ")
    wr = rr["weather_risk"]
    return a.select(
        "req_id", *[fc[c].alias(f"farmer_{c}") for c in ("language", "state", "district", "market", "crop", "weather_location")],
        *[ms[c].alias(f"market_{c}") for c in ("available", "message", "source", "state", "district", "market", "crop",
                                               "price_unit", "trend")],
        d2s(ms["period"]["from"]).alias("period_from"), d2s(ms["period"]["to"]).alias("period_to"),
        d2s(ms["latest"]["date"]).alias("latest_date"),
        *[r4(ms["latest"][c]).alias(f"latest_{c}") for c in ("min_price", "max_price", "modal_price")],
        *[r4(ms[c]).alias(c) for c in ("seven_day_average_modal_price", "previous_day_modal_price",
                                       "day_over_day_change_percent", "seven_day_change_percent")],
        prices(ms["recent_modal_prices"]).alias("recent_modal_prices"), prices(ms["recent_prices"]).alias("recent_prices"),
        *[ws[c].alias(f"weather_{c}") for c in ("available", "message", "source", "location")],
        r4(ws["latitude"]).alias("latitude"), r4(ws["longitude"]).alias("longitude"), days.alias("daily_forecast"),
        *[ck[c].alias(c) for c in ("crop_name", "heat_sensitive", "rain_sensitive", "waterlogging_sensitive",
                                   "perishability", "sell_or_wait_bias")],
        r4(ck["critical_temp_max_c"]).alias("critical_temp_max_c"), r4(ck["critical_temp_min_c"]).alias("critical_temp_min_c"),
        ck["storage_life_days"].cast("long").alias("storage_life_days"),
        *[rr[c].alias(c) for c in ("recommended_decision", "market_signal", "crop_storage_signal")],
        *[wr[c].alias(c) for c in ("heat_risk", "cold_risk", "rain_risk")],
        *[r4(wr[c]).alias(c) for c in ("max_forecast_temp_c", "min_forecast_temp_c", "max_rain_probability_percent")],
        F.array_join(rr["facts_for_explanation"], " | ").alias("facts"), F.array_join(rr["reasons"], "; ").alias("reasons"))


def q_prompt_lines(spark, sf_dir):
    p = payload.compact_payload(_adv(spark, sf_dir), F.lit(LANGUAGE))
    lang = F.lit(LANGUAGE)
    return p.select(*SERIES, payload.prompt_text(F.col("fast")).alias("prompt"),
                    payload.system_prompt(lang).alias("system_prompt"),
                    payload.user_prompt(lang, F.col("fast")).alias("user_prompt"))


def advisory_requests(spark, sf_dir) -> DataFrame:
    """request fields with the advisory defaults ('' takes the default)."""
    r = adv.with_request_defaults(dt.farmer_requests(spark, sf_dir))
    return r.select("req_id", F.col("crop").alias("commodity"), "state", "district", "market",
                    "language", "latitude", "longitude")


def q_fallback_advisory(spark, sf_dir):
    req = advisory_requests(spark, sf_dir)
    s = adv.series_summary(spark, sf_dir).select(*SERIES, "trend", "seven_day_change_percent",
                                                  "latest_modal_price")
    j = req.join(s, SERIES, "left")
    return j.select("req_id", payload.fallback_advisory("commodity", "market", "trend",
                                                        "seven_day_change_percent",
                                                        "latest_modal_price").alias("advisory"))


def q_market_payload_default(spark, sf_dir):
    req = advisory_requests(spark, sf_dir)
    order = F.struct(F.col("variety"), F.col("grade"), dt.ingest_order())
    latest = history.latest_row(dt.prices(spark, sf_dir), order).select(
        *SERIES, F.col("modal_price").alias("l_modal"), F.col("max_price").alias("l_max"),
        F.col("min_price").alias("l_min"))
    j = req.join(latest, SERIES, "left")
    cols = payload.market_card("market", "l_modal", "l_max", "l_min")
    out = j.select("req_id", *cols)
    return out.select("req_id", "market_name", "current_price", r4("modal_price").alias("modal_price"),
                      r4("max_price").alias("max_price"), r4("min_price").alias("min_price"))


# Openings put before the documents' texts, which hold no markdown of their
# own: list markers with Telugu and Devanagari digits, wide and no-break spaces.
OPENINGS = ["", "\u0967. ", "\u0c67\u0c68.\u00a0", "\u00a0-\u3000", "\u2003## **A**\u00a0\u00a0b\u2009\n1. [c](d) `e`\n"]


def _marked_texts(spark, sf_dir):
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), (F.col("doc_id") % len(OPENINGS) + 1).cast("int"))
    return dt.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(opening, "text").alias("text"), "lang")


def q_text_clean(spark, sf_dir):
    d = _marked_texts(spark, sf_dir)
    code = language_code(F.col("lang"))
    return d.select("doc_id", code.alias("lang_code"),
                    clean_text_for_speech(F.col("text"), code).alias("clean_text"))


# Language names and tags a request may carry (fixed test values).
LANGUAGE_NAMES = ["Telugu", "te-IN", "Hindi", "hi", "Tamil", "ta-IN", "English", "en-US",
                  "Malayalam", "TELUGU (India)", "te", "Kannada"]


def q_text_script_filter(spark, sf_dir):
    d = _marked_texts(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(n) for n in LANGUAGE_NAMES]),
                        (F.col("doc_id") % len(LANGUAGE_NAMES) + 1).cast("int"))
    code = language_code(name)
    return d.select("doc_id", name.alias("language_name"), code.alias("lang_code"),
                    clean_text_for_speech(F.col("text"), code).alias("clean_text"))


def q_infer_decision(spark, sf_dir):
    d = dt.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = dt.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id", "left")
    risk = F.when(F.col("toxic") == 1, F.lit("High")).otherwise(F.lit(K.DEFAULT_RISK))
    trend = (F.when(F.col("lang") == "en", F.lit("Increasing"))
             .when(F.col("lang") == "fr", F.lit("Decreasing")).otherwise(F.lit(K.DEFAULT_TREND)))
    return j.select("doc_id", risk.alias("risk_level"), trend.alias("trend"),
                    K.infer_decision(risk, trend, F.col("text")).alias("decision"))


def q_advisory_normalise(spark, sf_dir):
    a = _adv(spark, sf_dir)
    modal = parse_number_lenient(plain_double_text("latest_modal_price"), K.DEFAULT_VIEW_MODAL)
    high = parse_number_lenient(plain_double_text("latest_max_price"), modal * F.lit(K.HIGH_FACTOR))
    low = parse_number_lenient(plain_double_text("latest_min_price"), modal * F.lit(K.LOW_FACTOR))
    rainfall = F.when(F.coalesce("weather_available", F.lit(False)),
                      F.concat(round_half_even("rule_max_rain_percent", 0).cast("long").cast("string"), F.lit("%")))
    trend = F.coalesce(F.when(F.col("market_signal") == "rising", F.lit("Increasing"))
                       .when(F.col("market_signal") == "falling", F.lit("Decreasing"))
                       .when(F.col("market_signal") == "stable", F.lit("Stable")), F.lit(K.DEFAULT_TREND))
    risk = F.when(F.col("heat_risk") | F.col("cold_risk") | F.col("rain_risk"), F.lit("High")) \
        .otherwise(F.lit(K.DEFAULT_RISK))
    text = payload.fallback_advisory("commodity", "market", "trend", "seven_day_change_percent",
                                     "latest_modal_price")
    reasons = F.concat_ws(" ",
                          F.format_string(K.REASON_TREND, F.coalesce(K.first_non_empty("commodity"), F.lit("Crop")),
                                          F.lower(trend),
                                          F.coalesce(K.first_non_empty("market"), F.lit("your selected market")),
                                          F.coalesce(K.first_non_empty("district"), F.lit("your district"))),
                          F.format_string(K.REASON_WEATHER, F.coalesce(rainfall, F.lit("low rainfall"))),
                          F.lit(K.REASON_MARKET))
    out = a.select(*SERIES, modal.alias("mv"), high.alias("hv"), low.alias("lv"), rainfall.alias("rainfall"),
                   trend.alias("trend_view"), risk.alias("risk_level"), text.alias("rec"), reasons.alias("reasons"))
    return out.select(*SERIES, K.price_label("mv").alias("modal_label"), K.price_label("hv").alias("highest_label"),
                      K.price_label("lv").alias("lowest_label"), r4("mv").alias("modal_value"),
                      r4("hv").alias("highest_value"), r4("lv").alias("lowest_value"),
                      F.coalesce("rainfall", F.lit("—")).alias("rainfall"),
                      K.rain_class(F.col("rainfall")).alias("condition"),
                      F.col("trend_view").alias("trend"), "risk_level",
                      K.infer_decision(F.col("risk_level"), F.col("trend_view"), F.col("rec")).alias("decision"),
                      "reasons")


def q_price_band_position(spark, sf_dir):
    order = F.struct(F.col("variety"), F.col("grade"), dt.ingest_order())
    latest = history.latest_row(dt.prices(spark, sf_dir), order)
    return latest.select(*SERIES, r4("min_price").alias("low"), r4("modal_price").alias("modal"),
                         r4("max_price").alias("high"),
                         r4(K.band_position("min_price", "modal_price", "max_price")).alias("position"))


# Interface labels for four keys in the four interface languages.
UI_LABELS = [
    ("English", "weather", "Today's Weather"), ("English", "marketPrice", "Market Price"),
    ("English", "farmerDetails", "Farmer Details"), ("English", "getAdvisory", "Get AI Advisory"),
    ("Tamil", "weather", "இன்றைய வானிலை"), ("Tamil", "marketPrice", "சந்தை விலை"),
    ("Tamil", "farmerDetails", "விவசாயி விவரங்கள்"), ("Tamil", "getAdvisory", "AI ஆலோசனை பெறவும்"),
    ("Hindi", "weather", "आज का मौसम"), ("Hindi", "marketPrice", "बाज़ार भाव"),
    ("Hindi", "farmerDetails", "किसान विवरण"), ("Hindi", "getAdvisory", "AI सलाह प्राप्त करें"),
    ("Telugu", "weather", "నేటి వాతావరణం"), ("Telugu", "marketPrice", "మార్కెట్ ధర"),
    ("Telugu", "farmerDetails", "రైతు వివరాలు"), ("Telugu", "getAdvisory", "AI సలహా పొందండి"),
]
VIEW_LANGUAGES = ["English", "Hindi", "Telugu", "Tamil", "Marathi"]
EVENT_LABEL_KEY = [("view", "weather"), ("click", "marketPrice"), ("purchase", "getAdvisory"),
                   ("signup", "farmerDetails")]


def q_translate_labels(spark, sf_dir):
    ev = dt.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    lang = F.element_at(F.array(*[F.lit(x) for x in VIEW_LANGUAGES]),
                        (F.col("user_id") % len(VIEW_LANGUAGES) + 1).cast("int"))
    key = F.col("event_type")
    for ev_type, k in reversed(EVENT_LABEL_KEY):
        key = F.when(F.col("event_type") == ev_type, F.lit(k)).otherwise(key)
    base = ev.select("event_id", lang.alias("language"), key.alias("key"))
    return view.translated(base, read_labels(spark, land_labels(spark))).select("event_id", "language", "key", "label")


def land_labels(spark) -> str:
    """The labels as the interface ships them: one JSON object {language: {key: text}}."""
    path = scratch_path(spark, f"labels-{uuid.uuid4().hex}")
    doc: dict = {}
    for language, key, text in UI_LABELS:
        doc.setdefault(language, {})[key] = text
    spark.createDataFrame([(json.dumps(doc, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return path


def q_advisory_view(spark, sf_dir):
    """K4: raw advisories as the service would answer them, one JSON text per order, with every part missing now and
    then, parsed and made ready to show."""
    o = dt.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    k = F.col("o_orderkey")

    def now_and_then(n: int, value):
        return F.when(k % n != 0, value)

    price = F.concat(F.lit("₹"), cents_text("o_totalprice"), F.lit(" / Quintal"))
    raw = F.struct(
        now_and_then(11, F.struct(now_and_then(2, F.lit("31°C")).alias("temperature"), now_and_then(3, F.lit("70%")).alias("humidity"),
                                  now_and_then(4, F.concat((k % 97).cast("string"), F.lit("%"))).alias("rainfall"),
                                  now_and_then(5, F.lit("8 km/h")).alias("wind_speed"))).alias("weather"),
        now_and_then(7, F.struct(
            F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("Mandi "), (k % 50).cast("string"))).alias("market_name"),
            now_and_then(4, price).alias("modal_price"), now_and_then(3, price).alias("current_price"),
            now_and_then(5, cents_text(F.col("o_totalprice") * 2.0)).alias("max_price"),
            now_and_then(6, cents_text(F.col("o_totalprice") * 0.5)).alias("min_price"),
            F.when(k % 9 == 0, F.lit("")).when(k % 9 < 4, F.lit("Increasing")).when(k % 9 < 6, F.lit("Decreasing")).alias("trend"),
            now_and_then(8, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("arrival_date"))).alias("market"),
        now_and_then(13, F.struct(now_and_then(2, F.lit("Cut early")).alias("harvest_tip"), now_and_then(3, F.lit("")).alias("storage_tip"),
                                  now_and_then(5, F.lit("Now")).alias("best_selling_period"),
                                  F.lit(None).cast("string").alias("fertilizer_advice"),
                                  now_and_then(7, F.lit("Low")).alias("water_requirement"))).alias("crop"),
        F.when(k % 5 == 0, F.lit("Sell now")).when(k % 5 == 1, F.lit("Better wait")).when(k % 5 == 2, F.lit("No advice")).alias("recommendation"),
        F.when(k % 6 == 1, F.array(F.lit("own reason"), F.lit("second"))).alias("reasons"),
        F.when(k % 4 == 1, (k % 100).cast("int")).alias("confidence"),
        F.when(k % 3 == 1, F.lit("High")).when(k % 3 == 2, F.lit("Low")).alias("risk_level"),
        F.when(k % 10 == 1, F.lit("UklGRg==")).alias("audio_base64"))
    texts = o.select("o_orderkey", now_and_then(17, F.to_json(raw)).alias("answer"),
                     F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("Onion")).alias("form_crop"),
                     F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("Town")).alias("form_market"),
                     F.when(k % 6 == 1, F.lit("North")).alias("form_district"))
    parsed = texts.withColumn("raw", F.from_json("answer", view.RAW_ADVISORY))
    v = F.col("view")
    weather, market_, crop = v["weather"], v["market"], v["crop"]
    return view.advisory_view(parsed, F.lit("2026-07-08").cast("date")).select(
        "o_orderkey", *[weather[c].alias(c) for c in ("temperature", "humidity", "rainfall", "wind_speed", "condition")],
        *[market_[c].alias(c) for c in ("market_name", "modal_price", "highest_price", "lowest_price", "arrival_date", "trend")],
        *[r4(market_[c]).alias(c) for c in ("modal_price_value", "highest_price_value", "lowest_price_value")],
        *[crop[c].alias(c) for c in view.CROP_TIPS], v["recommendation"].alias("recommendation"),
        F.array_join(v["reasons"], " | ").alias("reasons"), v["confidence"].cast("long").alias("confidence"),
        *[v[c].alias(c) for c in ("risk_level", "decision", "audio_base64")])


def q_place_label(spark, sf_dir):
    c = dt.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = dt.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = dt.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey))
    j = c.join(geo, c.c_nationkey == geo.n_nationkey)
    k = F.col("c_custkey")
    village = K.first_non_empty(
        F.when(k % 4 == 0, F.col("c_name")).otherwise(F.lit("")),
        F.when(k % 4 == 1, F.concat(F.lit("Hamlet "), k.cast("string"))),
        F.lit(None).cast("string"),
        F.when(k % 4 == 2, F.col("c_mktsegment")).otherwise(F.lit("")))
    mandal = K.first_non_empty(F.when(k % 3 == 0, F.col("n_name")).otherwise(F.lit("")),
                               F.when(k % 3 == 1, F.col("r_name")), F.lit(""))
    display = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Place "), k.cast("string")))
    return j.select("c_custkey", F.coalesce(village, F.lit("")).alias("village"),
                    F.coalesce(mandal, F.lit("")).alias("mandal"), F.col("r_name").alias("state"),
                    K.place_label(F.coalesce(village, F.lit("")), F.coalesce(mandal, F.lit("")), display).alias("label"))


QUERIES = {
    "compact_payload": q_compact_payload,
    "full_payload_fields": q_full_payload_fields,
    "request_payload": q_request_payload,
    "prompt_lines": q_prompt_lines,
    "fallback_advisory": q_fallback_advisory,
    "market_payload_default": q_market_payload_default,
    "text_clean": q_text_clean,
    "text_script_filter": q_text_script_filter,
    "infer_decision": q_infer_decision,
    "advisory_normalise": q_advisory_normalise,
    "price_band_position": q_price_band_position,
    "translate_labels": q_translate_labels,
    "advisory_view": q_advisory_view,
    "place_label": q_place_label,
}

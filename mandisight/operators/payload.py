"""Advisory payloads and texts (I14-I21) as columns of the advisory table.

The reference renders these with Python f-strings; the helpers below give
Python's text for each value type (``None``, ``True``, ``1234.0``, quoted
strings, lists) so the prompt text equals what it would send.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_even, plain_double_text
from ..functions.rules import fmt0

# The LLM prompt templates ({assistant}, {language}, {payload})
# and the template advisory used when the model is unavailable. The
# assistant's display name is a deployment setting.
ASSISTANT_NAME = "the market advisor"
SYSTEM_PROMPT = """
    You are {assistant}, an agricultural advisory assistant.

    Always respond only in {language}.
    Always format your response using Markdown.
    Use only the verified context provided.
    Do not invent facts.
    Do not predict future prices.
    The recommended_decision is authoritative and must not be changed.
    """
USER_PROMPT = """
    Write the farmer advisory in **{language}** language using **Markdown**.

    Use this exact format:

    ## Recommendation

    (One short paragraph)

    ## Why
    - Reason 1
    - Reason 2
    - Reason 3

    ## Actions
    1. Action 1
    2. Action 2
    3. Action 3

    ## Caution

    One short caution.

    Rules:
    - Use Markdown only.
    - Do not return HTML.
    - Do not return JSON.
    - Keep the response under 150 words.
    - Use only the verified context below.

    VERIFIED CONTEXT:
    {payload}

    """
FALLBACK_ADVISORY = (
    "Based on the latest mandi data for {commodity} in {market}, the trend is {trend} "
    "with a change of {change} over the last 7 days. The current modal price is around {price}. "
    "For now, monitor the local market closely and sell when the price is favourable while "
    "keeping crop quality and transport timing in mind.")
NO_CHANGE_LABEL = "recently"
NO_PRICE_LABEL = "current local mandi price"
# Market card defaults when a request has no price history.
DEFAULT_MODAL, DEFAULT_MAX, DEFAULT_MIN = 2200.0, 2350.0, 2050.0
CURRENT_PRICE = "₹%s / Quintal"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fill(template: str, **cols: Column) -> Column:
    """Substitute ``{name}`` placeholders with columns (no format parsing)."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(cols[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*parts)


def py_float(x) -> Column:
    """Python ``str(float)``; NULL -> ``None``."""
    return F.coalesce(plain_double_text(x), F.lit("None"))


def py_number(x) -> Column:
    """A JSON number as Python prints it: integral values without ``.0``."""
    v = _c(x).cast("double")
    return F.coalesce(F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(plain_double_text(v)),
                      F.lit("None"))


def py_bool(x) -> Column:
    return (F.when(_c(x).isNull(), F.lit("None"))
            .when(_c(x), F.lit("True")).otherwise(F.lit("False")))


def py_str(x) -> Column:
    """Python ``repr`` of a text: single quotes unless it holds one and no double quote; backslashes, line ends,
    tabs and, where both quotes occur, single quotes are escaped."""
    s = _c(x)
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(shown))
    return (F.when(s.isNull(), F.lit("None"))
            .when(s.contains("'") & ~s.contains('"'), F.concat(F.lit('"'), s, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def py_str_list(arr) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_c(arr), py_str), ", "), F.lit("]"))


def compact_payload(adv: DataFrame, language: Column | str = "language") -> DataFrame:
    """I15 + I3: the 15-key payload, rounded as the reference rounds."""
    return adv.select(
        "*",
        F.struct(
            _c(language).alias("lang"),
            F.col("commodity").alias("crop"), F.col("market").alias("market"),
            F.col("district").alias("district"),
            F.col("recommended_decision").alias("decision"),
            round_half_even("latest_modal_price", 0).alias("price"),
            round_half_even("seven_day_change_percent", 1).alias("chg7d_pct"),
            F.col("trend").alias("trend"),
            round_half_even("rule_max_temp_c", 0).alias("max_temp_c"),
            F.col("heat_risk").alias("heat_risk"), F.col("rain_risk").alias("rain_risk"),
            F.col("perishability").alias("perishable"),
            F.col("storage_life_days").alias("storage_days"),
            F.col("critical_temp_max_c").alias("crit_temp_c"),
            F.col("reasons").alias("reasons"),
        ).alias("fast"))


def full_payload(adv: DataFrame, language: Column | str = "language") -> DataFrame:
    """Nested payload (farmer context, market, weather, rules)."""
    return adv.select(
        "*",
        F.struct(
            F.struct(_c(language).alias("language"), "state", "district", "market",
                     F.col("commodity").alias("crop"),
                     F.col("location").alias("weather_location")).alias("farmer_context"),
            F.struct("available", "period_from", "period_to", "latest_date", "latest_min_price",
                     "latest_max_price", "latest_modal_price", "seven_day_average_modal_price",
                     "previous_day_modal_price", "day_over_day_change_percent",
                     "seven_day_change_percent", "trend", "recent_prices").alias("market_summary"),
            F.struct(F.coalesce("weather_available", F.lit(False)).alias("available"),
                     "message", "location", "latitude", "longitude",
                     "forecast_days").alias("weather_summary"),
            F.struct("recommended_decision", "market_signal",
                     F.struct("heat_risk", "cold_risk", "rain_risk",
                              F.col("rule_max_temp_c").alias("max_forecast_temp_c"),
                              F.col("rule_min_temp_c").alias("min_forecast_temp_c"),
                              F.col("rule_max_rain_percent").alias("max_rain_probability_percent"))
                     .alias("weather_risk"),
                     "crop_storage_signal", "facts_for_explanation", "reasons").alias("rule_engine_result"),
        ).alias("payload"))


# The sources that a payload names.
MARKET_SOURCE, WEATHER_SOURCE = "AGMARKNET / OGD India", "OpenWeather forecast"


def nested_payload(adv: DataFrame, profile: Sequence[str], language: Column | str = "language") -> DataFrame:
    """I14 whole: the payload that the model is given, with the forecast days and the crop's profile.

    ``adv``: rows of the rule engine with ``market_message`` and ``daily_forecast``; ``profile``: the columns of the
    crop knowledge. Without a market summary its block holds ``available`` and ``message`` alone, and the farmer's
    place and crop, which are read from it, are NULL; likewise the weather block.
    """
    has = F.coalesce(F.col("available"), F.lit(False))
    fair = F.coalesce(F.col("weather_available"), F.lit(False))

    def known(c: str, name: str | None = None) -> Column:
        return F.when(has, F.col(c)).alias(name or c)

    prices = F.when(has, F.transform("recent_prices", lambda r: F.struct(
        r["date"].alias("date"), r["modal_price"].alias("modal_price"), r["max_price"].alias("max_price"),
        r["min_price"].alias("min_price"))))
    market = F.struct(
        has.alias("available"), F.col("market_message").alias("message"),
        F.when(has, F.lit(MARKET_SOURCE)).alias("source"), known("state"), known("district"), known("market"),
        known("commodity", "crop"), known("price_unit"),
        F.when(has, F.struct(F.col("period_from").alias("from"), F.col("period_to").alias("to"))).alias("period"),
        F.when(has, F.struct(F.col("latest_date").alias("date"), F.col("latest_min_price").alias("min_price"),
                             F.col("latest_max_price").alias("max_price"),
                             F.col("latest_modal_price").alias("modal_price"))).alias("latest"),
        *[known(c) for c in ("seven_day_average_modal_price", "previous_day_modal_price",
                             "day_over_day_change_percent", "seven_day_change_percent", "trend")],
        prices.alias("recent_modal_prices"), prices.alias("recent_prices"))
    weather = F.struct(
        fair.alias("available"), F.col("message"), F.when(fair, F.lit(WEATHER_SOURCE)).alias("source"),
        *[F.when(fair, F.col(c)).alias(c) for c in ("location", "latitude", "longitude", "daily_forecast")])
    risk = F.struct("heat_risk", "cold_risk", "rain_risk", F.col("rule_max_temp_c").alias("max_forecast_temp_c"),
                    F.col("rule_min_temp_c").alias("min_forecast_temp_c"),
                    F.col("rule_max_rain_percent").alias("max_rain_probability_percent"))
    farmer = F.struct(_c(language).alias("language"), known("state"), known("district"), known("market"),
                      known("commodity", "crop"), F.when(fair, F.col("location")).alias("weather_location"))
    return adv.select("*", F.struct(
        farmer.alias("farmer_context"), market.alias("market_summary"), weather.alias("weather_summary"),
        F.struct(*profile).alias("crop_knowledge"),
        F.struct("recommended_decision", "market_signal", risk.alias("weather_risk"), "crop_storage_signal",
                 "facts_for_explanation", "reasons").alias("rule_engine_result")).alias("payload"))


def prompt_text(fast: Column) -> Column:
    """I16: the six-line context text built from the compact payload."""
    f = fast
    return F.concat(
        F.lit("Crop:"), F.coalesce(f["crop"], F.lit("None")), F.lit(" Market:"),
        F.coalesce(f["market"], F.lit("None")), F.lit(","), F.coalesce(f["district"], F.lit("None")),
        F.lit(" Lang:"), F.coalesce(f["lang"], F.lit("None")),
        F.lit("\nPrice:"), py_float(f["price"]), F.lit("/quintal Chg7d:"), py_float(f["chg7d_pct"]),
        F.lit("% Trend:"), F.coalesce(f["trend"], F.lit("None")),
        F.lit("\nMaxTemp:"), py_float(f["max_temp_c"]), F.lit("C HeatRisk:"), py_bool(f["heat_risk"]),
        F.lit(" RainRisk:"), py_bool(f["rain_risk"]),
        F.lit("\nPerishable:"), F.coalesce(f["perishable"], F.lit("None")),
        F.lit(" StorageDays:"), F.coalesce(f["storage_days"].cast("string"), F.lit("None")),
        F.lit(" CritTemp:"), py_number(f["crit_temp_c"]),
        F.lit("\nReasons:"), F.array_join(f["reasons"], "; "),
        F.lit("\nDecision so far:"), F.coalesce(f["decision"], F.lit("None")))


def payload_repr(fast: Column) -> Column:
    """The compact payload as Python prints the dict."""
    f = fast
    items = [("lang", py_str(f["lang"])), ("crop", py_str(f["crop"])), ("market", py_str(f["market"])),
             ("district", py_str(f["district"])), ("decision", py_str(f["decision"])),
             ("price", py_float(f["price"])), ("chg7d_pct", py_float(f["chg7d_pct"])),
             ("trend", py_str(f["trend"])), ("max_temp_c", py_float(f["max_temp_c"])),
             ("heat_risk", py_bool(f["heat_risk"])), ("rain_risk", py_bool(f["rain_risk"])),
             ("perishable", py_str(f["perishable"])),
             ("storage_days", F.coalesce(f["storage_days"].cast("string"), F.lit("None"))),
             ("crit_temp_c", py_number(f["crit_temp_c"])), ("reasons", py_str_list(f["reasons"]))]
    parts: list[Column] = [F.lit("{")]
    for i, (k, v) in enumerate(items):
        parts += [F.lit(("" if i == 0 else ", ") + f"'{k}': "), v]
    parts.append(F.lit("}"))
    return F.concat(*parts)


def system_prompt(language: Column, assistant: str = ASSISTANT_NAME) -> Column:
    """System message for the requested language."""
    return _fill(SYSTEM_PROMPT, assistant=F.lit(assistant), language=language)


def user_prompt(language: Column, fast: Column) -> Column:
    """User message with the payload embedded as verified context."""
    return _fill(USER_PROMPT, language=language, payload=payload_repr(fast))


def fallback_advisory(commodity, market, trend, change, latest_price) -> Column:
    """Template advisory; NULL change/price get their labels."""
    ch = F.coalesce(F.when(_c(change).isNotNull(), F.concat(
        F.format_string("%+.1f", round_half_even(_c(change), 1)), F.lit("%"))), F.lit(NO_CHANGE_LABEL))
    pr = F.coalesce(F.concat(F.lit("₹"), fmt0(latest_price), F.lit("/quintal")), F.lit(NO_PRICE_LABEL))
    return _fill(FALLBACK_ADVISORY, commodity=_c(commodity), market=_c(market),
                 trend=F.coalesce(_c(trend), F.lit("stable")), change=ch, price=pr)


def market_card(market_name, latest_modal, latest_max, latest_min) -> list[Column]:
    """Market card with default prices when no history row exists."""
    has = _c(latest_modal).isNotNull()
    return [
        _c(market_name).alias("market_name"),
        F.when(has, F.format_string(CURRENT_PRICE, _c(latest_modal).cast("string")))
        .otherwise(F.format_string(CURRENT_PRICE, F.lit("2200"))).alias("current_price"),
        F.when(has, _c(latest_modal)).otherwise(F.lit(DEFAULT_MODAL)).alias("modal_price"),
        F.when(has, _c(latest_max)).otherwise(F.lit(DEFAULT_MAX)).alias("max_price"),
        F.when(has, _c(latest_min)).otherwise(F.lit(DEFAULT_MIN)).alias("min_price"),
    ]

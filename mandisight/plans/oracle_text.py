"""DuckDB oracle SQL for the payload, text and presentation queries."""

from __future__ import annotations

from ..operators.payload import ASSISTANT_NAME, FALLBACK_ADVISORY, SYSTEM_PROMPT, USER_PROMPT
from .sqlrules import RULE_CTES, RULES0, fmt0
from .sqltext import LATEST_ROW, MARKET_DIM, PRICES, REQUESTS, SERIES, _cycle, cents_text, dstr, r4, rhe, with_ctes



def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def py_float(x: str) -> str:
    return f"coalesce(CAST(CAST({x} AS DOUBLE) AS VARCHAR), 'None')"


def py_number(x: str) -> str:
    return (f"coalesce(CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) "
            f"ELSE CAST(CAST({x} AS DOUBLE) AS VARCHAR) END, 'None')")


def py_bool(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'None' WHEN {x} THEN 'True' ELSE 'False' END)"


def py_str(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'None' WHEN contains({x}, '''') AND NOT contains({x}, '\"') "
            f"THEN '\"' || {x} || '\"' ELSE '''' || {x} || '''' END)")


def fill(template: str, **parts: str) -> str:
    out, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(lit(rest))
            break
        j = rest.index("}", i)
        if i:
            out.append(lit(rest[:i]))
        out.append(f"({parts[rest[i + 1:j]]})")
        rest = rest[j + 1:]
    return "(" + " || ".join(out) + ")"


LANG = "'Telugu'"
FAST = f"""
SELECT {SERIES}, {LANG} AS lang, recommended_decision AS decision, {rhe('latest_modal_price', 0)} AS price,
  {rhe('seven_day_change_percent', 1)} AS chg7d_pct, trend, {rhe('rule_max_temp_c', 0)} AS max_temp_c,
  heat_risk, rain_risk, perishability AS perishable, storage_life_days AS storage_days,
  critical_temp_max_c AS crit_temp_c, reasons_list AS reasons
FROM rules"""


def _compact_payload() -> str:
    return with_ctes(*RULE_CTES, ("fast", FAST), body=f"""
SELECT {SERIES}, lang, decision, {r4('price')} AS price, {r4('chg7d_pct')} AS chg7d_pct, trend,
  {r4('max_temp_c')} AS max_temp_c, heat_risk, rain_risk, perishable, CAST(storage_days AS BIGINT) AS storage_days,
  {r4('crit_temp_c')} AS crit_temp_c, array_to_string(reasons, '; ') AS reasons
FROM fast""")


def _full_payload_fields() -> str:
    return with_ctes(*RULE_CTES, body=f"""
SELECT {LANG} AS language, state, district, market, commodity AS crop, weather_location,
  TRUE AS market_available, {dstr('period_from')} AS period_from, {dstr('period_to')} AS period_to,
  {r4('latest_modal_price')} AS latest_modal_price,
  {r4('seven_day_average_modal_price')} AS seven_day_average_modal_price,
  {r4('day_over_day_change_percent')} AS day_over_day_change_percent,
  CAST(n_days AS BIGINT) AS n_recent_prices,
  coalesce(weather_available, FALSE) AS weather_available, weather_message,
  CAST(weather_days AS BIGINT) AS forecast_days,
  {r4('weather_latitude')} AS latitude, {r4('weather_longitude')} AS longitude,
  recommended_decision, market_signal, heat_risk, cold_risk, rain_risk,
  {r4('rule_max_temp_c')} AS max_forecast_temp_c, {r4('rule_min_temp_c')} AS min_forecast_temp_c,
  {r4('rule_max_rain_percent')} AS max_rain_probability_percent, crop_storage_signal,
  CAST(len(facts_list) AS BIGINT) AS n_facts, CAST(len(reasons_list) AS BIGINT) AS n_reasons
FROM rules""")


def _advisory_view() -> str:
    def then(n: int, value: str) -> str:
        return f"CASE WHEN k % {n} <> 0 THEN {value} END"

    def inner(n: int, m: int, value: str) -> str:
        return f"CASE WHEN k % {n} <> 0 AND k % {m} <> 0 THEN {value} END"

    price = f"'₹' || {cents_text('p')} || ' / Quintal'"
    raw = f"""
SELECT o_orderkey, o_orderkey AS k, o_totalprice AS p, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"""
    parts = f"""
SELECT o_orderkey, k, {inner(11, 2, "'31°C'")} AS temperature, {inner(11, 3, "'70%'")} AS humidity,
  {inner(11, 4, "CAST(k % 97 AS VARCHAR) || '%'")} AS rainfall, {inner(11, 5, "'8 km/h'")} AS wind,
  {then(7, "CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'Mandi ' || CAST(k % 50 AS VARCHAR) END")} AS name,
  {inner(7, 4, price)} AS modal, {inner(7, 3, price)} AS current, {inner(7, 5, cents_text('(p * 2.0::DOUBLE)'))} AS high,
  {inner(7, 6, cents_text('(p * 0.5::DOUBLE)'))} AS low,
  {then(7, "CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 < 4 THEN 'Increasing' WHEN k % 9 < 6 THEN 'Decreasing' END")} AS trend,
  {inner(7, 8, 'day')} AS arrival, {inner(13, 2, "'Cut early'")} AS harvest, {inner(13, 3, "''")} AS storage,
  {inner(13, 5, "'Now'")} AS best, {inner(13, 7, "'Low'")} AS water,
  CASE WHEN k % 5 = 0 THEN 'Sell now' WHEN k % 5 = 1 THEN 'Better wait' WHEN k % 5 = 2 THEN 'No advice' END AS advice,
  CASE WHEN k % 3 = 1 THEN 'High' WHEN k % 3 = 2 THEN 'Low' END AS risk,
  CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN 'Onion' END AS form_crop,
  CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN 'Town' END AS form_market,
  CASE WHEN k % 6 = 1 THEN 'North' END AS form_district
FROM raw"""

    def number(text: str, fallback: str) -> str:
        # The texts here hold digits, commas, one dot, marks and words.
        return f"coalesce(TRY_CAST(nullif(regexp_replace({text}, '[^0-9.]', '', 'g'), '') AS DOUBLE), {fallback})"

    modal = number("coalesce(modal, current)", "2200.0::DOUBLE")
    numbers = f"""
SELECT *, {number('high', 'm * 1.08::DOUBLE')} AS h, {number('low', 'm * 0.9::DOUBLE')} AS l, {number('rainfall', '0.0::DOUBLE')} AS rain,
  coalesce(trend, 'Stable') AS tr, coalesce(risk, 'Low') AS rk, lower(coalesce(advice, '')) AS cue
FROM (SELECT *, {modal} AS m FROM parts)"""

    def label(x: str) -> str:
        return f"'₹' || CAST(CAST(floor({x} + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)"

    shown = {
        "temperature": "coalesce(temperature, '—')", "humidity": "coalesce(humidity, '—')", "rainfall": "coalesce(rainfall, '—')",
        "wind_speed": "coalesce(wind, '12 km/h')",
        "condition": "CASE WHEN rain >= 50 THEN 'rainy' WHEN rain >= 20 THEN 'cloudy' ELSE 'sunny' END",
        "market_name": "coalesce(nullif(name, ''), nullif(form_market, ''), 'Nearest Mandi')",
        "modal_price": label("m"), "highest_price": label("h"), "lowest_price": label("l"),
        "arrival_date": "coalesce(arrival, '2026-07-08')", "trend": "tr",
        "modal_price_value": r4("m"), "highest_price_value": r4("h"), "lowest_price_value": r4("l"),
        "harvest_tip": "coalesce(harvest, 'Harvest when grains reach full maturity.')",
        "storage_tip": "coalesce(storage, 'Store in a cool, dry, ventilated space.')",
        "best_selling_period": "coalesce(best, 'Within the next 2 weeks')",
        "fertilizer_advice": "'Apply balanced NPK as per soil test results.'",
        "water_requirement": "coalesce(water, 'Moderate — irrigate every 5-7 days.')",
        "recommendation": "coalesce(advice, 'Recommendation unavailable right now.')",
        "reasons": "CASE WHEN k % 6 = 1 THEN 'own reason | second' ELSE coalesce(nullif(form_crop, ''), 'Crop') || "
                   "' prices are trending ' || lower(coalesce(nullif(trend, ''), tr)) || ' at ' || "
                   "coalesce(nullif(form_market, ''), 'your selected market') || ' in ' || coalesce(form_district, 'your district') || "
                   "'. | Weather conditions (' || coalesce(rainfall, 'low rainfall') || ') should be considered before selling. | "
                   "Market prices are based on the selected market.' END",
        "confidence": "CASE WHEN k % 4 = 1 THEN k % 100 ELSE 82 END", "risk_level": "rk",
        "decision": "CASE WHEN cue LIKE '%sell%' THEN 'sell' WHEN cue LIKE '%wait%' THEN 'wait' WHEN cue LIKE '%hold%' THEN 'hold' "
                    "WHEN rk = 'High' THEN 'wait' WHEN tr = 'Increasing' THEN 'sell' WHEN tr = 'Decreasing' THEN 'wait' ELSE 'hold' END",
        "audio_base64": "CASE WHEN k % 10 = 1 THEN 'UklGRg==' END"}
    columns = ", ".join(f"CASE WHEN k % 17 <> 0 THEN {v} END AS {c}" for c, v in shown.items())
    return with_ctes(("raw", raw), ("parts", parts), ("numbers", numbers), body=f"SELECT o_orderkey, {columns} FROM numbers")


def _request_payload() -> str:
    gaps = "SELECT * REPLACE (CASE WHEN location_id % 9 <> 4 THEN modal_price END AS modal_price) FROM prices0"
    req = f"""
SELECT s_suppkey AS req_id, state, district, CASE WHEN s_suppkey % 10 = 7 THEN 'Nowhere' ELSE market END AS market,
  ([{_cycle}])[CAST(s_suppkey % 6 + 1 AS INTEGER)] AS commodity, s_suppkey AS location_id FROM ({MARKET_DIM})"""
    on = " AND ".join(f"r.{c} = s.{c}" for c in SERIES.split(", "))
    rules0 = RULES0.replace("SELECT s.*,", f"SELECT r.req_id, r.state AS r_state, r.district AS r_district, r.market AS r_market, "
                            "r.commodity, s.* EXCLUDE (state, district, market, commodity, location_id),") \
        .replace("s.commodity", "r.commodity") \
        .replace("FROM summary s LEFT JOIN horizon h ON s.location_id", f"FROM req r LEFT JOIN summary s ON {on} LEFT JOIN horizon h ON r.location_id") \
        .replace("h.n_days AS weather_days,", "h.n_days AS weather_days, h.location_id AS weather_id,")
    ctes = [("prices0", PRICES), ("prices", gaps), *[c for c in RULE_CTES if c[0] != "prices"]]
    at = [n for n, _ in ctes].index("rules0")
    ctes[at:at + 1] = [("req", req), ("rules0", rules0)]
    item = "strftime(CAST(arrival_date AS DATE), '%Y-%m-%d')" + "".join(
        f" || '/' || coalesce(printf('%.4f', {r4(c)}), 'none')" for c in ("modal_price", "max_price", "min_price"))
    day = "date" + "".join(f" || '/' || coalesce(printf('%.4f', {r4(c)}), 'none')" for c in (
        "min_temp_c", "max_temp_c", "rain_probability_max_percent")) + " || '/' || conditions"
    ctes += [("recent", f"SELECT {SERIES}, string_agg({item}, ', ' ORDER BY arrival_date) AS recent FROM top7 GROUP BY {SERIES}"),
             ("days", f"SELECT location_id, string_agg({day}, '; ' ORDER BY date) AS days FROM wdaily GROUP BY location_id"),
             ("recorded", f"SELECT DISTINCT {SERIES}, TRUE AS any FROM prices")]
    has, fair = "(u.n_days IS NOT NULL)", "coalesce(weather_available, FALSE)"

    def when(cond: str, **columns: str) -> str:
        return ", ".join(f"CASE WHEN {cond} THEN {v} END AS {k}" for k, v in columns.items())

    on_series = " AND ".join(f"x.{c} = u.r_{c}" if c != "commodity" else "x.commodity = u.commodity" for c in SERIES.split(", "))
    return with_ctes(*ctes, body=f"""
SELECT req_id, {LANG} AS farmer_language,
  {when(has, farmer_state='r_state', farmer_district='r_district', farmer_market='r_market', farmer_crop='u.commodity')},
  {when(fair, farmer_weather_location='weather_location')}, {has} AS market_available,
  CASE WHEN NOT {has} THEN CASE WHEN g.any THEN 'No valid market-price records found.' ELSE 'No market-price records found.' END END AS market_message,
  {when(has, market_source="'AGMARKNET / OGD India'", market_state='r_state', market_district='r_district', market_market='r_market',
        market_crop='u.commodity', market_price_unit="'Rs./Quintal'", market_trend='trend',
        period_from=dstr('period_from'), period_to=dstr('period_to'), latest_date=dstr('period_to'),
        latest_min_price=r4('latest_min_price'), latest_max_price=r4('latest_max_price'), latest_modal_price=r4('latest_modal_price'),
        seven_day_average_modal_price=r4('seven_day_average_modal_price'), previous_day_modal_price=r4('previous_day_modal_price'),
        day_over_day_change_percent=r4('day_over_day_change_percent'), seven_day_change_percent=r4('seven_day_change_percent'),
        recent_modal_prices='x.recent', recent_prices='x.recent')},
  {fair} AS weather_available, weather_message,
  {when(fair, weather_source="'OpenWeather forecast'", weather_location='weather_location', latitude=r4('weather_latitude'),
        longitude=r4('weather_longitude'), daily_forecast="coalesce(d.days, '')")},
  crop_name, heat_sensitive, rain_sensitive, waterlogging_sensitive, perishability, sell_or_wait_bias,
  {r4('critical_temp_max_c')} AS critical_temp_max_c, {r4('critical_temp_min_c')} AS critical_temp_min_c,
  CAST(storage_life_days AS BIGINT) AS storage_life_days, recommended_decision, market_signal, crop_storage_signal,
  heat_risk, cold_risk, rain_risk, {r4('rule_max_temp_c')} AS max_forecast_temp_c, {r4('rule_min_temp_c')} AS min_forecast_temp_c,
  {r4('rule_max_rain_percent')} AS max_rain_probability_percent,
  array_to_string(facts_list, ' | ') AS facts, array_to_string(reasons_list, '; ') AS reasons
FROM rules u LEFT JOIN recent x ON {on_series}
LEFT JOIN days d ON d.location_id = u.weather_id
LEFT JOIN recorded g ON {on_series.replace('x.', 'g.')}""")


def _prompt_lines() -> str:
    prompt = ("'Crop:' || coalesce(commodity, 'None') || ' Market:' || coalesce(market, 'None') || ',' "
              "|| coalesce(district, 'None') || ' Lang:' || coalesce(lang, 'None') "
              f"|| chr(10) || 'Price:' || {py_float('price')} || '/quintal Chg7d:' || {py_float('chg7d_pct')} "
              "|| '% Trend:' || coalesce(trend, 'None') "
              f"|| chr(10) || 'MaxTemp:' || {py_float('max_temp_c')} || 'C HeatRisk:' || {py_bool('heat_risk')} "
              f"|| ' RainRisk:' || {py_bool('rain_risk')} "
              "|| chr(10) || 'Perishable:' || coalesce(perishable, 'None') "
              "|| ' StorageDays:' || coalesce(CAST(storage_days AS VARCHAR), 'None') "
              f"|| ' CritTemp:' || {py_number('crit_temp_c')} "
              "|| chr(10) || 'Reasons:' || array_to_string(reasons, '; ') "
              "|| chr(10) || 'Decision so far:' || coalesce(decision, 'None')")
    items = [("lang", py_str("lang")), ("crop", py_str("commodity")), ("market", py_str("market")),
             ("district", py_str("district")), ("decision", py_str("decision")),
             ("price", py_float("price")), ("chg7d_pct", py_float("chg7d_pct")),
             ("trend", py_str("trend")), ("max_temp_c", py_float("max_temp_c")),
             ("heat_risk", py_bool("heat_risk")), ("rain_risk", py_bool("rain_risk")),
             ("perishable", py_str("perishable")),
             ("storage_days", "coalesce(CAST(storage_days AS VARCHAR), 'None')"),
             ("crit_temp_c", py_number("crit_temp_c")),
             ("reasons", "'[' || array_to_string(list_transform(reasons, lambda x: "
                         + py_str("x") + "), ', ') || ']'")]
    rep = "'{' || " + " || ".join(
        f"{lit(('' if i == 0 else ', ') + repr(k) + ': ')} || {v}" for i, (k, v) in enumerate(items)) + " || '}'"
    return with_ctes(*RULE_CTES, ("fast", FAST), body=f"""
SELECT {SERIES}, {prompt} AS prompt, {fill(SYSTEM_PROMPT, assistant=lit(ASSISTANT_NAME), language=LANG)} AS system_prompt,
  {fill(USER_PROMPT, language=LANG, payload=rep)} AS user_prompt
FROM fast""")


REQ = """
SELECT req_id, coalesce(nullif(crop, ''), 'Tomato') AS commodity,
  coalesce(nullif(state, ''), 'Andhra Pradesh') AS state,
  coalesce(nullif(district, ''), 'Palamaner') AS district,
  coalesce(nullif(market, ''), 'Palamaner APMC') AS market FROM requests0"""


def _fallback_advisory() -> str:
    change = f"coalesce(printf('%+.1f', {rhe('s.seven_day_change_percent', 1)}) || '%', 'recently')"
    price = f"coalesce('₹' || {fmt0('s.latest_modal_price')} || '/quintal', 'current local mandi price')"
    text = fill(FALLBACK_ADVISORY, commodity="r.commodity", market="r.market",
                trend="coalesce(s.trend, 'stable')", change=change, price=price)
    from .sqltext import BASE_CTES
    return with_ctes(*BASE_CTES, ("requests0", REQUESTS), ("req", REQ), body=f"""
SELECT r.req_id, {text} AS advisory
FROM req r LEFT JOIN summary s ON r.state = s.state AND r.district = s.district
  AND r.market = s.market AND r.commodity = s.commodity""")


def _market_payload_default() -> str:
    return with_ctes(("prices", PRICES), ("latest", LATEST_ROW), ("requests0", REQUESTS), ("req", REQ), body=f"""
SELECT r.req_id, r.market AS market_name,
  CASE WHEN l.modal_price IS NOT NULL THEN '₹' || CAST(l.modal_price AS VARCHAR) || ' / Quintal'
       ELSE '₹2200 / Quintal' END AS current_price,
  {r4('CASE WHEN l.modal_price IS NOT NULL THEN l.modal_price ELSE 2200.0::DOUBLE END')} AS modal_price,
  {r4('CASE WHEN l.modal_price IS NOT NULL THEN l.max_price ELSE 2350.0::DOUBLE END')} AS max_price,
  {r4('CASE WHEN l.modal_price IS NOT NULL THEN l.min_price ELSE 2050.0::DOUBLE END')} AS min_price
FROM req r LEFT JOIN latest l ON r.state = l.state AND r.district = l.district
  AND r.market = l.market AND r.commodity = l.commodity""")


def lang_code(name: str) -> str:
    low = f"lower(coalesce({name}, ''))"
    tags = " ".join(f"WHEN contains({low}, '{c}-') OR {low} = '{c}' THEN '{c}'" for c in ["te", "hi", "ta", "en"])
    names = " ".join(f"WHEN contains({low}, '{w}') THEN '{c}'" for c, w in
                     [("te", "telugu"), ("hi", "hindi"), ("ta", "tamil"), ("en", "english")])
    return f"(CASE {tags} {names} ELSE 'en' END)"


# White space as RE2 names it: Unicode separators, the ASCII controls that separate, and NEL.
SPACE = r"[\p{Z}\t\n\v\f\r\x1c-\x1f\x{85}]"


def clean_text(text: str, code: str) -> str:
    steps = [("(?s)```.*?```", ""), ("`[^`\n]*`", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
             (f"(?m)^{SPACE}*#+{SPACE}*", ""), ("[*_]", ""),
             (f"(?m)^{SPACE}*[+*-]{SPACE}+", ""), (rf"(?m)^{SPACE}*\p{{Nd}}+\.{SPACE}+", "")]
    t = text
    for pat, rep in steps:
        t = f"regexp_replace({t}, {lit(pat)}, {lit(rep)}, 'g')"
    t = f"(CASE WHEN {code} = 'te' THEN regexp_replace({t}, '[A-Za-z]', '', 'g') ELSE {t} END)"
    t = f"trim(regexp_replace({t}, {lit(SPACE + '+')}, ' ', 'g'))"
    return f"coalesce({t}, '')"


# The openings of the registered query, stated once more as SQL.
MARKED = """(SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN chr(2407) || '. '
  WHEN 2 THEN chr(3175) || chr(3176) || '.' || chr(160) WHEN 3 THEN chr(160) || '-' || chr(12288)
  ELSE chr(8195) || '## **A**' || chr(160) || chr(160) || 'b' || chr(8201) || chr(10) || '1. [c](d) `e`' || chr(10)
  END || text AS text FROM documents)"""


def _text_clean() -> str:
    return f"""
SELECT doc_id, lang_code, {clean_text('text', 'lang_code')} AS clean_text
FROM (SELECT doc_id, text, {lang_code('lang')} AS lang_code FROM {MARKED})"""


def _text_script_filter() -> str:
    from .catalog_text import LANGUAGE_NAMES
    arr = "[" + ", ".join(lit(n) for n in LANGUAGE_NAMES) + "]"
    return f"""
SELECT doc_id, language_name, lang_code, {clean_text('text', 'lang_code')} AS clean_text
FROM (SELECT doc_id, text, language_name, {lang_code('language_name')} AS lang_code FROM (
  SELECT doc_id, text, ({arr})[CAST(doc_id % {len(LANGUAGE_NAMES)} + 1 AS INTEGER)] AS language_name FROM {MARKED}))"""


def infer(risk: str, trend: str, text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    return (f"(CASE WHEN contains({t}, 'sell') THEN 'sell' WHEN contains({t}, 'wait') THEN 'wait' "
            f"WHEN contains({t}, 'hold') THEN 'hold' WHEN coalesce({risk} = 'High', FALSE) THEN 'wait' "
            f"WHEN coalesce({trend} = 'Increasing', FALSE) THEN 'sell' "
            f"WHEN coalesce({trend} = 'Decreasing', FALSE) THEN 'wait' ELSE 'hold' END)")


def _infer_decision() -> str:
    return f"""
SELECT doc_id, risk_level, trend, {infer('risk_level', 'trend', 'text')} AS decision FROM (
  SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'High' ELSE 'Low' END AS risk_level,
    CASE WHEN d.lang = 'en' THEN 'Increasing' WHEN d.lang = 'fr' THEN 'Decreasing' ELSE 'Stable' END AS trend
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def parse_lenient(s: str) -> str:
    lead = f"regexp_extract(regexp_replace({s}, '[^0-9.]', '', 'g'), '^([0-9]*[.]?[0-9]+|[0-9]+[.]?)', 1)"
    return f"(CASE WHEN {lead} <> '' THEN TRY_CAST({lead} AS DOUBLE) END)"


def _advisory_normalise() -> str:
    change = f"coalesce(printf('%+.1f', {rhe('seven_day_change_percent', 1)}) || '%', 'recently')"
    price = f"coalesce('₹' || {fmt0('latest_modal_price')} || '/quintal', 'current local mandi price')"
    rec = fill(FALLBACK_ADVISORY, commodity="commodity", market="market",
               trend="coalesce(trend, 'stable')", change=change, price=price)
    view = f"""
SELECT {SERIES}, mv, coalesce({parse_lenient('CAST(latest_max_price AS VARCHAR)')}, mv * 1.08::DOUBLE) AS hv,
  coalesce({parse_lenient('CAST(latest_min_price AS VARCHAR)')}, mv * 0.9::DOUBLE) AS lv,
  rainfall, trend_view, risk_level, rec
FROM (SELECT r.*, coalesce({parse_lenient('CAST(latest_modal_price AS VARCHAR)')}, 2200.0::DOUBLE) AS mv,
  CASE WHEN coalesce(weather_available, FALSE)
       THEN CAST(CAST({rhe('rule_max_rain_percent', 0)} AS BIGINT) AS VARCHAR) || '%' END AS rainfall,
  coalesce(CASE market_signal WHEN 'rising' THEN 'Increasing' WHEN 'falling' THEN 'Decreasing'
                              WHEN 'stable' THEN 'Stable' END, 'Stable') AS trend_view,
  CASE WHEN heat_risk OR cold_risk OR rain_risk THEN 'High' ELSE 'Low' END AS risk_level,
  {rec} AS rec
FROM rules r)"""
    lbl = lambda x: f"'₹' || CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)"
    p = f"coalesce({parse_lenient('rainfall')}, 0.0::DOUBLE)"
    return with_ctes(*RULE_CTES, ("v", view), body=f"""
SELECT {SERIES}, {lbl('mv')} AS modal_label, {lbl('hv')} AS highest_label, {lbl('lv')} AS lowest_label,
  {r4('mv')} AS modal_value, {r4('hv')} AS highest_value, {r4('lv')} AS lowest_value,
  coalesce(rainfall, '—') AS rainfall,
  CASE WHEN {p} >= 50 THEN 'rainy' WHEN {p} >= 20 THEN 'cloudy' ELSE 'sunny' END AS condition,
  trend_view AS trend, risk_level, {infer('risk_level', 'trend_view', 'rec')} AS decision,
  concat_ws(' ',
    coalesce(nullif(commodity, ''), 'Crop') || ' prices are trending ' || lower(trend_view) || ' at '
      || coalesce(nullif(market, ''), 'your selected market') || ' in ' || coalesce(nullif(district, ''), 'your district') || '.',
    'Weather conditions (' || coalesce(rainfall, 'low rainfall') || ') should be considered before selling.',
    'Market prices are based on the selected market.') AS reasons
FROM v""")


def _price_band_position() -> str:
    pos = "least(100.0::DOUBLE, greatest(0.0::DOUBLE, (modal_price - min_price) / greatest(max_price - min_price, 1.0::DOUBLE) * 100.0::DOUBLE))"
    return with_ctes(("prices", PRICES), ("latest", LATEST_ROW), body=f"""
SELECT {SERIES}, {r4('min_price')} AS low, {r4('modal_price')} AS modal, {r4('max_price')} AS high,
  {r4(pos)} AS position FROM latest""")


def _translate_labels() -> str:
    from .catalog_text import EVENT_LABEL_KEY, UI_LABELS, VIEW_LANGUAGES
    vals = ", ".join(f"({lit(a)}, {lit(b)}, {lit(c)})" for a, b, c in UI_LABELS)
    langs = "[" + ", ".join(lit(x) for x in VIEW_LANGUAGES) + "]"
    key = "CASE " + " ".join(f"WHEN event_type = '{e}' THEN '{k}'" for e, k in EVENT_LABEL_KEY) + " ELSE event_type END"
    return f"""
WITH labels AS (SELECT * FROM (VALUES {vals}) AS t(language, key, text)),
base AS (SELECT event_id, ({langs})[CAST(user_id % {len(VIEW_LANGUAGES)} + 1 AS INTEGER)] AS language,
  {key} AS key FROM events)
SELECT b.event_id, b.language, b.key, coalesce(nullif(o.text, ''), nullif(e.text, ''), b.key) AS label
FROM base b LEFT JOIN labels o ON b.language = o.language AND b.key = o.key
LEFT JOIN labels e ON e.language = 'English' AND b.key = e.key"""


def _place_label() -> str:
    village = ("coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE '' END, ''), "
               "nullif(CASE WHEN c_custkey % 4 = 1 THEN 'Hamlet ' || CAST(c_custkey AS VARCHAR) END, ''), "
               "nullif(CASE WHEN c_custkey % 4 = 2 THEN c_mktsegment ELSE '' END, ''), '')")
    mandal = ("coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE '' END, ''), "
              "nullif(CASE WHEN c_custkey % 3 = 1 THEN r_name END, ''), '')")
    display = "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Place ' || CAST(c_custkey AS VARCHAR) END"
    return f"""
SELECT c_custkey, village, mandal, state,
  coalesce(nullif(concat_ws(', ', nullif(village, ''), nullif(mandal, '')), ''), nullif(display, ''), 'Unknown location') AS label
FROM (SELECT c.c_custkey, {village} AS village, {mandal} AS mandal, r.r_name AS state, {display} AS display
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def oracle_sql() -> dict[str, str]:
    return {
        "compact_payload": _compact_payload(),
        "full_payload_fields": _full_payload_fields(),
        "request_payload": _request_payload(),
        "advisory_view": _advisory_view(),
        "prompt_lines": _prompt_lines(),
        "fallback_advisory": _fallback_advisory(),
        "market_payload_default": _market_payload_default(),
        "text_clean": _text_clean(),
        "text_script_filter": _text_script_filter(),
        "infer_decision": _infer_decision(),
        "advisory_normalise": _advisory_normalise(),
        "price_band_position": _price_band_position(),
        "translate_labels": _translate_labels(),
        "place_label": _place_label(),
    }


def _profile_json_load() -> str:
    from ..sources.profiles import DRIVER_CROP_OF_TYPE, PROFILE_VALUES
    prof = ", ".join(f"({lit(r[0])}, {lit(r[1])}, {r[2]!r}::DOUBLE, {r[7]}, {lit(r[8])})" for r in PROFILE_VALUES)
    keys = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in DRIVER_CROP_OF_TYPE)
    return with_ctes(("prices", PRICES), body=f"""
SELECT c.commodity, k.crop_key, p.crop_name, {r4('p.critical_temp_max_c')} AS critical_temp_max_c,
  CAST(p.storage_life_days AS BIGINT) AS storage_life_days, p.perishability, c.n_price_rows
FROM (SELECT commodity, CAST(count(*) AS BIGINT) AS n_price_rows FROM prices GROUP BY commodity) c
JOIN (VALUES {keys}) AS k(commodity, crop_key) ON c.commodity = k.commodity
JOIN (VALUES {prof}) AS p(crop_key, crop_name, critical_temp_max_c, storage_life_days, perishability)
  ON k.crop_key = p.crop_key""")


def _landed_api_json() -> str:
    from .catalog_files import DRIVER_SUPPORTED
    from .oracle import _raw, _to_num
    names = ", ".join(lit(n) for n in DRIVER_SUPPORTED)
    api = f"""
SELECT state, district, market, 'Vegetables' AS commodity_group, commodity, variety, grade,
  {_to_num('trim(min_price)')} AS min_price, {_to_num('trim(max_price)')} AS max_price,
  {_to_num('trim(modal_price)')} AS modal_price, 'Rs./Quintal' AS price_unit,
  CAST(NULL AS DOUBLE) AS arrival_quantity, CAST(NULL AS VARCHAR) AS arrival_unit,
  CAST(try_strptime(replace(arrival_date, '-', '/'), '%d/%m/%Y') AS DATE) AS arrival_date,
  l_orderkey AS batch_id, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, state, district, market, commodity,
    variety, grade, replace(arrival_date, '-', '/'), min_price, max_price, modal_price) AS pos
FROM raw WHERE l_orderkey % 11 <> 0"""
    kept = f"""
SELECT * EXCLUDE (k) FROM (
  SELECT a.*, row_number() OVER (PARTITION BY arrival_date, state, district, market, commodity, variety, grade,
    batch_id ORDER BY pos DESC) AS k
  FROM api a WHERE commodity IN ({names}) AND state IS NOT NULL AND market IS NOT NULL
    AND commodity IS NOT NULL AND arrival_date IS NOT NULL AND modal_price IS NOT NULL
) WHERE k = 1"""
    return with_ctes(("prices", PRICES), ("raw", _raw()), ("api", api), ("kept", kept), body=f"""
SELECT state, district, market, commodity_group, commodity, variety, grade,
  {r4('min_price')} AS min_price, {r4('max_price')} AS max_price, {r4('modal_price')} AS modal_price,
  price_unit, {r4('arrival_quantity')} AS arrival_quantity, arrival_unit,
  {dstr('arrival_date')} AS arrival_date, batch_id, l_linenumber FROM kept""")


def oracle_sql_files() -> dict[str, str]:
    return {"profile_json_load": _profile_json_load(), "landed_api_json": _landed_api_json(),
            "incremental_sync": _incremental_sync()}


def _incremental_sync() -> str:
    from .catalog_files import DRIVER_SUPPORTED
    from .oracle import _BATCHES, _raw, _to_num
    names = ", ".join(lit(n) for n in DRIVER_SUPPORTED)
    api = f"""
SELECT state, district, market, 'Vegetables' AS commodity_group, commodity, variety, grade,
  {_to_num('trim(min_price)')} AS min_price, {_to_num('trim(max_price)')} AS max_price,
  {_to_num('trim(modal_price)')} AS modal_price, 'Rs./Quintal' AS price_unit,
  CAST(NULL AS DOUBLE) AS arrival_quantity, CAST(NULL AS VARCHAR) AS arrival_unit,
  CAST(try_strptime(replace(arrival_date, '-', '/'), '%d/%m/%Y') AS DATE) AS arrival_date,
  l_orderkey AS batch_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, state, district, market, commodity,
    variety, grade, replace(arrival_date, '-', '/'), min_price, max_price, modal_price) AS pos
FROM raw WHERE l_orderkey % 11 <> 0"""
    incoming = f"""
SELECT * EXCLUDE (k) FROM (
  SELECT a.*, row_number() OVER (PARTITION BY arrival_date, state, district, market, commodity, variety, grade
    ORDER BY batch_id DESC, pos DESC) AS k
  FROM api a WHERE commodity IN ({names}) AND state IS NOT NULL AND market IS NOT NULL
    AND commodity IS NOT NULL AND arrival_date IS NOT NULL AND modal_price IS NOT NULL
) WHERE k = 1"""
    on = " AND ".join(f"t.{c} = i.{c}" for c in
                      ["arrival_date", "state", "district", "market", "commodity", "variety", "grade"])
    merged = f"""
SELECT coalesce(t.state, i.state) AS state, coalesce(t.district, i.district) AS district,
  coalesce(t.market, i.market) AS market,
  CASE WHEN t.state IS NOT NULL THEN t.commodity_group ELSE i.commodity_group END AS commodity_group,
  coalesce(t.commodity, i.commodity) AS commodity, coalesce(t.variety, i.variety) AS variety,
  coalesce(t.grade, i.grade) AS grade,
  CASE WHEN i.state IS NOT NULL THEN i.min_price ELSE t.min_price END AS min_price,
  CASE WHEN i.state IS NOT NULL THEN i.max_price ELSE t.max_price END AS max_price,
  CASE WHEN i.state IS NOT NULL THEN i.modal_price ELSE t.modal_price END AS modal_price,
  CASE WHEN i.state IS NOT NULL THEN i.price_unit ELSE t.price_unit END AS price_unit,
  CASE WHEN t.state IS NOT NULL THEN t.arrival_quantity ELSE i.arrival_quantity END AS arrival_quantity,
  CASE WHEN t.state IS NOT NULL THEN t.arrival_unit ELSE i.arrival_unit END AS arrival_unit,
  coalesce(t.arrival_date, i.arrival_date) AS arrival_date,
  CASE WHEN i.state IS NOT NULL THEN 'incoming' ELSE 'target' END AS source
FROM target t FULL OUTER JOIN incoming i ON {on}"""
    return with_ctes(("prices", PRICES), _BATCHES[0], ("raw", _raw()), ("api", api),
                     ("incoming", incoming), ("u", merged), body=f"""
SELECT state, district, market, commodity_group, commodity, variety, grade,
  {r4('min_price')} AS min_price, {r4('max_price')} AS max_price, {r4('modal_price')} AS modal_price,
  price_unit, {r4('arrival_quantity')} AS arrival_quantity, arrival_unit,
  {dstr('arrival_date')} AS arrival_date, source FROM u""")

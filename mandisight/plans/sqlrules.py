"""SQL twins of the weather reduction and the rule engine (oracle side)."""

from __future__ import annotations

from .sqltext import BASE_CTES, rhe

BLOCKS = """
SELECT user_id AS location_id, CASE WHEN user_id % 5 = 4 THEN '404' ELSE '200' END AS cod,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt_txt,
  12.0::DOUBLE + value * 0.15::DOUBLE AS temp,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.62::DOUBLE / 100.0::DOUBLE AS pop,
  event_type AS description, 'Location ' || CAST(user_id AS VARCHAR) AS city_name,
  12.0::DOUBLE + user_id::DOUBLE / 1000.0::DOUBLE AS lat,
  78.0::DOUBLE + user_id::DOUBLE / 1000.0::DOUBLE AS lon
FROM events
"""

WDAILY = f"""
SELECT location_id, date, {rhe('min_temp', 2)} AS min_temp_c, {rhe('max_temp', 2)} AS max_temp_c,
  {rhe('coalesce(rain_max, 0.0::DOUBLE)', 0)} AS rain_probability_max_percent, conditions, day_rank
FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY date) AS day_rank FROM (
    SELECT location_id, date, min(temp_c) AS min_temp, max(temp_c) AS max_temp, max(rain_pct) AS rain_max,
      array_to_string(list_sort(list_distinct(list(condition))), ', ') AS conditions
    FROM (
      SELECT location_id, strftime(TRY_CAST(dt_txt AS TIMESTAMP), '%Y-%m-%d') AS date,
        CASE WHEN isnan(temp) THEN NULL ELSE temp END AS temp_c,
        coalesce(CASE WHEN isnan(pop) THEN NULL ELSE pop END, 0.0::DOUBLE) * 100.0::DOUBLE AS rain_pct,
        coalesce(description, 'unknown') AS condition
      FROM blocks WHERE cod = '200'
    ) WHERE date IS NOT NULL AND temp_c IS NOT NULL
    GROUP BY location_id, date
  )
) WHERE day_rank <= 5
"""

_OK = "(l.status_ok AND l.n_entries > 0)"
HORIZON = f"""
SELECT l.location_id, {_OK} AS available,
  CASE WHEN NOT l.status_ok THEN 'Weather forecast is unavailable.'
       WHEN l.n_entries = 0 THEN 'Weather forecast contains no entries.' END AS message,
  CASE WHEN {_OK} THEN coalesce(l.city_name, 'Unknown') END AS location,
  CASE WHEN {_OK} THEN l.lat END AS latitude,
  CASE WHEN {_OK} THEN l.lon END AS longitude,
  CASE WHEN {_OK} THEN r.max_t END AS max_forecast_temp_c,
  CASE WHEN {_OK} THEN r.min_t END AS min_forecast_temp_c,
  CASE WHEN {_OK} THEN coalesce(r.rain, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS max_rain_probability_percent,
  CAST(CASE WHEN {_OK} THEN coalesce(r.n_days, 0) ELSE 0 END AS BIGINT) AS n_days
FROM (SELECT location_id, bool_or(cod = '200') AS status_ok, count(dt_txt) AS n_entries,
        max(city_name) AS city_name, max(lat) AS lat, max(lon) AS lon FROM blocks GROUP BY location_id) l
LEFT JOIN (SELECT location_id, max(max_temp_c) AS max_t, min(min_temp_c) AS min_t,
        max(rain_probability_max_percent) AS rain, count(*) AS n_days FROM wdaily GROUP BY location_id) r
ON l.location_id = r.location_id
"""


def _kb_values() -> str:
    from ..sources.profiles import DRIVER_CROP_OF_TYPE, PROFILE_VALUES
    prof = {row[0]: row for row in PROFILE_VALUES}
    rows = []
    for p_type, key in DRIVER_CROP_OF_TYPE:
        r = prof[key]

        def b(v):
            return "TRUE" if v else "FALSE"
        rows.append(f"('{p_type.lower()}', '{r[1]}', {r[2]!r}::DOUBLE, {r[3]!r}::DOUBLE, {b(r[4])}, "
                    f"{b(r[5])}, {b(r[6])}, {r[7]}, '{r[8]}', '{r[9]}')")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(commodity_key, crop_name, "
            "critical_temp_max_c, critical_temp_min_c, heat_sensitive, rain_sensitive, "
            "waterlogging_sensitive, storage_life_days, perishability, sell_or_wait_bias)")


KB = _kb_values()


def fmt0(x: str) -> str:
    return f"CAST(CAST({rhe(x, 0)} AS BIGINT) AS VARCHAR)"


def fmt1(x: str) -> str:
    return f"printf('%.1f', {rhe(x, 1)})"


def fmt_signed2(x: str) -> str:
    return f"printf('%+.2f', {rhe(x, 2)})"


RULES0 = """
SELECT s.*, h.available AS weather_available, h.location AS weather_location, h.message AS weather_message,
  h.latitude AS weather_latitude, h.longitude AS weather_longitude, h.n_days AS weather_days, k.*,
  CASE WHEN coalesce(h.available, FALSE) THEN h.max_forecast_temp_c END AS rule_max_temp_c,
  CASE WHEN coalesce(h.available, FALSE) THEN h.min_forecast_temp_c END AS rule_min_temp_c,
  CASE WHEN coalesce(h.available, FALSE) THEN coalesce(h.max_rain_probability_percent, 0.0::DOUBLE)
       ELSE 0.0::DOUBLE END AS rule_max_rain_percent,
  coalesce(s.trend, 'unknown') AS market_signal,
  coalesce(k.crop_name, s.commodity, 'This crop') AS rule_crop_name
FROM summary s LEFT JOIN horizon h ON s.location_id = h.location_id
JOIN kb k ON lower(s.commodity) = k.commodity_key
"""

RULES1 = """
SELECT r.*,
  (coalesce(heat_sensitive, FALSE) AND coalesce(rule_max_temp_c > critical_temp_max_c, FALSE)) AS heat_risk,
  (coalesce(rule_max_rain_percent >= 60, FALSE)
     AND (coalesce(rain_sensitive, FALSE) OR coalesce(waterlogging_sensitive, FALSE))) AS rain_risk,
  (coalesce(weather_available, FALSE) AND coalesce(rule_min_temp_c < critical_temp_min_c, FALSE)) AS cold_risk
FROM rules0 r
"""

_FACTS = [
    ("latest_modal_price IS NOT NULL",
     f"'Latest modal price is Rs.' || {fmt0('latest_modal_price')} || ' per quintal.'"),
    ("seven_day_change_percent IS NOT NULL",
     f"'Seven-day price change is ' || {fmt_signed2('seven_day_change_percent')} "
     "|| '% and the trend is ' || market_signal || '.'"),
    ("heat_risk",
     f"'Maximum forecast temperature is ' || {fmt1('rule_max_temp_c')} || '°C, above ' || rule_crop_name "
     f"|| '''s critical maximum of ' || {fmt1('critical_temp_max_c')} || '°C.'"),
    ("cold_risk",
     f"'Minimum forecast temperature is ' || {fmt1('rule_min_temp_c')} || '°C, below ' || rule_crop_name "
     f"|| '''s critical minimum of ' || {fmt1('critical_temp_min_c')} || '°C.'"),
    ("rain_risk",
     f"'Maximum forecast rain probability is ' || {fmt0('rule_max_rain_percent')} || '%.'"),
]
_REASONS = [
    ("heat_risk", "'High temperature may reduce ' || rule_crop_name || ' quality or yield.'"),
    ("cold_risk", "'Low temperature may damage ' || rule_crop_name || '.'"),
    ("rain_risk", "'Rain may increase harvest, transport, or storage risk for ' || rule_crop_name || '.'"),
    ("perishability = 'high'", "rule_crop_name || ' is highly perishable.'"),
    ("perishability = 'medium'", "rule_crop_name || ' has moderate storage limitations.'"),
]


def _list(items) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in items) + "], lambda x: x IS NOT NULL)"


RULES = f"""
SELECT r.*,
  CASE WHEN heat_risk OR cold_risk OR rain_risk THEN 'sell_within_1_to_3_days'
       WHEN coalesce(sell_or_wait_bias, '') = 'sell_fast_if_perishable' AND market_signal = 'falling' THEN 'sell_soon'
       WHEN market_signal = 'rising' AND storage_life_days IS NOT NULL AND storage_life_days >= 7
            AND NOT coalesce(perishability = 'high', FALSE) THEN 'monitor_for_1_day_before_selling'
       ELSE 'sell_soon' END AS recommended_decision,
  coalesce(perishability, 'unknown') AS crop_storage_signal,
  {_list(_FACTS)} AS facts_list,
  {_list(_REASONS)} AS reasons_list
FROM rules1 r
"""

WEATHER_CTES = [("blocks", BLOCKS), ("wdaily", WDAILY), ("horizon", HORIZON)]
RULE_CTES = BASE_CTES + WEATHER_CTES + [("kb", KB), ("rules0", RULES0), ("rules1", RULES1), ("rules", RULES)]

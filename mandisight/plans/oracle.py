"""DuckDB oracle SQL for each registered query (see ``plans.catalog``)."""

from __future__ import annotations

from .sqlrules import KB, RULE_CTES, WEATHER_CTES
from .sqltext import (BASE_CTES, LATEST_ROW, MARKET_DIM, PRICES, REQUESTS, SERIES, TIE_DESC, cents_text,
                      _cycle, dstr, pct, r4, rhe, with_ctes)


_SUMMARY_BODY = f"""
SELECT {SERIES}, n_days, {dstr('period_from')} AS period_from, {dstr('period_to')} AS period_to,
  {r4('latest_min_price')} AS latest_min_price, {r4('latest_max_price')} AS latest_max_price,
  {r4('latest_modal_price')} AS latest_modal_price,
  {r4('seven_day_average_modal_price')} AS seven_day_average_modal_price,
  {r4('previous_day_modal_price')} AS previous_day_modal_price,
  {r4('day_over_day_change_percent')} AS day_over_day_change_percent,
  {r4('seven_day_change_percent')} AS seven_day_change_percent, trend
FROM summary"""


def _market_summary() -> str:
    return with_ctes(*BASE_CTES, body=_SUMMARY_BODY)


def _price_day_over_day() -> str:
    return with_ctes(*BASE_CTES[:2], body=f"""
SELECT {SERIES}, {dstr('arrival_date')} AS arrival_date, {r4('modal_price')} AS modal_price,
  {r4('prev')} AS previous_modal_price, {r4(rhe(pct('modal_price', 'prev'), 2))} AS day_change_percent
FROM (SELECT d.*, lag(modal_price) OVER (PARTITION BY {SERIES} ORDER BY arrival_date) AS prev FROM daily d)""")


def _recent_price_list() -> str:
    return with_ctes(*BASE_CTES[:3], body=f"""
SELECT {SERIES}, count(*) AS n_days,
  string_agg({dstr('arrival_date')} || '=' || printf('%.2f', {rhe('modal_price', 2)}), ', ' ORDER BY arrival_date) AS recent_prices
FROM top7 GROUP BY {SERIES}""")


def _history_latest_dates() -> str:
    return with_ctes(("prices", PRICES), body=f"""
SELECT {SERIES}, {dstr('arrival_date')} AS arrival_date, variety, grade,
  {r4('min_price')} AS min_price, {r4('max_price')} AS max_price, {r4('modal_price')} AS modal_price,
  date_rank, l_orderkey, l_linenumber
FROM (SELECT p.*, dense_rank() OVER (PARTITION BY {SERIES} ORDER BY arrival_date DESC) AS date_rank FROM prices p)
WHERE date_rank <= 7""")


def _history_latest_rows() -> str:
    return with_ctes(("prices", PRICES), body=f"""
SELECT {SERIES}, {dstr('arrival_date')} AS date, {r4('max_price')} AS maxPrice,
  {r4('modal_price')} AS modalPrice, {r4('min_price')} AS minPrice, row_rank
FROM (SELECT p.*, row_number() OVER (PARTITION BY {SERIES}
        ORDER BY arrival_date DESC, variety DESC, grade DESC, {TIE_DESC}) AS row_rank FROM prices p)
WHERE row_rank <= 30""")


def _history_requests() -> str:
    return with_ctes(("prices", PRICES), ("req", REQUESTS), body=f"""
SELECT req_id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY k DESC) AS BIGINT) AS seq, {dstr('arrival_date')} AS date,
  {r4('max_price')} AS maxPrice, {r4('modal_price')} AS modalPrice, {r4('min_price')} AS minPrice
FROM (SELECT r.req_id, p.*, row_number() OVER (PARTITION BY r.req_id
        ORDER BY arrival_date DESC, variety DESC, grade DESC, {TIE_DESC}) AS k
      FROM req r JOIN prices p ON p.state = r.state AND p.market = r.market AND p.commodity = r.crop
        AND (trim(r.district) = '' OR p.district = r.district))
WHERE k <= 30""")


def _latest_row() -> str:
    return with_ctes(("prices", PRICES), ("latest", LATEST_ROW), body=f"""
SELECT {SERIES}, commodity_group, variety, grade, {r4('min_price')} AS min_price,
  {r4('max_price')} AS max_price, {r4('modal_price')} AS modal_price, price_unit,
  {r4('arrival_quantity')} AS arrival_quantity, arrival_unit, {dstr('arrival_date')} AS arrival_date
FROM latest""")


def _latest_per_group_ties() -> str:
    return with_ctes(("prices", PRICES), body=f"""
SELECT {SERIES}, {dstr('arrival_date')} AS arrival_date, variety, grade, {r4('modal_price')} AS modal_price,
  l_orderkey, l_linenumber
FROM (SELECT *, max(arrival_date) OVER (PARTITION BY {SERIES}) AS newest FROM prices)
WHERE arrival_date = newest""")


def _blank_district_lookup() -> str:
    latest_nd = f"""
SELECT * EXCLUDE (k) FROM (
  SELECT p.*, row_number() OVER (PARTITION BY state, market, commodity
     ORDER BY arrival_date DESC, variety DESC, grade DESC, {TIE_DESC}) AS k FROM prices p
) WHERE k = 1"""
    req = """
SELECT req_id, coalesce(nullif(state, ''), 'Andhra Pradesh') AS state, district,
  coalesce(nullif(market, ''), 'Palamaner APMC') AS market,
  coalesce(nullif(crop, ''), 'Tomato') AS commodity FROM requests0"""
    return with_ctes(("prices", PRICES), ("latest", LATEST_ROW), ("latest_nd", latest_nd),
                     ("requests0", REQUESTS), ("req", req), body=f"""
SELECT r.req_id, r.state, r.district, r.market, r.commodity,
  {dstr('l.arrival_date')} AS latest_date, {r4('l.modal_price')} AS latest_modal, l.variety AS latest_variety
FROM req r LEFT JOIN latest l ON r.state = l.state AND r.district = l.district
  AND r.market = l.market AND r.commodity = l.commodity
WHERE trim(coalesce(r.district, '')) <> ''
UNION ALL
SELECT r.req_id, r.state, r.district, r.market, r.commodity,
  {dstr('l.arrival_date')} AS latest_date, {r4('l.modal_price')} AS latest_modal, l.variety AS latest_variety
FROM req r LEFT JOIN latest_nd l ON r.state = l.state AND r.market = l.market AND r.commodity = l.commodity
WHERE trim(coalesce(r.district, '')) = ''""")


def _optional_filters() -> str:
    from .catalog import FILTER_SETS
    parts = []
    for i, params in enumerate(FILTER_SETS):
        cond = " AND ".join(f"{k} = '{v}'" for k, v in params.items())
        parts.append(f"""
SELECT CAST({i} AS BIGINT) AS filter_id, {SERIES}, {dstr('arrival_date')} AS arrival_date, variety, grade,
  {r4('modal_price')} AS modal_price, l_orderkey, l_linenumber
FROM prices WHERE {cond} AND arrival_date IN (
  SELECT DISTINCT arrival_date FROM prices WHERE {cond} ORDER BY arrival_date DESC LIMIT 7)""")
    return with_ctes(("prices", PRICES), body="\nUNION ALL\n".join(parts))


def _history_filter_requests() -> str:
    brand = "'Brand#' || CAST((s_suppkey + mask) % 25 + 1 AS VARCHAR)"
    values = [("state", "state"), ("district", "district"), ("market", "market"), ("variety", brand)]
    filters = ", ".join(f"CASE WHEN (mask >> {b}) % 2 = 1 THEN {v} END AS {c}" for b, (c, v) in enumerate(values))
    req = f"""
SELECT s_suppkey * 16 + mask AS req_id,
  CASE WHEN s_suppkey % 7 <> 3 THEN ([{_cycle}])[CAST(s_suppkey % 6 + 1 AS INTEGER)] END AS commodity, {filters}
FROM ({MARKET_DIM}), range(16) masks(mask) WHERE s_suppkey % 7 <> 3 OR mask = s_suppkey % 16"""
    passes = " AND ".join(f"(r.{c} IS NULL OR r.{c} = p.{c})" for c, _ in values)
    return with_ctes(("prices", PRICES), ("req", req), body=f"""
SELECT req_id, {SERIES}, {dstr('arrival_date')} AS arrival_date, variety, grade,
  {r4('modal_price')} AS modal_price, l_orderkey, l_linenumber
FROM (SELECT r.req_id, p.*, dense_rank() OVER (PARTITION BY r.req_id ORDER BY p.arrival_date DESC) AS k
      FROM req r JOIN prices p ON p.commodity = r.commodity AND {passes})
WHERE k <= 7""")


def _supported_commodities() -> str:
    from .catalog import DRIVER_SUPPORTED
    names = ", ".join(f"'{n}'" for n in DRIVER_SUPPORTED)
    return with_ctes(("prices", PRICES), body=f"""
SELECT {SERIES}, {dstr('arrival_date')} AS arrival_date, variety, grade,
  {r4('modal_price')} AS modal_price, l_orderkey, l_linenumber
FROM prices WHERE commodity IN ({names})""")


def _markets_per_commodity() -> str:
    return with_ctes(("prices", PRICES), body="""
SELECT p.commodity, p.market, c.n_markets FROM (SELECT DISTINCT commodity, market FROM prices) p
JOIN (SELECT commodity, count(DISTINCT market) AS n_markets FROM prices GROUP BY commodity) c
ON p.commodity = c.commodity""")


def _weather_daily() -> str:
    return with_ctes(*WEATHER_CTES[:2], body=f"""
SELECT location_id, date, {r4('min_temp_c')} AS min_temp_c, {r4('max_temp_c')} AS max_temp_c,
  {r4('rain_probability_max_percent')} AS rain_probability_max_percent, conditions, day_rank
FROM wdaily""")


def _weather_horizon() -> str:
    return with_ctes(*WEATHER_CTES, body=f"""
SELECT location_id, available, message, location, {r4('latitude')} AS latitude, {r4('longitude')} AS longitude,
  {r4('max_forecast_temp_c')} AS max_forecast_temp_c, {r4('min_forecast_temp_c')} AS min_forecast_temp_c,
  {r4('max_rain_probability_percent')} AS max_rain_probability_percent, n_days
FROM horizon""")


def _crop_profile_join() -> str:
    return with_ctes(("prices", PRICES), ("kb", KB), body=f"""
SELECT {SERIES}, {dstr('arrival_date')} AS arrival_date, variety, grade, l_orderkey, l_linenumber,
  crop_name, {r4('critical_temp_max_c')} AS critical_temp_max_c,
  CAST(storage_life_days AS BIGINT) AS storage_life_days, perishability, sell_or_wait_bias
FROM prices p JOIN kb k ON lower(p.commodity) = k.commodity_key""")


def _risk_flags() -> str:
    return with_ctes(*RULE_CTES, body=f"""
SELECT {SERIES}, location_id, coalesce(weather_available, FALSE) AS weather_available,
  {r4('rule_max_temp_c')} AS max_forecast_temp_c, {r4('rule_min_temp_c')} AS min_forecast_temp_c,
  {r4('rule_max_rain_percent')} AS max_rain_probability_percent, heat_risk, cold_risk, rain_risk
FROM rules""")


def _decision() -> str:
    return with_ctes(*RULE_CTES, body=f"""
SELECT {SERIES}, market_signal, {r4('seven_day_change_percent')} AS seven_day_change_percent,
  {r4('latest_modal_price')} AS latest_modal_price, heat_risk, cold_risk, rain_risk,
  crop_storage_signal, recommended_decision
FROM rules""")


def _facts_text() -> str:
    return with_ctes(*RULE_CTES, body=f"""
SELECT {SERIES}, CAST(len(facts_list) AS BIGINT) AS n_facts, array_to_string(facts_list, ' | ') AS facts
FROM rules""")


def _reasons_text() -> str:
    return with_ctes(*RULE_CTES, body=f"""
SELECT {SERIES}, CAST(len(reasons_list) AS BIGINT) AS n_reasons, array_to_string(reasons_list, '; ') AS reasons
FROM rules""")


_NA = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
       "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")
_NUM = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def _to_num(t: str) -> str:
    v = f"TRY_CAST({t} AS DOUBLE)"
    return f"(CASE WHEN regexp_matches({t}, {_NUM}) AND NOT isnan({v}) THEN {v} END)"


def _na(c: str) -> str:
    return f"(CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END)"


def _raw() -> str:
    return f"""
SELECT CASE WHEN l_linenumber = 4 THEN '  ' || state || ' ' ELSE state END AS state, district,
  CASE WHEN l_linenumber = 5 THEN 'NA' ELSE market END AS market, commodity_group, commodity, variety, grade,
  CASE WHEN l_linenumber = 2 THEN 'N/A' ELSE {cents_text('min_price')} END AS min_price,
  CASE WHEN l_linenumber = 6 THEN '1,2x3' ELSE {cents_text('max_price')} END AS max_price,
  CASE WHEN l_linenumber = 1 THEN '' ELSE {cents_text('modal_price')} END AS modal_price,
  price_unit, format('{{:,.2f}}', arrival_quantity) AS arrival_quantity, arrival_unit,
  CASE WHEN l_linenumber = 3 THEN '31-02-1999' ELSE strftime(arrival_date, '%d-%m-%Y') END AS arrival_date,
  l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax
FROM prices"""


def _canon(src: str, extra: str = "l_orderkey, l_linenumber") -> str:
    return f"""
SELECT state, district, market, commodity_group, commodity, variety, grade,
  {r4('min_price')} AS min_price, {r4('max_price')} AS max_price, {r4('modal_price')} AS modal_price,
  price_unit, {r4('arrival_quantity')} AS arrival_quantity, arrival_unit,
  {dstr('arrival_date')} AS arrival_date, {extra} FROM {src}"""


def _cleaned() -> str:
    nulled = ", ".join(f"{_na(c)} AS {c}" for c in
                       ["state", "district", "market", "commodity_group", "commodity", "variety", "grade",
                        "min_price", "max_price", "modal_price", "price_unit", "arrival_quantity",
                        "arrival_unit", "arrival_date"])
    text = ["state", "district", "market", "commodity_group", "commodity", "variety", "grade",
            "price_unit", "arrival_unit"]
    num = ["min_price", "max_price", "modal_price", "arrival_quantity"]
    sel = ", ".join([f"trim({c}) AS {c}" for c in text]
                    + [f"{_to_num(f'trim(replace({c}, {chr(39)},{chr(39)}, {chr(39)}{chr(39)}))')} AS {c}" for c in num]
                    + ["CAST(try_strptime(arrival_date, '%d-%m-%Y') AS DATE) AS arrival_date"])
    return f"""
SELECT * FROM (SELECT {sel}, l_orderkey, l_linenumber FROM (
  SELECT {nulled}, l_orderkey, l_linenumber FROM raw)
  WHERE state IS NOT NULL AND market IS NOT NULL AND commodity IS NOT NULL AND arrival_date IS NOT NULL)
WHERE arrival_date IS NOT NULL AND modal_price IS NOT NULL"""


def _clean_csv_numbers() -> str:
    return with_ctes(("prices", PRICES), ("raw", _raw()), ("cleaned", _cleaned()), body=_canon("cleaned"))


def _bad_files() -> str:
    # Every commodity is one export; the short one lost a column of the SMALL export.
    return with_ctes(("prices", PRICES), ("raw", _raw()), ("cleaned", _cleaned()), body="""
SELECT commodity AS export, 'loaded' AS status, CAST(14 AS BIGINT) AS n_fields, CAST(count(*) AS BIGINT) AS valid_rows
FROM cleaned GROUP BY commodity
UNION ALL SELECT 'SMALL-short', 'skipped', 13, 0""")


def _quarantined_lines() -> str:
    columns = ["state", "district", "market", "commodity_group", "commodity", "variety", "grade", "min_price",
               "max_price", "modal_price", "price_unit", "arrival_quantity", "arrival_unit", "arrival_date"]

    def written(names: list[str]) -> str:
        # As a CSV writer leaves a field: padding cut, quoted if it holds a comma or nothing.
        return " || ',' || ".join(
            f"CASE WHEN trim({c}) LIKE '%,%' THEN '\"' || trim({c}) || '\"' WHEN trim({c}) = '' THEN '\"\"' "
            f"ELSE coalesce(trim({c}), '') END" for c in names)

    return with_ctes(("prices", PRICES), ("raw", _raw()), body=f"""
SELECT export, reason, text, count(*) AS n_lines FROM (
  SELECT commodity AS export, {written(columns)} AS text,
    CASE WHEN l_linenumber = 5 THEN 'no market' WHEN l_linenumber = 3 THEN 'bad arrival_date'
         WHEN l_linenumber = 1 THEN 'no modal_price' END AS reason FROM raw
  UNION ALL
  SELECT 'SMALL-short', {written([c for c in columns if c != 'arrival_unit'])}, 'file has 13 fields'
  FROM raw WHERE commodity = 'SMALL')
WHERE reason IS NOT NULL GROUP BY export, reason, text""")


def _bulk_load_table() -> str:
    last = f"""
SELECT * EXCLUDE (k) FROM (SELECT c.*, row_number() OVER (PARTITION BY {_KEY}
  ORDER BY l_orderkey DESC, l_linenumber DESC) AS k FROM cleaned c) WHERE k = 1"""
    return with_ctes(("prices", PRICES), ("raw", _raw()), ("cleaned", _cleaned()), ("stored", last),
                     body=_canon("stored").replace(", l_orderkey, l_linenumber FROM", " FROM"))


def _api_sync_table() -> str:
    from .catalog import DRIVER_SUPPORTED
    names = ", ".join(f"'{n}'" for n in DRIVER_SUPPORTED)
    district = "CASE WHEN l_orderkey % 13 <> 0 THEN district END AS district"
    target = f"""
SELECT * EXCLUDE (k) FROM (
  SELECT s.*, row_number() OVER (PARTITION BY {_KEY} ORDER BY {TIE_DESC}) AS k
  FROM (SELECT * REPLACE ({district}) FROM prices WHERE arrival_date <= DATE '1999-12-31') s) WHERE k = 1"""

    def batches(lowest: str, which: str) -> str:
        return f"""
SELECT * EXCLUDE (k) FROM (
  SELECT a.*, row_number() OVER (PARTITION BY l_orderkey, {_KEY} ORDER BY l_linenumber DESC) AS k FROM (
    SELECT state, {district}, market, 'Vegetables' AS commodity_group, commodity, variety, grade,
      {_to_num(f'trim({lowest})')} AS min_price, {_to_num('trim(max_price)')} AS max_price,
      {_to_num('trim(modal_price)')} AS modal_price, 'Rs./Quintal' AS price_unit,
      CAST(NULL AS DOUBLE) AS arrival_quantity, CAST(NULL AS VARCHAR) AS arrival_unit,
      CAST(try_strptime(replace(arrival_date, '-', '/'), '%d/%m/%Y') AS DATE) AS arrival_date,
      l_orderkey, l_linenumber
    FROM raw WHERE l_orderkey % 11 <> 0 AND {which} AND commodity IN ({names})) a
  WHERE state IS NOT NULL AND market IS NOT NULL AND arrival_date IS NOT NULL AND modal_price IS NOT NULL) WHERE k = 1"""

    def last(rows: str) -> str:
        # A row without a district conflicts with nothing, so each batch's row stays.
        return f"""
SELECT * EXCLUDE (k) FROM (
  SELECT b.*, row_number() OVER (PARTITION BY {_KEY} ORDER BY l_orderkey DESC) AS k FROM {rows} b)
WHERE k = 1 OR district IS NULL"""

    def stored(t: str, i: str) -> str:
        return _PRICES_ONLY.replace("FROM target t FULL OUTER JOIN incoming i", f"FROM {t} t FULL OUTER JOIN {i} i")

    return with_ctes(("prices", PRICES), ("raw", _raw()), ("target", target),
                     ("b1", batches("min_price", "TRUE")), ("in1", last("b1")), ("t1", stored("target", "in1")),
                     ("b2", batches("modal_price", "l_orderkey % 3 = 0")), ("in2", last("b2")), ("t2", stored("t1", "in2")),
                     body=_canon("t2").replace(", l_orderkey, l_linenumber FROM", " FROM"))


def _landed_api_filtered() -> str:
    fields = "state, district, market, commodity, variety, grade, arrival_date, min_price, max_price, modal_price"
    return with_ctes(("prices", PRICES), ("raw", _raw()), ("slashed", """
SELECT * REPLACE (replace(arrival_date, '-', '/') AS arrival_date) FROM raw"""), body=f"""
SELECT l_orderkey AS batch_id, {fields}, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {fields}) AS k FROM slashed
  WHERE l_orderkey % 11 <> 0 AND commodity = 'PROMO' AND state = 'ASIA') WHERE k <= 2""")


def _landed_forecast() -> str:
    # The latest document of a location holds the entries of its last day.
    return _weather_horizon().replace(
        "FROM events", "FROM (SELECT * FROM events QUALIFY CAST(ts AS DATE) = max(CAST(ts AS DATE)) OVER (PARTITION BY user_id))")


def _clean_api_numbers() -> str:
    from .catalog import DRIVER_SUPPORTED
    names = ", ".join(f"'{n}'" for n in DRIVER_SUPPORTED)
    api = f"""
SELECT state, district, market, 'Vegetables' AS commodity_group, commodity, variety, grade,
  {_to_num('trim(min_price)')} AS min_price, {_to_num('trim(max_price)')} AS max_price,
  {_to_num('trim(modal_price)')} AS modal_price, 'Rs./Quintal' AS price_unit,
  CAST(NULL AS DOUBLE) AS arrival_quantity, CAST(NULL AS VARCHAR) AS arrival_unit,
  CAST(try_strptime(replace(arrival_date, '-', '/'), '%d/%m/%Y') AS DATE) AS arrival_date,
  l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax
FROM raw"""
    kept = f"""
SELECT * EXCLUDE (k) FROM (
  SELECT a.*, row_number() OVER (PARTITION BY arrival_date, state, district, market, commodity, variety, grade
    ORDER BY {TIE_DESC}) AS k
  FROM api a WHERE commodity IN ({names}) AND state IS NOT NULL AND market IS NOT NULL
    AND commodity IS NOT NULL AND arrival_date IS NOT NULL AND modal_price IS NOT NULL
) WHERE k = 1"""
    return with_ctes(("prices", PRICES), ("raw", _raw()), ("api", api), ("kept", kept), body=_canon("kept"))


def _parse_dates() -> str:
    texts = """
SELECT l_orderkey, l_linenumber,
  CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%d-%m-%Y') WHEN 2 THEN strftime(l_shipdate, '%d/%m/%Y')
    WHEN 3 THEN CAST(day(l_shipdate) AS VARCHAR) || '-' || CAST(month(l_shipdate) AS VARCHAR) || '-' || CAST(year(l_shipdate) AS VARCHAR)
    WHEN 4 THEN '31-02-1999' WHEN 5 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') WHEN 6 THEN 'N/A'
    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date_text
FROM lineitem"""
    return with_ctes(("texts", texts), body="""
SELECT l_orderkey, l_linenumber, date_text,
  strftime(CAST(try_strptime(date_text, '%d-%m-%Y') AS DATE), '%Y-%m-%d') AS report_date,
  strftime(CAST(try_strptime(date_text, '%d/%m/%Y') AS DATE), '%Y-%m-%d') AS api_date,
  strftime(TRY_CAST(date_text AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS lenient_ts
FROM texts""")


def _round_ties() -> str:
    return f"""
SELECT n, {rhe('n / 1000.0::DOUBLE', 2)} AS hundredths, {rhe('n / 100.0::DOUBLE', 1)} AS tenths,
  {rhe('n / 10.0::DOUBLE', 0)} AS whole, {rhe('n', -1)} AS tens
FROM (SELECT DISTINCT ((l_orderkey * 100 + l_partkey % 100) * 10 + 5) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS n
      FROM lineitem)"""


def _null_defaults() -> str:
    return with_ctes(("prices", PRICES), body=f"""
SELECT l_orderkey, l_linenumber,
  {r4("coalesce(CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN NULL ELSE modal_price END, 0.0::DOUBLE)")} AS safe_modal,
  {r4("CASE WHEN l_linenumber = 3 THEN NULL ELSE min_price END")} AS safe_min,
  {r4("coalesce(CASE WHEN l_linenumber IN (1, 2) THEN NULL ELSE modal_price END, CASE WHEN l_linenumber = 1 THEN NULL ELSE max_price END, 0.0::DOUBLE)")} AS chart_modal
FROM prices""")


_KEY = "arrival_date, state, district, market, commodity, variety, grade"


def _dedupe_sql(src: str) -> str:
    return f"""
SELECT * EXCLUDE (k) FROM (
  SELECT s.*, row_number() OVER (PARTITION BY {_KEY} ORDER BY {TIE_DESC}) AS k FROM {src} s) WHERE k = 1"""


def _dedupe_keep_last() -> str:
    return with_ctes(("prices", PRICES), ("d", _dedupe_sql("prices")), body=_canon("d"))


_BATCHES = [
    ("target", _dedupe_sql("(SELECT * FROM prices WHERE arrival_date <= DATE '1999-12-31')")),
    ("incoming", _dedupe_sql("""(SELECT state, district, market, CAST(NULL AS VARCHAR) AS commodity_group,
        commodity, variety, grade, min_price * 1.1::DOUBLE AS min_price, max_price * 1.1::DOUBLE AS max_price,
        modal_price * 1.1::DOUBLE AS modal_price, price_unit, CAST(NULL AS DOUBLE) AS arrival_quantity,
        CAST(NULL AS VARCHAR) AS arrival_unit, arrival_date, location_id,
        l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax
      FROM prices WHERE arrival_date >= DATE '1999-01-01')""")),
]
_ON = " AND ".join(f"t.{c} = i.{c}" for c in _KEY.split(", "))


def _upsert_full() -> str:
    full = f"""
SELECT i.*, 'incoming' AS source FROM incoming i
UNION ALL
SELECT t.*, 'target' AS source FROM target t WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE {_ON})"""
    return with_ctes(("prices", PRICES), *_BATCHES, ("u", full), body=_canon("u", "l_orderkey, l_linenumber, source"))


_PRICES_ONLY = f"""
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
  CASE WHEN i.state IS NOT NULL THEN i.l_orderkey ELSE t.l_orderkey END AS l_orderkey,
  CASE WHEN i.state IS NOT NULL THEN i.l_linenumber ELSE t.l_linenumber END AS l_linenumber,
  CASE WHEN i.state IS NOT NULL THEN 'incoming' ELSE 'target' END AS source,
  (t.state IS NOT NULL AND i.state IS NOT NULL) AS matched
FROM target t FULL OUTER JOIN incoming i ON {_ON}"""


def _upsert_prices_only() -> str:
    return with_ctes(("prices", PRICES), *_BATCHES, ("u", _PRICES_ONLY),
                     body=_canon("u", "l_orderkey, l_linenumber, source"))


def _tail_summary() -> str:
    daily = f"""
SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY {SERIES}, arrival_date ORDER BY variety DESC, grade DESC) AS k
  FROM u WHERE modal_price IS NOT NULL AND NOT isnan(modal_price)) WHERE k = 1"""
    rest = [(n, q.replace("arg_max(location_id, arrival_date) AS location_id,", "")) for n, q in BASE_CTES[2:]]
    return with_ctes(("prices", PRICES), *_BATCHES, ("u", _PRICES_ONLY), ("daily", daily), *rest,
                     body=_SUMMARY_BODY)


def _sync_log_table() -> str:
    return with_ctes(("prices", PRICES), *_BATCHES[:1], ("log", """
SELECT row_number() OVER (ORDER BY y) AS id, y || '-12-31T06:00:00' AS synced_at, n FROM (
  SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"""), body="""
SELECT synced_at AS last_synced_at, n AS last_records_added, (SELECT count(*) FROM target) AS total_records,
  (SELECT count(*) FROM log) AS log_entries,
  'Synced ' || n || ' new price record(s) for ' || substr(synced_at, 1, 10) || '.' AS message
FROM log ORDER BY id DESC LIMIT 1""")


def _upsert_counts() -> str:
    return with_ctes(("prices", PRICES), *_BATCHES, ("u", _PRICES_ONLY), body="""
SELECT CAST(sum(CASE WHEN source = 'incoming' THEN 1 ELSE 0 END) AS BIGINT) AS rows_applied,
  CAST(sum(CASE WHEN source = 'incoming' AND NOT matched THEN 1 ELSE 0 END) AS BIGINT) AS inserted,
  CAST(sum(CASE WHEN matched THEN 1 ELSE 0 END) AS BIGINT) AS updated,
  CAST(sum(CASE WHEN source = 'target' THEN 1 ELSE 0 END) AS BIGINT) AS untouched,
  CAST(count(*) AS BIGINT) AS total_after
FROM u""")


def _carry_forward() -> str:
    latest = f"""
SELECT * EXCLUDE (newest) FROM (SELECT *, max(arrival_date) OVER (PARTITION BY {SERIES}) AS newest FROM prices)
WHERE arrival_date = newest"""
    first = f"""
SELECT * EXCLUDE (k) FROM (SELECT l.*, row_number() OVER (PARTITION BY {SERIES}
   ORDER BY variety ASC, grade ASC, {", ".join(f"{c} ASC" for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"])}) AS k
 FROM latest_rows l) WHERE k = 1"""
    base = "coalesce(CASE WHEN modal_price <> 0 THEN modal_price END, 1000.0::DOUBLE)"
    qty = "coalesce(CASE WHEN arrival_quantity <> 0 THEN arrival_quantity END, 1.0::DOUBLE)"
    new = f"""
SELECT state, district, market, commodity_group, commodity, variety, grade,
  {rhe(f'coalesce(min_price, {base})', -1)} AS min_price, {rhe(f'coalesce(max_price, {base})', -1)} AS max_price,
  {rhe(base, -1)} AS modal_price, price_unit, {rhe(f'greatest({qty}, 0.1::DOUBLE)', 1)} AS arrival_quantity,
  arrival_unit, (SELECT max(arrival_date) FROM prices) AS arrival_date, arrival_date AS carried_from
FROM first_rows f
WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.state = f.state AND p.district = f.district
  AND p.market = f.market AND p.commodity = f.commodity AND p.arrival_date = (SELECT max(arrival_date) FROM prices))"""
    return with_ctes(("prices", PRICES), ("latest_rows", latest), ("first_rows", first), ("new_rows", new),
                     body=_canon("new_rows", f"{dstr('carried_from')} AS carried_from"))


def _sync_status() -> str:
    log = """
SELECT CAST(year(m) * 12 + month(m) AS BIGINT) AS id, strftime(m, '%Y-%m-%dT%H:%M:%S') AS synced_at,
  CAST(count(*) AS INTEGER) AS records_added
FROM (SELECT date_trunc('month', o_orderdate) AS m FROM orders) GROUP BY m"""
    return with_ctes(("prices", PRICES), ("log", log), body="""
SELECT l.synced_at AS last_synced_at, CAST(coalesce(l.records_added, 0) AS BIGINT) AS last_records_added,
  (SELECT CAST(count(*) AS BIGINT) FROM prices) AS total_records,
  (SELECT CAST(count(*) AS BIGINT) FROM log) AS log_entries,
  CASE WHEN coalesce(l.records_added, 0) > 0
       THEN 'Synced ' || CAST(l.records_added AS VARCHAR) || ' new price record(s) for ' || substr(l.synced_at, 1, 10) || '.'
       ELSE 'All markets already up to date for ' || substr(l.synced_at, 1, 10) || '.' END AS message
FROM (SELECT * FROM log ORDER BY id DESC LIMIT 1) l""")


def oracle_sql() -> dict[str, str]:
    from .oracle_text import oracle_sql as _text
    from .oracle_text import oracle_sql_files as _files
    return {**_text(), **_files(),
        "clean_csv_numbers": _clean_csv_numbers(),
        "clean_api_numbers": _clean_api_numbers(),
        "parse_dates": _parse_dates(),
        "null_defaults": _null_defaults(),
        "round_ties": _round_ties(),
        "dedupe_keep_last": _dedupe_keep_last(),
        "upsert_full": _upsert_full(),
        "upsert_prices_only": _upsert_prices_only(),
        "upsert_counts": _upsert_counts(),
        "bad_files": _bad_files(),
        "quarantined_lines": _quarantined_lines(),
        "bulk_load_table": _bulk_load_table(),
        "api_sync_table": _api_sync_table(),
        # Two syncs leave the same table however they came in, and a replay changes nothing.
        "stream_sync_table": _api_sync_table(),
        "tail_summary": _tail_summary(),
        "sync_log_table": _sync_log_table(),
        "landed_forecast": _landed_forecast(),
        "landed_api_filtered": _landed_api_filtered(),
        "carry_forward": _carry_forward(),
        "sync_status": _sync_status(),
        "weather_daily": _weather_daily(),
        "weather_horizon": _weather_horizon(),
        "crop_profile_join": _crop_profile_join(),
        "risk_flags": _risk_flags(),
        "decision": _decision(),
        "facts_text": _facts_text(),
        "reasons_text": _reasons_text(),
        "market_summary": _market_summary(),
        "price_day_over_day": _price_day_over_day(),
        "recent_price_list": _recent_price_list(),
        "history_latest_dates": _history_latest_dates(),
        "history_latest_rows": _history_latest_rows(),
        "history_requests": _history_requests(),
        "latest_row": _latest_row(),
        "latest_per_group_ties": _latest_per_group_ties(),
        "blank_district_lookup": _blank_district_lookup(),
        "optional_filters": _optional_filters(),
        "history_filter_requests": _history_filter_requests(),
        "supported_commodities": _supported_commodities(),
        "markets_per_commodity": _markets_per_commodity(),
    }

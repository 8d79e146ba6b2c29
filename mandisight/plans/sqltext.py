"""SQL text building blocks for the DuckDB oracle.

The oracle re-states every query in plain SQL over the driver tables; these
fragments are the SQL twins of ``sources.driver_tables`` and the numeric
helpers, written independently of the Spark code paths they check.
"""

from __future__ import annotations

TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax"]
SERIES = "state, district, market, commodity"


def rhe(expr: str, digits: int = 0) -> str:
    """Python's ``round``, half to even, in whole numbers: the double times 2**64 is exact (from 2**-12 on), so the
    quotient by the unit and its remainder say where the value lies."""
    times, unit = (10 ** digits, 1) if digits >= 0 else (1, 10 ** -digits)
    one = 2 ** 64
    n = f"CAST(abs(v) * {float(one)!r}::DOUBLE AS HUGEINT) * {times}"
    part, rest = f"(({n}) // {one * unit}::HUGEINT)", f"(2 * (({n}) % {one * unit}::HUGEINT))"
    up = f"(CASE WHEN {rest} > {one * unit}::HUGEINT OR ({rest} = {one * unit}::HUGEINT AND {part} % 2 = 1) THEN 1 ELSE 0 END)"
    back = f"/ {float(times)!r}::DOUBLE" if digits >= 0 else f"* {float(unit)!r}::DOUBLE"
    return (f"list_transform([CAST({expr} AS DOUBLE)], lambda v: CASE WHEN abs(v) >= {2.0**53 / times!r}::DOUBLE THEN v "
            f"ELSE CAST({part} + {up} AS DOUBLE) {back} * (CASE WHEN v < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) END)[1]")


def r4(expr: str) -> str:
    """How results are shown: four decimals of the scaled double, the same bits on any engine."""
    return f"(round_even(CAST({expr} AS DOUBLE) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE)"


def dstr(expr: str) -> str:
    return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d')"


def pct(latest: str, base: str) -> str:
    return (f"(CASE WHEN ({base}) IS NULL OR ({base}) = 0 THEN NULL "
            f"ELSE (({latest}) - ({base})) / ({base}) * 100.0 END)")


def trend(change: str) -> str:
    return (f"(CASE WHEN ({change}) IS NULL OR abs({change}) < 5 THEN 'stable' "
            f"WHEN ({change}) > 0 THEN 'rising' ELSE 'falling' END)")


def cents_text(x: str) -> str:
    cents = f"floor(abs({x}) * 100.0 + 0.5)"
    whole = f"floor({cents} / 100)"
    return (f"((CASE WHEN {x} < 0 THEN '-' ELSE '' END) || format('{{:,}}', CAST({whole} AS BIGINT)) "
            f"|| '.' || lpad(CAST(CAST({cents} - {whole} * 100 AS BIGINT) AS VARCHAR), 2, '0'))")


MARKET_DIM = """
SELECT s.s_suppkey, r.r_name AS state, n.n_name AS district, s.s_name AS market
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

PRICES = f"""
SELECT d.state, d.district, d.market, 'Vegetables' AS commodity_group,
  p.p_type AS commodity, p.p_brand AS variety, l.l_returnflag AS grade,
  (CASE WHEN l.l_quantity = 0 THEN NULL ELSE l.l_extendedprice / l.l_quantity END) * (1.0 - l.l_discount) AS min_price,
  (CASE WHEN l.l_quantity = 0 THEN NULL ELSE l.l_extendedprice / l.l_quantity END) * (1.0 + l.l_tax) AS max_price,
  (CASE WHEN l.l_quantity = 0 THEN NULL ELSE l.l_extendedprice / l.l_quantity END) AS modal_price,
  'Rs./Quintal' AS price_unit, l.l_quantity AS arrival_quantity, 'Metric Tonnes' AS arrival_unit,
  CAST(l.l_shipdate AS DATE) AS arrival_date, l.l_suppkey AS location_id,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, l.l_quantity, l.l_discount, l.l_tax
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
JOIN ({MARKET_DIM}) d ON l.l_suppkey = d.s_suppkey
"""

TIE_DESC = ", ".join(f"{c} DESC" for c in TIES)
TIE_ASC = ", ".join(f"{c} ASC" for c in TIES)

# Keep-last per (series, date): last by (variety, grade, ingest order).
DAILY = f"""
SELECT * EXCLUDE (k) FROM (
  SELECT p.*, row_number() OVER (PARTITION BY {SERIES}, arrival_date
     ORDER BY variety DESC, grade DESC, {TIE_DESC}) AS k
  FROM prices p WHERE arrival_date IS NOT NULL AND modal_price IS NOT NULL AND NOT isnan(modal_price)
) WHERE k = 1
"""

TOP7 = f"""
SELECT * FROM (
  SELECT d.*, row_number() OVER (PARTITION BY {SERIES} ORDER BY arrival_date DESC) AS rn FROM daily d
) WHERE rn <= 7
"""

SUMMARY = f"""
SELECT {SERIES}, arg_max(location_id, arrival_date) AS location_id,
  count(*) AS n_days, min(arrival_date) AS period_from, max(arrival_date) AS period_to,
  arg_max(min_price, arrival_date) AS latest_min_price,
  arg_max(max_price, arrival_date) AS latest_max_price,
  arg_max(modal_price, arrival_date) AS latest_modal_price,
  arg_min(modal_price, arrival_date) AS first_modal_price,
  max(CASE WHEN rn = 2 THEN modal_price END) AS previous_day_modal_price,
  avg(modal_price) AS avg_modal
FROM top7 GROUP BY {SERIES}
"""

SUMMARY_FULL = f"""
SELECT s.*, {rhe('avg_modal', 2)} AS seven_day_average_modal_price,
  {rhe(pct('latest_modal_price', 'previous_day_modal_price'), 2)} AS day_over_day_change_percent,
  {rhe(pct('latest_modal_price', 'first_modal_price'), 2)} AS seven_day_change_percent,
  {trend(pct('latest_modal_price', 'first_modal_price'))} AS trend
FROM summary0 s
"""


def with_ctes(*ctes: tuple[str, str], body: str) -> str:
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH {parts}\n{body}"


BASE_CTES = [("prices", PRICES), ("daily", DAILY), ("top7", TOP7),
             ("summary0", SUMMARY), ("summary", SUMMARY_FULL)]

COMMODITY_CYCLE = ["ECONOMY", "MEDIUM", "STANDARD", "PROMO", "SMALL", "LARGE"]
_cycle = ", ".join(f"'{c}'" for c in COMMODITY_CYCLE)
REQUESTS = f"""
SELECT s_suppkey AS req_id, state,
  CASE WHEN s_suppkey % 3 = 0 THEN district WHEN s_suppkey % 3 = 1 THEN '' ELSE '  ' END AS district,
  market,
  CASE WHEN s_suppkey % 10 = 7 THEN '' ELSE ([{_cycle}])[CAST(s_suppkey % 6 + 1 AS INTEGER)] END AS crop,
  'Telugu' AS language, 12.0::DOUBLE + s_suppkey::DOUBLE / 1000.0::DOUBLE AS latitude,
  78.0::DOUBLE + s_suppkey::DOUBLE / 1000.0::DOUBLE AS longitude,
  s_suppkey AS location_id
FROM ({MARKET_DIM})
"""

# Latest row per series: order (date, variety, grade, ingest) desc.
LATEST_ROW = f"""
SELECT * EXCLUDE (k) FROM (
  SELECT p.*, row_number() OVER (PARTITION BY {SERIES}
     ORDER BY arrival_date DESC, variety DESC, grade DESC, {TIE_DESC}) AS k FROM prices p
) WHERE k = 1
"""

"""Registered queries: one callable per operator group, (spark, sf_dir) -> DataFrame.

Every query reads the whole driver tables (or frames Spark derives from
them); outputs use strings for dates, bigint counts and doubles rounded
half-even at 4 dp after all logic so they compare exactly with the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.numbers import round_half_even, safe_float, scaled_round
from ..operators import cleanse, history, market, rules, upsert
from ..operators.dedupe import keep_last
from ..schemas import KEY_COLUMNS, PRICE_COLUMNS, SERIES
from ..sources import driver_tables as dt
from ..sources.profiles import driver_profile_table
from . import advisory as adv
from . import sync


def r4(c):
    return scaled_round(c, 4)


def d2s(c):
    return F.date_format(c, "yyyy-MM-dd")


def summary_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dt.prices(spark, sf_dir)
    order = market.default_day_order(dt.ingest_order())
    return market.summarize(p, SERIES, 7, order, carry=["location_id"])


def q_market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary_of_prices(spark, sf_dir)
    return s.select(
        *SERIES, F.col("n_days").cast("long").alias("n_days"),
        d2s("period_from").alias("period_from"), d2s("period_to").alias("period_to"),
        r4("latest_min_price").alias("latest_min_price"),
        r4("latest_max_price").alias("latest_max_price"),
        r4("latest_modal_price").alias("latest_modal_price"),
        r4("seven_day_average_modal_price").alias("seven_day_average_modal_price"),
        r4("previous_day_modal_price").alias("previous_day_modal_price"),
        r4("day_over_day_change_percent").alias("day_over_day_change_percent"),
        r4("seven_day_change_percent").alias("seven_day_change_percent"),
        "trend")


def _daily(spark, sf_dir):
    p = dt.prices(spark, sf_dir)
    return market.daily_last(p, SERIES, market.default_day_order(dt.ingest_order()))


def _row_order():
    return F.struct(F.col("variety"), F.col("grade"), dt.ingest_order())


def q_price_day_over_day(spark, sf_dir):
    d = market.day_over_day(_daily(spark, sf_dir))
    return d.select(*SERIES, d2s("arrival_date").alias("arrival_date"),
                    r4("modal_price").alias("modal_price"),
                    r4("previous_modal_price").alias("previous_modal_price"),
                    r4(round_half_even("day_change_percent", 2)).alias("day_change_percent"))


def q_recent_price_list(spark, sf_dir):
    s = summary_of_prices(spark, sf_dir)
    return s.select(*SERIES, F.col("n_days").cast("long").alias("n_days"),
                    market.recent_price_text(F.col("recent_prices")).alias("recent_prices"))


def q_history_latest_dates(spark, sf_dir):
    h = history.latest_n_dates(dt.prices(spark, sf_dir), 7)
    return h.select(*SERIES, d2s("arrival_date").alias("arrival_date"), "variety", "grade",
                    r4("min_price").alias("min_price"), r4("max_price").alias("max_price"),
                    r4("modal_price").alias("modal_price"),
                    F.col("date_rank").cast("long").alias("date_rank"),
                    "l_orderkey", "l_linenumber")


def q_history_latest_rows(spark, sf_dir):
    h = history.latest_n_rows(dt.prices(spark, sf_dir), 30, ["variety", "grade", *dt.TIE_COLUMNS])
    return h.select(*SERIES, d2s("arrival_date").alias("date"),
                    r4("max_price").alias("maxPrice"), r4("modal_price").alias("modalPrice"),
                    r4("min_price").alias("minPrice"),
                    F.col("row_rank").cast("long").alias("row_rank"))


def q_history_requests(spark, sf_dir):
    """H2 + C6: the 30 latest rows of every request, oldest first; a blank district matches any."""
    req = dt.farmer_requests(spark, sf_dir).withColumnRenamed("crop", "commodity")
    h = history.history_for_requests(dt.prices(spark, sf_dir), req, ["variety", "grade", *dt.TIE_COLUMNS])
    return h.select("req_id", F.col("seq").cast("long").alias("seq"), d2s("arrival_date").alias("date"),
                    r4("max_price").alias("maxPrice"), r4("modal_price").alias("modalPrice"),
                    r4("min_price").alias("minPrice"))


def _latest_cols(df):
    return df.select(*SERIES, "commodity_group", "variety", "grade",
                     r4("min_price").alias("min_price"), r4("max_price").alias("max_price"),
                     r4("modal_price").alias("modal_price"), "price_unit",
                     r4("arrival_quantity").alias("arrival_quantity"), "arrival_unit",
                     d2s("arrival_date").alias("arrival_date"))


def q_latest_row(spark, sf_dir):
    keep = [c for c in PRICE_COLUMNS if c not in SERIES]
    return _latest_cols(history.latest_row(dt.prices(spark, sf_dir), _row_order(), keep=keep))


def q_latest_per_group_ties(spark, sf_dir):
    h = history.latest_date_rows(dt.prices(spark, sf_dir))
    return h.select(*SERIES, d2s("arrival_date").alias("arrival_date"), "variety", "grade",
                    r4("modal_price").alias("modal_price"), "l_orderkey", "l_linenumber")


REQUEST_DEFAULTS = adv.REQUEST_DEFAULTS


def q_blank_district_lookup(spark, sf_dir):
    p = dt.prices(spark, sf_dir)
    req = dt.farmer_requests(spark, sf_dir)
    req = req.select("req_id", *[F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(REQUEST_DEFAULTS[c])).alias(c)
                                 for c in ["state", "market"]],
                     "district",
                     F.coalesce(F.when(F.col("crop") != "", F.col("crop")),
                                F.lit(REQUEST_DEFAULTS["crop"])).alias("commodity"))
    order = _row_order()
    latest = history.latest_row(p, order)
    full = latest.select(
        *SERIES, F.col("arrival_date").alias("latest_date"), F.col("modal_price").alias("latest_modal"),
        F.col("variety").alias("latest_variety"))
    # Latest across districts = the greatest of the per-district latest rows
    # (same total order): derived from the small per-series table, no rescan.
    no_d = history.latest_row(latest, order, ["state", "market", "commodity"]).select(
        "state", "market", "commodity", F.col("arrival_date").alias("latest_date"),
        F.col("modal_price").alias("latest_modal"), F.col("variety").alias("latest_variety"))
    out = history.lookup_latest(req, full, no_d)
    return out.select("req_id", "state", "district", "market", "commodity",
                      d2s("latest_date").alias("latest_date"), r4("latest_modal").alias("latest_modal"),
                      "latest_variety")


# Parameter sets of the optional-filter history query (fixed values).
FILTER_SETS = [
    {"commodity": "ECONOMY"},
    {"commodity": "PROMO", "market": "Supplier#000000001"},
    {"commodity": "SMALL", "state": "ASIA", "variety": "Brand#12"},
    {"commodity": "LARGE", "state": "EUROPE", "district": "NATION_3"},
    {"commodity": "MEDIUM", "market": "Supplier#000000002", "variety": "Brand#1",
     "state": "AMERICA", "district": "NATION_1"},
]


def q_optional_filters(spark, sf_dir):
    h = history.filtered_history_sets(dt.prices(spark, sf_dir), FILTER_SETS, 7)
    return h.select(F.col("filter_id").cast("long").alias("filter_id"), *SERIES,
                    d2s("arrival_date").alias("arrival_date"), "variety", "grade",
                    r4("modal_price").alias("modal_price"), "l_orderkey", "l_linenumber")


# Driver commodities accepted by the sync, exact case (two in the wrong case).
DRIVER_SUPPORTED = ["ECONOMY", "MEDIUM", "STANDARD", "PROMO", "small", "Large"]


def q_supported_commodities(spark, sf_dir):
    h = history.supported(dt.prices(spark, sf_dir), DRIVER_SUPPORTED)
    return h.select(*SERIES, d2s("arrival_date").alias("arrival_date"), "variety", "grade",
                    r4("modal_price").alias("modal_price"), "l_orderkey", "l_linenumber")


def q_markets_per_commodity(spark, sf_dir):
    m = history.markets_per_commodity(dt.prices(spark, sf_dir))
    return m.select("commodity", "market", F.col("n_markets").cast("long").alias("n_markets"))


def q_weather_daily(spark, sf_dir):
    d = adv.weather_days(spark, sf_dir)
    return d.select("location_id", "date", r4("min_temp_c").alias("min_temp_c"),
                    r4("max_temp_c").alias("max_temp_c"),
                    r4("rain_probability_max_percent").alias("rain_probability_max_percent"),
                    "conditions", F.col("day_rank").cast("long").alias("day_rank"))


def q_weather_horizon(spark, sf_dir):
    h = adv.weather_horizon(spark, sf_dir)
    return h.select("location_id", "available", "message", "location",
                    r4("latitude").alias("latitude"), r4("longitude").alias("longitude"),
                    r4("max_forecast_temp_c").alias("max_forecast_temp_c"),
                    r4("min_forecast_temp_c").alias("min_forecast_temp_c"),
                    r4("max_rain_probability_percent").alias("max_rain_probability_percent"),
                    "n_days")


def q_crop_profile_join(spark, sf_dir):
    j = rules.attach_profile(dt.prices(spark, sf_dir), driver_profile_table(spark))
    return j.select(*SERIES, d2s("arrival_date").alias("arrival_date"), "variety", "grade",
                    "l_orderkey", "l_linenumber", "crop_name",
                    r4("critical_temp_max_c").alias("critical_temp_max_c"),
                    F.col("storage_life_days").cast("long").alias("storage_life_days"),
                    "perishability", "sell_or_wait_bias")


def q_risk_flags(spark, sf_dir):
    a = adv.advisory_table(spark, sf_dir)
    return a.select(*SERIES, "location_id",
                    F.coalesce("weather_available", F.lit(False)).alias("weather_available"),
                    r4("rule_max_temp_c").alias("max_forecast_temp_c"),
                    r4("rule_min_temp_c").alias("min_forecast_temp_c"),
                    r4("rule_max_rain_percent").alias("max_rain_probability_percent"),
                    "heat_risk", "cold_risk", "rain_risk")


def q_decision(spark, sf_dir):
    a = adv.advisory_table(spark, sf_dir)
    return a.select(*SERIES, "market_signal",
                    r4("seven_day_change_percent").alias("seven_day_change_percent"),
                    r4("latest_modal_price").alias("latest_modal_price"),
                    "heat_risk", "cold_risk", "rain_risk", "crop_storage_signal",
                    "recommended_decision")


def q_facts_text(spark, sf_dir):
    a = adv.advisory_table(spark, sf_dir)
    return a.select(*SERIES, F.size("facts_for_explanation").cast("long").alias("n_facts"),
                    F.array_join("facts_for_explanation", " | ").alias("facts"))


def q_reasons_text(spark, sf_dir):
    a = adv.advisory_table(spark, sf_dir)
    return a.select(*SERIES, F.size("reasons").cast("long").alias("n_reasons"),
                    F.array_join("reasons", "; ").alias("reasons"))


def _canonical_out(df, extra=()):
    return df.select(
        *["state", "district", "market", "commodity_group", "commodity", "variety", "grade"],
        *[r4(c).alias(c) for c in ["min_price", "max_price", "modal_price"]],
        "price_unit", r4("arrival_quantity").alias("arrival_quantity"), "arrival_unit",
        d2s("arrival_date").alias("arrival_date"), *extra)


def q_clean_csv_numbers(spark, sf_dir):
    """RAW landed as report CSV files, scanned positionally (A1), cleansed."""
    import uuid

    from pyspark.sql import types as T

    from ..session import scratch_path
    from ..sources import reports
    path = scratch_path(spark, f"raw-reports-{uuid.uuid4().hex}")
    reports.write_report_rows(dt.raw_reports(spark, sf_dir).select(
        *PRICE_COLUMNS, "l_orderkey", "l_linenumber"), path)
    raw = reports.read_report_rows(spark, path, [("l_orderkey", T.LongType()),
                                                 ("l_linenumber", T.IntegerType())])
    return _canonical_out(cleanse.cleanse_report(raw, extra=["l_orderkey", "l_linenumber"]),
                          ["l_orderkey", "l_linenumber"])


def _api_raw(spark, sf_dir):
    raw = dt.raw_reports(spark, sf_dir)
    return raw.withColumn("arrival_date", F.regexp_replace("arrival_date", "-", "/"))


def q_clean_api_numbers(spark, sf_dir):
    out = cleanse.normalize_api(_api_raw(spark, sf_dir), DRIVER_SUPPORTED, dt.ingest_order(),
                                extra=["l_orderkey", "l_linenumber"])
    return _canonical_out(out, ["l_orderkey", "l_linenumber"])


def q_parse_dates(spark, sf_dir):
    t = dt.date_texts(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", "date_text",
                    d2s(D.parse_report_date("date_text")).alias("report_date"),
                    d2s(D.parse_api_date("date_text")).alias("api_date"),
                    F.date_format(D.parse_lenient_timestamp("date_text"), "yyyy-MM-dd HH:mm:ss").alias("lenient_ts"))


def q_round_ties(spark, sf_dir):
    """Values whose scaled double is a tie, at 2, 1, 0 and -1 decimals, as Python's ``round`` rounds them."""
    n = F.col("l_orderkey") * 100 + F.col("l_partkey") % 100
    half = dt.table(spark, sf_dir, "lineitem").select(
        ((n * 10 + 5) * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).alias("n")).distinct()
    x = F.col("n").cast("double")
    return half.select("n", round_half_even(x / 1000.0, 2).alias("hundredths"), round_half_even(x / 100.0, 1).alias("tenths"),
                       round_half_even(x / 10.0, 0).alias("whole"), round_half_even(x, -1).alias("tens"))


def q_null_defaults(spark, sf_dir):
    p = dt.prices(spark, sf_dir)
    ln = F.col("l_linenumber")
    a = (F.when(ln == 1, F.lit(None).cast("double")).when(ln == 2, F.lit(float("nan")))
         .otherwise(F.col("modal_price")))
    low = F.when(ln == 3, F.lit(None).cast("double")).otherwise(F.col("min_price"))
    camel = F.when(ln.isin(1, 2), F.lit(None).cast("double")).otherwise(F.col("modal_price"))
    snake = F.when(ln == 1, F.lit(None).cast("double")).otherwise(F.col("max_price"))
    return p.select("l_orderkey", "l_linenumber",
                    r4(safe_float(a, 0.0)).alias("safe_modal"),
                    r4(safe_float(low)).alias("safe_min"),
                    r4(F.coalesce(camel, snake, F.lit(0.0))).alias("chart_modal"))


def q_dedupe_keep_last(spark, sf_dir):
    p = dt.prices(spark, sf_dir)
    d = _batch(p)
    return _canonical_out(d, ["l_orderkey", "l_linenumber"])


def _batch(df):
    wanted = [*PRICE_COLUMNS, "l_orderkey", "l_linenumber"]
    return keep_last(df, KEY_COLUMNS, dt.ingest_order(), [c for c in wanted if c not in KEY_COLUMNS]).select(*wanted)


def _upserted(spark, sf_dir, mode):
    t = _batch(dt.target_batch(spark, sf_dir))
    i = _batch(dt.incoming_batch(spark, sf_dir))
    fn = upsert.upsert_full if mode == "full" else upsert.upsert_prices_only
    return fn(t, i, extra=["l_orderkey", "l_linenumber"])


def q_upsert_full(spark, sf_dir):
    return _canonical_out(_upserted(spark, sf_dir, "full"), ["l_orderkey", "l_linenumber", "source"])


def q_upsert_prices_only(spark, sf_dir):
    return _canonical_out(_upserted(spark, sf_dir, "prices"), ["l_orderkey", "l_linenumber", "source"])


def q_upsert_counts(spark, sf_dir):
    return upsert.upsert_counts(_upserted(spark, sf_dir, "prices"))


def q_carry_forward(spark, sf_dir):
    p = dt.prices(spark, sf_dir)
    out = sync.carry_forward(p, sync.run_date_of(p), _row_order())
    return _canonical_out(out, [d2s("carried_from").alias("carried_from")])


def q_sync_status(spark, sf_dir):
    log = dt.sync_log_from_orders(spark, sf_dir)
    total = dt.prices(spark, sf_dir, with_ties=False).select(F.count(F.lit(1))).scalar()
    return sync.sync_log_status(log, total)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_csv_numbers": q_clean_csv_numbers,
    "clean_api_numbers": q_clean_api_numbers,
    "parse_dates": q_parse_dates,
    "null_defaults": q_null_defaults,
    "round_ties": q_round_ties,
    "dedupe_keep_last": q_dedupe_keep_last,
    "upsert_full": q_upsert_full,
    "upsert_prices_only": q_upsert_prices_only,
    "upsert_counts": q_upsert_counts,
    "carry_forward": q_carry_forward,
    "sync_status": q_sync_status,
    "weather_daily": q_weather_daily,
    "weather_horizon": q_weather_horizon,
    "crop_profile_join": q_crop_profile_join,
    "risk_flags": q_risk_flags,
    "decision": q_decision,
    "facts_text": q_facts_text,
    "reasons_text": q_reasons_text,
    "market_summary": q_market_summary,
    "price_day_over_day": q_price_day_over_day,
    "recent_price_list": q_recent_price_list,
    "history_latest_dates": q_history_latest_dates,
    "history_latest_rows": q_history_latest_rows,
    "history_requests": q_history_requests,
    "latest_row": q_latest_row,
    "latest_per_group_ties": q_latest_per_group_ties,
    "blank_district_lookup": q_blank_district_lookup,
    "optional_filters": q_optional_filters,
    "supported_commodities": q_supported_commodities,
    "markets_per_commodity": q_markets_per_commodity,
}
from .catalog_text import QUERIES as _TEXT_QUERIES  # noqa: E402

from .catalog_files import QUERIES as _FILE_QUERIES  # noqa: E402

QUERIES.update(_TEXT_QUERIES)
QUERIES.update(_FILE_QUERIES)
FLAGSHIP = "decision"

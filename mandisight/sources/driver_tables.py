"""Canonical inputs derived from the driver's TPC-H-like tables.

The driver tables carry no market data, so the price store, the forecast
feed, the raw report text and the two upsert batches are derived from them
with one fixed mapping (the same text is used by the SQL oracle):

* prices: ``lineitem`` joined to ``part``, ``supplier``, ``nation``, ``region``;
  state/district/market = region/nation/supplier name, commodity = part type,
  variety = brand, grade = return flag, modal = extended price / quantity.
* forecast: ``events`` per user id (= supplier key, the market's location).

``nation`` and ``region`` are broadcast unconditionally: TPC-H fixes them
at 25 and 5 rows. ``part`` and ``supplier`` grow with the scale factor, so
they are broadcast only behind a size check (``sizing``); above the
bound the planner shuffles both sides on the join key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import cents_text
from .sizing import MAX_BROADCAST_BYTES, file_bytes, spread_small

# Ingest order of a price observation (later = larger); the keep-last rules
# order by these after the business columns.
TIE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
               "l_quantity", "l_discount", "l_tax"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Tables of events and facts; while small, their scans are dealt over the cores.
FACT_TABLES = {"lineitem", "orders", "events", "documents", "customer", "conversations", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a driver table."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread_small(df) if name in FACT_TABLES else df


def market_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> (state, district, market); one row per supplier."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey)
    return (sup.join(F.broadcast(geo), sup.s_nationkey == geo.n_nationkey)
            .select("s_suppkey", F.col("r_name").alias("state"),
                    F.col("n_name").alias("district"), F.col("s_name").alias("market")))


def prices(spark: SparkSession, sf_dir: str, with_ties: bool = True, dealt_by: str | None = None,
           deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """PRICES: the canonical 14-column price table (+ location and tie keys).

    ``dealt_by``: a lineitem column by which the lines are shuffled once more while they are narrow: behind the joins
    that need a shuffle, before those that broadcast and widen them. A grouping by that column needs no shuffle of
    its own. ``deal`` is given the joined lines before anything is computed from them.
    """
    li = table(spark, sf_dir, "lineitem") if dealt_by is None else spark.read.parquet(table_path(sf_dir, "lineitem"))
    j = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                  "l_quantity", "l_discount", "l_tax", "l_returnflag", F.col("l_shipdate").cast("date").alias("l_shipdate"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    dims = [(is_small(spark, sf_dir, "part"), part, "l_partkey", "p_partkey"),
            (is_small(spark, sf_dir, "supplier"), market_dim(spark, sf_dir), "l_suppkey", "s_suppkey")]
    for small, dim, key, of in dims:
        if not small:
            j = j.join(dim, j[key] == dim[of])
    if dealt_by is not None:
        j = j.repartition(dealt_by)
    for small, dim, key, of in dims:
        if small:
            j = j.join(F.broadcast(dim), j[key] == dim[of])
    if deal is not None:
        j = deal(j)
    modal = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    cols: list[Column] = [
        F.col("state"), F.col("district"), F.col("market"),
        F.lit("Vegetables").alias("commodity_group"),
        F.col("p_type").alias("commodity"), F.col("p_brand").alias("variety"),
        F.col("l_returnflag").alias("grade"),
        (modal * (F.lit(1.0) - F.col("l_discount"))).alias("min_price"),
        (modal * (F.lit(1.0) + F.col("l_tax"))).alias("max_price"),
        modal.alias("modal_price"),
        F.lit("Rs./Quintal").alias("price_unit"),
        F.col("l_quantity").alias("arrival_quantity"),
        F.lit("Metric Tonnes").alias("arrival_unit"),
        F.col("l_shipdate").alias("arrival_date"),
        F.col("l_suppkey").alias("location_id"),
    ]
    if with_ties:
        cols += [F.col(c) for c in TIE_COLUMNS]
    return j.select(*cols)


def is_small(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether ``prices`` broadcasts a dimension."""
    return file_bytes(table(spark, sf_dir, name)) <= MAX_BROADCAST_BYTES


def ingest_order() -> Column:
    """Struct that totally orders duplicates of a key by arrival."""
    return F.struct(*[F.col(c) for c in TIE_COLUMNS])


def forecast_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast entries per location, already flattened (C8/I4/I5 inputs).

    Every fifth location reports a failed forecast status (``cod`` 404), so
    some markets have no usable weather, as when the provider is down.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        F.col("user_id").alias("location_id"),
        F.when(F.col("user_id") % 5 == 4, F.lit("404")).otherwise(F.lit("200")).alias("cod"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dt_txt"),
        (F.lit(12.0) + F.col("value") * F.lit(0.15)).alias("temp"),
        (k * F.lit(0.62) / F.lit(100.0)).alias("pop"),
        F.col("event_type").alias("description"),
        F.concat(F.lit("Location "), F.col("user_id").cast("string")).alias("city_name"),
        (F.lit(12.0) + F.col("user_id") / F.lit(1000.0)).alias("lat"),
        (F.lit(78.0) + F.col("user_id") / F.lit(1000.0)).alias("lon"),
    )


def raw_market() -> Column:
    """The market as a report names it."""
    return F.when(F.col("l_linenumber") == 5, F.lit("NA")).otherwise(F.col("market"))


def raw_reports(spark: SparkSession, sf_dir: str, dealt_by: str | None = None,
                deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """RAW: prices rendered as report text, with dirt keyed by line number.

    line 1: blank modal price; 2: ``N/A`` min price; 3: impossible date;
    4: padded state; 5: ``NA`` market; 6: garbage max price; 7: clean.
    ``dealt_by`` and ``deal``: see ``prices``; the texts are made of what they leave.
    """
    p = prices(spark, sf_dir, dealt_by=dealt_by, deal=deal)
    ln = F.col("l_linenumber")
    date_txt = F.date_format("arrival_date", "dd-MM-yyyy")
    return p.select(
        F.when(ln == 4, F.concat(F.lit("  "), F.col("state"), F.lit(" "))).otherwise(F.col("state")).alias("state"),
        F.col("district"),
        raw_market().alias("market"),
        F.col("commodity_group"), F.col("commodity"), F.col("variety"), F.col("grade"),
        F.when(ln == 2, F.lit("N/A")).otherwise(cents_text("min_price")).alias("min_price"),
        F.when(ln == 6, F.lit("1,2x3")).otherwise(cents_text("max_price")).alias("max_price"),
        F.when(ln == 1, F.lit("")).otherwise(cents_text("modal_price")).alias("modal_price"),
        F.col("price_unit"),
        F.format_number(F.col("arrival_quantity"), 2).alias("arrival_quantity"),
        F.col("arrival_unit"),
        F.when(ln == 3, F.lit("31-02-1999")).otherwise(date_txt).alias("arrival_date"),
        *[F.col(c) for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                             "l_quantity", "l_discount", "l_tax"]],
    )


# The store holds reports up to the end of 1999; the incoming batch re-sends
# 1999 (late corrections) and brings everything after it.
TARGET_LAST_DATE = "1999-12-31"
INCOMING_FIRST_DATE = "1999-01-01"


def target_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TARGET rows before keep-last: reports up to ``TARGET_LAST_DATE``."""
    return prices(spark, sf_dir).where(F.col("arrival_date") <= F.lit(TARGET_LAST_DATE).cast("date"))


def incoming_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INCOMING rows: from ``INCOMING_FIRST_DATE``, prices x1.1, API-style NULLs."""
    p = prices(spark, sf_dir).where(F.col("arrival_date") >= F.lit(INCOMING_FIRST_DATE).cast("date"))
    return p.select(
        *[F.col(c) for c in ["state", "district", "market"]],
        F.lit(None).cast("string").alias("commodity_group"),
        "commodity", "variety", "grade",
        (F.col("min_price") * F.lit(1.1)).alias("min_price"),
        (F.col("max_price") * F.lit(1.1)).alias("max_price"),
        (F.col("modal_price") * F.lit(1.1)).alias("modal_price"),
        "price_unit",
        F.lit(None).cast("double").alias("arrival_quantity"),
        F.lit(None).cast("string").alias("arrival_unit"),
        "arrival_date", "location_id", *TIE_COLUMNS)


# Commodities in the order the request builder cycles through them.
COMMODITY_CYCLE = ["ECONOMY", "MEDIUM", "STANDARD", "PROMO", "SMALL", "LARGE"]


def farmer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advisory/market request per supplier (the market's own farmers).

    District is given, blank or whitespace by supplier key; every tenth
    request leaves the crop empty (the advisory default then applies).
    """
    dim = market_dim(spark, sf_dir)
    k = F.col("s_suppkey")
    crop = F.element_at(F.array(*[F.lit(c) for c in COMMODITY_CYCLE]),
                        (k % len(COMMODITY_CYCLE) + 1).cast("int"))
    return dim.select(
        k.alias("req_id"), F.col("state"),
        F.when(k % 3 == 0, F.col("district")).when(k % 3 == 1, F.lit(""))
        .otherwise(F.lit("  ")).alias("district"),
        F.col("market"),
        F.when(k % 10 == 7, F.lit("")).otherwise(crop).alias("crop"),
        F.lit("Telugu").alias("language"),
        (F.lit(12.0) + k / F.lit(1000.0)).alias("latitude"),
        (F.lit(78.0) + k / F.lit(1000.0)).alias("longitude"),
        k.alias("location_id"),
    )


def prices_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRICES in which every ninth market reports no modal price, so its series hold no valid record."""
    return prices(spark, sf_dir).withColumn(
        "modal_price", F.when(F.col("location_id") % 9 != 4, F.col("modal_price")))


def payload_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advisory request per supplier for its own place; every tenth names a market that reports nothing."""
    own = farmer_requests(spark, sf_dir).drop("district", "market", "crop").join(
        market_dim(spark, sf_dir).select(F.col("s_suppkey").alias("req_id"), "district", "market"), "req_id")
    k = F.col("req_id")
    crop = F.element_at(F.array(*[F.lit(c) for c in COMMODITY_CYCLE]), (k % len(COMMODITY_CYCLE) + 1).cast("int"))
    return own.withColumns({"market": F.when(k % 10 == 7, F.lit("Nowhere")).otherwise(F.col("market")), "crop": crop})


def filter_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history request per supplier and filter mask: its own place, the crop of its turn, a brand of its turn;
    the bits of the mask say which of state, district, market and variety are set. Every seventh supplier asks
    with the mask of its key alone and names no commodity."""
    dim = market_dim(spark, sf_dir).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(15))))
    k, mask = F.col("s_suppkey"), F.col("mask")
    crop = F.element_at(F.array(*[F.lit(c) for c in COMMODITY_CYCLE]), (k % len(COMMODITY_CYCLE) + 1).cast("int"))
    brand = F.concat(F.lit("Brand#"), ((k + mask) % 25 + 1).cast("string"))
    return dim.where((k % 7 != 3) | (mask == k % 16)).select(
        (k * 16 + mask).alias("req_id"), F.when(k % 7 != 3, crop).alias("commodity"),
        *[F.when(mask.bitwiseAND(1 << b) != 0, value).alias(name) for b, (name, value) in enumerate(
            [("state", F.col("state")), ("district", F.col("district")), ("market", F.col("market")), ("variety", brand)])])


def sync_log_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync log rows: one entry per order month, records added = orders in it."""
    o = table(spark, sf_dir, "orders").select("o_orderdate")
    month = F.date_trunc("month", F.col("o_orderdate"))
    per = o.groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(
        (F.year("m") * 12 + F.month("m")).cast("long").alias("id"),
        F.date_format("m", "yyyy-MM-dd'T'HH:mm:ss").alias("synced_at"),
        F.col("n").cast("int").alias("records_added"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates written the ways feeds write them (one style per line number)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    d = F.col("l_shipdate")
    ln = F.col("l_linenumber")
    text = (F.when(ln == 1, F.date_format(d, "dd-MM-yyyy"))
            .when(ln == 2, F.date_format(d, "dd/MM/yyyy"))
            .when(ln == 3, F.date_format(d, "d-M-yyyy"))
            .when(ln == 4, F.lit("31-02-1999"))
            .when(ln == 5, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
            .when(ln == 6, F.lit("N/A"))
            .otherwise(F.date_format(d, "yyyy-MM-dd")))
    return li.select("l_orderkey", "l_linenumber", text.alias("date_text"))


def api_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW re-landed as API responses: one envelope per order (its lines in
    line order), dates ``dd/MM/yyyy``, every eleventh order a failed batch."""
    raw = raw_reports(spark, sf_dir, dealt_by="l_orderkey")
    rec = F.struct(*[F.col(c) for c in ["state", "district", "market", "commodity", "variety", "grade"]],
                   F.regexp_replace("arrival_date", "-", "/").alias("arrival_date"),
                   "min_price", "max_price", "modal_price", "l_linenumber")
    per = raw.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(
        F.struct(F.col("l_linenumber").alias("_ln"), rec.alias("r")))).alias("recs"))
    return per.select(
        F.col("l_orderkey").alias("batch_id"),
        F.when(F.col("l_orderkey") % 11 == 0, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.transform("recs", lambda x: x["r"]).alias("records"))

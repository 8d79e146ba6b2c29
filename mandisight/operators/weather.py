"""Forecast reduction.

Input is flat forecast blocks, one row per 3-hour entry:
``location_id, cod, dt_txt, temp, pop, description, city_name, lat, lon``.
Daily reduction is a partial aggregate on (location, date) and the 5-day
horizon a ``row_number`` limit on one row per date, so a location with a
huge feed is combined map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_lenient_timestamp
from ..functions.numbers import round_half_even, safe_float
from ..schemas import FORECAST_DOC

HORIZON_DAYS = 5
# Availability messages.
MSG_UNAVAILABLE = "Weather forecast is unavailable."
MSG_EMPTY = "Weather forecast contains no entries."


def read_forecast_docs(spark: SparkSession, path: str) -> DataFrame:
    """A4: landed forecast documents (JSON lines) -> flat blocks of the latest document per location.

    The latest is the one with the greatest ``fetched_at``, then the newest
    file, then the last line; it is chosen whole, before any reduction, so a
    stale document adds neither dates nor a status. Documents without a
    location are one location of their own.
    """
    docs = spark.read.schema(FORECAST_DOC).json(path)
    order = F.struct("fetched_at", F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"),
                     F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return blocks_from_docs(latest_documents(docs, order))


def latest_documents(docs: DataFrame, order: Column) -> DataFrame:
    """One document per location, the one of greatest ``order`` (combined in every task before the shuffle)."""
    latest = docs.select("location_id", F.struct("cod", "city", "list").alias("d"), order.alias("o"))
    return latest.groupBy("location_id").agg(F.max_by("d", "o").alias("d")).select("location_id", "d.*")


def blocks_from_docs(docs: DataFrame) -> DataFrame:
    """Explode ``list`` keeping documents with no entries (as NULL blocks)."""
    e = docs.select("location_id", F.col("cod"), F.col("city"),
                    F.explode_outer("list").alias("e"))
    return e.select(
        "location_id", "cod",
        F.col("e.dt_txt").alias("dt_txt"), F.col("e.main.temp").alias("temp"),
        F.col("e.pop").alias("pop"),
        F.get(F.col("e.weather"), 0)["description"].alias("description"),
        F.col("city.name").alias("city_name"), F.col("city.coord.lat").alias("lat"),
        F.col("city.coord.lon").alias("lon"))


def _ok(cod):
    return F.col(cod).cast("string") == F.lit("200")


def per_day(blocks: DataFrame) -> DataFrame:
    """One partial aggregate per (location, date) over every block.

    Carries the document status, entry counts and place next to the daily
    extremes, so both the daily table and the per-location horizon are read
    from this one reduction of the blocks.
    """
    ts = parse_lenient_timestamp(F.col("dt_txt"))
    temp = safe_float("temp")
    valid = ts.isNotNull() & temp.isNotNull()
    rain = F.coalesce(safe_float("pop"), F.lit(0.0)) * F.lit(100.0)
    cond = F.coalesce(F.col("description"), F.lit("unknown"))
    return (blocks
            .select("location_id", _ok("cod").alias("ok"), F.col("dt_txt"), "city_name", "lat", "lon",
                    F.date_format(ts, "yyyy-MM-dd").alias("date"),
                    F.when(valid, temp).alias("temp_c"), F.when(valid, rain).alias("rain_pct"),
                    F.when(valid, cond).alias("condition"))
            .groupBy("location_id", "date").agg(
                F.max("ok").alias("status_ok"), F.count("dt_txt").alias("n_entries"),
                F.count("temp_c").alias("n_valid"), F.max("city_name").alias("city_name"),
                F.max("lat").alias("lat"), F.max("lon").alias("lon"),
                F.min("temp_c").alias("min_temp"), F.max("temp_c").alias("max_temp"),
                F.max("rain_pct").alias("rain_max"),
                F.array_join(F.array_sort(F.collect_set("condition")), ", ").alias("conditions")))


def daily(blocks: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """G1 + H5: first five forecast dates per available location."""
    d = days if days is not None else per_day(blocks)
    ok = d.where(F.col("status_ok") & (F.col("n_valid") > 0) & F.col("date").isNotNull())
    w = Window.partitionBy("location_id").orderBy("date")
    first = ok.withColumn("day_rank", F.row_number().over(w)).where(F.col("day_rank") <= HORIZON_DAYS)
    return first.select(
        "location_id", "date",
        round_half_even("min_temp", 2).alias("min_temp_c"),
        round_half_even("max_temp", 2).alias("max_temp_c"),
        round_half_even(F.coalesce("rain_max", F.lit(0.0)), 0).alias("rain_probability_max_percent"),
        "conditions", "day_rank")


def horizon(blocks: DataFrame, with_days: bool = False) -> DataFrame:
    """G2 + I21: per-location extremes over the first five valid dates, with
    availability, from one scan of the blocks.

    Per-(location, date) rows (``per_day``) are ranked per location with valid
    dates first, then one aggregate per location reads the status over all
    dates and the extremes over ranks 1-5; the aggregate reuses the window's
    clustering, so the chain has two exchanges and no second scan.
    ``with_days`` adds ``daily_forecast``, the days themselves.
    """
    d = per_day(blocks)
    valid = d["status_ok"] & (d["n_valid"] > 0) & d["date"].isNotNull()
    w = Window.partitionBy("location_id").orderBy(valid.desc(), F.col("date"))
    ranked = d.withColumn("_valid", valid).withColumn("_rank", F.row_number().over(w))
    kept = F.col("_valid") & (F.col("_rank") <= HORIZON_DAYS)
    roll = ranked.groupBy("location_id").agg(
        F.max("status_ok").alias("status_ok"), F.sum("n_entries").alias("n_entries"),
        F.max("city_name").alias("city_name"), F.max("lat").alias("lat"), F.max("lon").alias("lon"),
        F.max(F.when(kept, round_half_even("max_temp", 2))).alias("max_forecast_temp_c"),
        F.min(F.when(kept, round_half_even("min_temp", 2))).alias("min_forecast_temp_c"),
        F.max(F.when(kept, round_half_even(F.coalesce("rain_max", F.lit(0.0)), 0))).alias("_rain"),
        F.sum(F.when(kept, 1).otherwise(0)).alias("n_days"),
        *([F.array_sort(F.collect_list(F.when(kept, _day_item()))).alias("_days")] if with_days else []))
    available = F.col("status_ok") & (F.col("n_entries") > 0)
    return roll.select(
        "location_id",
        available.alias("available"),
        F.when(~F.col("status_ok"), F.lit(MSG_UNAVAILABLE))
        .when(F.col("n_entries") == 0, F.lit(MSG_EMPTY)).alias("message"),
        F.when(available, F.coalesce("city_name", F.lit("Unknown"))).alias("location"),
        F.when(available, F.col("lat")).alias("latitude"),
        F.when(available, F.col("lon")).alias("longitude"),
        F.when(available, F.col("max_forecast_temp_c")).alias("max_forecast_temp_c"),
        F.when(available, F.col("min_forecast_temp_c")).alias("min_forecast_temp_c"),
        F.when(available, F.coalesce("_rain", F.lit(0.0))).otherwise(F.lit(0.0))
        .alias("max_rain_probability_percent"),
        F.when(available, F.col("n_days")).otherwise(F.lit(0)).cast("long").alias("n_days"),
        *([F.when(available, F.col("_days")).alias("daily_forecast")] if with_days else []))


def _day_item() -> Column:
    """A day of the payload's forecast; at most HORIZON_DAYS of them are listed per location."""
    return F.struct("date", round_half_even("min_temp", 2).alias("min_temp_c"), round_half_even("max_temp", 2).alias("max_temp_c"),
                    round_half_even(F.coalesce("rain_max", F.lit(0.0)), 0).alias("rain_probability_max_percent"), "conditions")

"""Market-price summary per series.

Plan shape for every series at once:

1. keep-last per (series, date) as a partial aggregate (skew-safe: a hot
   series is combined map-side, one row per date leaves each task);
2. ``row_number`` over (series ORDER BY date DESC) <= n: Catalyst adds a
   partial ``WindowGroupLimit`` below the shuffle, so at most n dates per
   series cross it;
3. one aggregate per series on the already clustered window output (no
   further exchange).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import pct_change, round_half_even, trend_label
from ..schemas import SERIES
from .dedupe import keep_last

DAY_FIELDS = ["modal_price", "min_price", "max_price", "price_unit"]


def default_day_order(ingest: Column | None = None) -> Column:
    """Within one reporting date the kept row is the last by (variety, grade,
    ingest order)."""
    parts = [F.col("variety"), F.col("grade")]
    if ingest is not None:
        parts.append(ingest)
    return F.struct(*parts)


def daily_last(prices: DataFrame, series: Sequence[str] = SERIES,
               order: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """D3 after C7: one row per (series, arrival_date), NULL date/modal dropped."""
    order = order if order is not None else default_day_order()
    valid = prices.where(F.col("arrival_date").isNotNull() & F.col("modal_price").isNotNull()
                         & ~F.isnan("modal_price"))
    cols = list(series) + ["arrival_date"] + DAY_FIELDS + list(carry)
    return keep_last(valid.select(*cols, order.alias("_ord")),
                     list(series) + ["arrival_date"], F.col("_ord")).drop("_ord")


def latest_dates(daily: DataFrame, series: Sequence[str] = SERIES, n: int = 7) -> DataFrame:
    """H4: the n latest reporting dates per series; ``rn`` 1 = latest."""
    w = Window.partitionBy(*series).orderBy(F.col("arrival_date").desc())
    return daily.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def day_over_day(daily: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """H6 + I1 over the whole deduped series: previous reporting date's price."""
    w = Window.partitionBy(*series).orderBy("arrival_date")
    prev = F.lag("modal_price").over(w)
    return (daily.withColumn("previous_modal_price", prev)
            .withColumn("day_change_percent", pct_change("modal_price", "previous_modal_price")))


def summarize(prices: DataFrame, series: Sequence[str] = SERIES, n: int = 7,
              order: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One summary row per series with at least one valid record."""
    return summarize_days(latest_dates(daily_last(prices, series, order, carry), series, n), series, carry)


def summarize_days(top: DataFrame, series: Sequence[str] = SERIES, carry: Sequence[str] = ()) -> DataFrame:
    """``summarize`` of rows that are already each series' latest days (one per date, ``rn`` 1 = latest)."""
    latest = F.max_by(F.struct(*[F.col(c) for c in DAY_FIELDS + list(carry)]), "arrival_date")
    agg = top.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("arrival_date").alias("period_from"),
        F.max("arrival_date").alias("period_to"),
        latest.alias("_latest"),
        F.min_by("modal_price", "arrival_date").alias("first_modal_price"),
        F.max(F.when(F.col("rn") == 2, F.col("modal_price"))).alias("previous_day_modal_price"),
        F.avg("modal_price").alias("_avg"),
        F.array_sort(F.collect_list(F.struct(
            F.col("arrival_date").alias("date"), "modal_price", "max_price", "min_price")))
        .alias("recent_prices"),
    )
    change = pct_change(F.col("_latest.modal_price"), F.col("first_modal_price"))
    day = pct_change(F.col("_latest.modal_price"), F.col("previous_day_modal_price"))
    return agg.select(
        *series, *[F.col("_latest")[c].alias(c) for c in carry],
        F.lit(True).alias("available"),
        "n_days", "period_from", "period_to",
        F.col("period_to").alias("latest_date"),
        F.col("_latest.min_price").alias("latest_min_price"),
        F.col("_latest.max_price").alias("latest_max_price"),
        F.col("_latest.modal_price").alias("latest_modal_price"),
        F.coalesce(F.col("_latest.price_unit"), F.lit("Rs./Quintal")).alias("price_unit"),
        "first_modal_price",
        round_half_even("_avg", 2).alias("seven_day_average_modal_price"),
        "previous_day_modal_price",
        round_half_even(day, 2).alias("day_over_day_change_percent"),
        round_half_even(change, 2).alias("seven_day_change_percent"),
        trend_label(change).alias("trend"),
        "recent_prices",
    )


# Why a market summary is not available.
MSG_NO_RECORDS = "No market-price records found."
MSG_NO_VALID = "No valid market-price records found."


def with_availability(joined: DataFrame, prices: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """``available`` and ``market_message`` for rows left-joined with summaries on ``series``.

    A series without a summary either has no record at all or none with a date and a price. One partial aggregate
    over the series of the prices tells; a series with a NULL part matches nothing, as in the request's SQL.
    """
    recorded = prices.groupBy(*series).agg(F.lit(True).alias("_recorded"))
    out = joined.join(recorded, list(series), "left")
    available = F.coalesce(F.col("available"), F.lit(False))
    message = F.when(~available, F.when(F.col("_recorded"), F.lit(MSG_NO_VALID)).otherwise(F.lit(MSG_NO_RECORDS)))
    return out.withColumn("market_message", message).withColumn("available", available).drop("_recorded")


def recent_price_text(recent: Column) -> Column:
    """G8 rendered: ``yyyy-MM-dd=price`` items joined by ", " in date order."""
    item = lambda s: F.concat(F.date_format(s["date"], "yyyy-MM-dd"), F.lit("="),
                              F.format_string("%.2f", round_half_even(s["modal_price"], 2)))
    return F.array_join(F.transform(recent, item), ", ")

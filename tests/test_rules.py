"""Rule-engine boundary cases: strict comparisons, rounding before tests,
gating by sensitivity, the 5-date horizon and the decision order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mandisight.operators import market, rules, weather
from mandisight.schemas import PRICE_SCHEMA
from mandisight.sources.profiles import PROFILE_DDL, PROFILE_VALUES


def _profiles(spark, extra=()):
    rows = [(r[0],) + tuple(r) for r in PROFILE_VALUES] + [(r[0],) + tuple(r) for r in extra]
    return spark.createDataFrame(rows, "commodity_key string, " + PROFILE_DDL).drop("crop_key")


def _blocks(spark, loc, entries, cod="200"):
    """entries: (datetime text, temp, pop)"""
    rows = [(loc, cod, t, temp, pop, "clear sky", "Town", 13.5, 78.5) for t, temp, pop in entries]
    return spark.createDataFrame(
        rows, "location_id long, cod string, dt_txt string, temp double, pop double, "
              "description string, city_name string, lat double, lon double")


def _summary(spark, crop, prices, loc=1):
    start = dt.date(2026, 7, 1)
    rows = [("AP", "D", "M", "Vegetables", crop, "V", "FAQ", float(p), float(p), float(p), "Rs./Quintal", 1.0, "t",
             start + dt.timedelta(days=i)) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, PRICE_SCHEMA).withColumn("location_id", F.lit(loc).cast("long"))
    return market.summarize(df, carry=["location_id"])


def _run(spark, crop, prices, entries, extra_profiles=(), cod="200"):
    s = _summary(spark, crop, prices)
    blocks = _blocks(spark, 1, entries, cod) if entries else _blocks(spark, 1, [("2026-07-10 00:00:00", 20.0, 0.0)], "404")
    h = weather.horizon(blocks)
    return rules.rule_engine(rules.assemble(s, h, _profiles(spark, extra_profiles))).first()


def day(d, h=0):
    return f"2026-07-{d:02d} {h:02d}:00:00"


@pytest.mark.parametrize("temp,expect", [(32.2, False), (32.21, True), (32.204, False)])
def test_heat_strict_after_rounding(spark, temp, expect):
    r = _run(spark, "tomato", [100, 100], [(day(10), 20.0, 0.0), (day(10, 3), temp, 0.0)])
    assert r.heat_risk is expect


def test_heat_gated_by_sensitivity(spark):
    r = _run(spark, "potato", [100, 100], [(day(10), 45.0, 0.0)])
    assert r.heat_risk is False


@pytest.mark.parametrize("temp,expect", [(12.7, False), (12.69, True)])
def test_cold_strict(spark, temp, expect):
    r = _run(spark, "tomato", [100, 100], [(day(10), temp, 0.0)])
    assert r.cold_risk is expect


@pytest.mark.parametrize("pop,expect", [(0.596, True), (0.594, False)])
def test_rain_rounded_before_test(spark, pop, expect):
    r = _run(spark, "potato", [100, 100], [(day(10), 20.0, pop)])
    assert r.rain_risk is expect


def test_rain_gated(spark):
    r = _run(spark, "brinjal", [100, 100], [(day(10), 20.0, 1.0)])
    assert r.rain_risk is False


def test_sixth_date_ignored(spark):
    entries = [(day(d), 20.0, 0.0) for d in range(10, 15)] + [(day(15), 40.0, 0.0)]
    r = _run(spark, "tomato", [100, 100], entries)
    assert r.heat_risk is False and r.forecast_days == 5


@pytest.mark.parametrize("last,trend", [(105.0, "rising"), (95.0, "falling"), (104.99, "stable")])
def test_trend_dead_band(spark, last, trend):
    r = _run(spark, "onion", [100.0, last], [])
    assert r.trend == trend


def test_zero_first_price(spark):
    r = _run(spark, "onion", [0.0, 10.0], [])
    assert r.seven_day_change_percent is None and r.trend == "stable"


def test_unavailable_weather_no_risk(spark):
    r = _run(spark, "tomato", [100, 100], [])
    assert r.weather_available is False
    assert (r.heat_risk, r.cold_risk, r.rain_risk) == (False, False, False)
    assert r.recommended_decision == "sell_soon"


def test_risk_overrides_wait(spark):
    r = _run(spark, "onion", [100.0, 120.0], [(day(10), 20.0, 0.9)])
    assert r.trend == "rising" and r.rain_risk
    assert r.recommended_decision == "sell_within_1_to_3_days"


def test_perishable_falling_sells(spark):
    r = _run(spark, "brinjal", [100.0, 50.0], [(day(10), 20.0, 0.0)])
    assert r.recommended_decision == "sell_soon"


@pytest.mark.parametrize("storage,decision", [(7, "monitor_for_1_day_before_selling"), (6, "sell_soon")])
def test_storage_edge(spark, storage, decision):
    extra = [(f"crop{storage}", f"Crop{storage}", 40.0, 0.0, False, False, False, storage, "medium", "x")]
    r = _run(spark, f"crop{storage}", [100.0, 120.0], [(day(10), 20.0, 0.0)], extra)
    assert r.recommended_decision == decision
    assert f"Crop{storage} has moderate storage limitations." in r.reasons


def test_facts_text(spark):
    r = _run(spark, "tomato", [100.0, 120.0], [(day(10), 33.0, 0.0)])
    assert r.facts_for_explanation[0] == "Latest modal price is Rs.120 per quintal."
    assert r.facts_for_explanation[1] == "Seven-day price change is +20.00% and the trend is rising."
    assert r.facts_for_explanation[2] == ("Maximum forecast temperature is 33.0°C, above Tomato's "
                                          "critical maximum of 32.2°C.")
    assert r.reasons == ["High temperature may reduce Tomato quality or yield.",
                         "Tomato is highly perishable."]

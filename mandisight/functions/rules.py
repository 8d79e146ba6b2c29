"""Rule-engine column expressions.

Inputs are columns of the joined (market summary, weather horizon, crop
profile) row; every expression is a built-in Spark expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_half_even

# Decision labels.
SELL_1_TO_3 = "sell_within_1_to_3_days"
SELL_SOON = "sell_soon"
MONITOR_1_DAY = "monitor_for_1_day_before_selling"
RAIN_RISK_PERCENT = 60
MIN_STORAGE_DAYS_TO_WAIT = 7

# Fact and reason sentences ({} = crop name or a number).
FACT_PRICE = "Latest modal price is Rs.%s per quintal."
FACT_CHANGE = "Seven-day price change is %s%% and the trend is %s."
FACT_HEAT = "Maximum forecast temperature is %s°C, above %s's critical maximum of %s°C."
FACT_COLD = "Minimum forecast temperature is %s°C, below %s's critical minimum of %s°C."
FACT_RAIN = "Maximum forecast rain probability is %s%%."
REASON_HEAT = "High temperature may reduce %s quality or yield."
REASON_COLD = "Low temperature may damage %s."
REASON_RAIN = "Rain may increase harvest, transport, or storage risk for %s."
REASON_HIGH_PERISH = "%s is highly perishable."
REASON_MEDIUM_PERISH = "%s has moderate storage limitations."


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt0(x) -> Column:
    """Python ``:.0f`` (half-even) as text."""
    return round_half_even(_c(x), 0).cast("long").cast("string")


def fmt1(x) -> Column:
    """Python ``:.1f`` as text (round first, then print one decimal)."""
    return F.when(_c(x).isNotNull(), F.format_string("%.1f", round_half_even(_c(x), 1)))


def fmt_signed2(x) -> Column:
    """Python ``:+.2f`` as text."""
    return F.when(_c(x).isNotNull(), F.format_string("%+.2f", round_half_even(_c(x), 2)))


def heat_risk(max_temp, critical_max, heat_sensitive) -> Column:
    """Gated by heat sensitivity; strict ``>`` on the rounded maximum."""
    return (F.coalesce(_c(heat_sensitive), F.lit(False))
            & F.coalesce(_c(max_temp) > _c(critical_max), F.lit(False)))


def rain_risk(max_rain, rain_sensitive, waterlogging_sensitive) -> Column:
    """I8: rounded rain probability >= 60 and rain or waterlogging sensitive."""
    sens = F.coalesce(_c(rain_sensitive), F.lit(False)) | F.coalesce(_c(waterlogging_sensitive), F.lit(False))
    return F.coalesce(_c(max_rain) >= RAIN_RISK_PERCENT, F.lit(False)) & sens


def cold_risk(available, min_temp, critical_min) -> Column:
    """Not gated by frost sensitivity; strict ``<``."""
    return (F.coalesce(_c(available), F.lit(False))
            & F.coalesce(_c(min_temp) < _c(critical_min), F.lit(False)))


def decision(heat, cold, rain, bias, trend, storage_days, perishability) -> Column:
    """First matching policy wins."""
    any_risk = _c(heat) | _c(cold) | _c(rain)
    can_wait = ((_c(trend) == "rising") & _c(storage_days).isNotNull()
                & (_c(storage_days) >= MIN_STORAGE_DAYS_TO_WAIT)
                & ~F.coalesce(_c(perishability) == "high", F.lit(False)))
    return (F.when(any_risk, F.lit(SELL_1_TO_3))
            .when((F.coalesce(_c(bias), F.lit("")) == "sell_fast_if_perishable")
                  & (_c(trend) == "falling"), F.lit(SELL_SOON))
            .when(can_wait, F.lit(MONITOR_1_DAY))
            .otherwise(F.lit(SELL_SOON)))


def facts(latest_price, change, trend, heat, cold, rain, max_temp, min_temp, max_rain,
          crop_name, critical_max, critical_min) -> Column:
    """Conditional sentences in fixed order, NULLs dropped."""
    cn = _c(crop_name)
    return F.array_compact(F.array(
        F.when(_c(latest_price).isNotNull(), F.format_string(FACT_PRICE, fmt0(latest_price))),
        F.when(_c(change).isNotNull(), F.format_string(FACT_CHANGE, fmt_signed2(change), _c(trend))),
        F.when(_c(heat), F.format_string(FACT_HEAT, fmt1(max_temp), cn, fmt1(critical_max))),
        F.when(_c(cold), F.format_string(FACT_COLD, fmt1(min_temp), cn, fmt1(critical_min))),
        F.when(_c(rain), F.format_string(FACT_RAIN, fmt0(max_rain))),
    ))


def reasons(heat, cold, rain, perishability, crop_name) -> Column:
    """Risk reasons then the perishability reason."""
    cn = _c(crop_name)
    per = _c(perishability)
    return F.array_compact(F.array(
        F.when(_c(heat), F.format_string(REASON_HEAT, cn)),
        F.when(_c(cold), F.format_string(REASON_COLD, cn)),
        F.when(_c(rain), F.format_string(REASON_RAIN, cn)),
        F.when(per == "high", F.format_string(REASON_HIGH_PERISH, cn))
        .when(per == "medium", F.format_string(REASON_MEDIUM_PERISH, cn)),
    ))

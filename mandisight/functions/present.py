"""Presentation-table derivations (K1-K7) re-stated as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import parse_number_lenient, round_half_up_js

# Rain classes, default prices and labels of the advisory view.
RAINY_PERCENT, CLOUDY_PERCENT = 50, 20
DEFAULT_VIEW_MODAL = 2200.0
HIGH_FACTOR, LOW_FACTOR = 1.08, 0.9
DEFAULT_TREND = "Stable"
DEFAULT_RISK = "Low"
REASON_TREND = "%s prices are trending %s at %s in %s."
REASON_WEATHER = "Weather conditions (%s) should be considered before selling."
REASON_MARKET = "Market prices are based on the selected market."
UNKNOWN_PLACE = "Unknown location"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rain_class(rainfall_text) -> Column:
    """K2: >= 50 rainy, >= 20 cloudy, else sunny (missing -> 0)."""
    p = parse_number_lenient(rainfall_text, 0.0)
    return (F.when(p >= RAINY_PERCENT, F.lit("rainy"))
            .when(p >= CLOUDY_PERCENT, F.lit("cloudy")).otherwise(F.lit("sunny")))


def infer_decision(risk_level, trend, text) -> Column:
    """K3: text cues first (sell, wait, hold), then risk and trend."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    risk = _c(risk_level)
    tr = _c(trend)
    return (F.when(t.contains("sell"), F.lit("sell"))
            .when(t.contains("wait"), F.lit("wait"))
            .when(t.contains("hold"), F.lit("hold"))
            .when(F.coalesce(risk == "High", F.lit(False)), F.lit("wait"))
            .when(F.coalesce(tr == "Increasing", F.lit(False)), F.lit("sell"))
            .when(F.coalesce(tr == "Decreasing", F.lit(False)), F.lit("wait"))
            .otherwise(F.lit("hold")))


def price_label(x) -> Column:
    """``₹`` + ``Math.round``."""
    return F.concat(F.lit("₹"), round_half_up_js(x).cast("long").cast("string"))


def band_position(low, modal, high) -> Column:
    """K5: modal's position in the low-high band, 0-100, span at least 1."""
    span = F.greatest(_c(high) - _c(low), F.lit(1.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (_c(modal) - _c(low)) / span * F.lit(100.0)))


def first_non_empty(*cols) -> Column:
    """JS ``a || b || ...`` over texts ('' and NULL are falsy)."""
    return F.coalesce(*[F.when(_c(c) != "", _c(c)) for c in cols])


def place_label(village, mandal, display_name) -> Column:
    """K7: "village, mandal" (non-empty parts) || display name || Unknown."""
    joined = F.concat_ws(", ", F.when(_c(village) != "", _c(village)), F.when(_c(mandal) != "", _c(mandal)))
    return F.coalesce(F.when(joined != "", joined), first_non_empty(display_name), F.lit(UNKNOWN_PLACE))

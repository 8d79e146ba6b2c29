"""Numeric column expressions: rounding, parsing, percent change, defaults.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text tokens a pandas CSV read treats as missing
# (pandas' default na_values list).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# A plain decimal number (optionally signed, optional exponent). Spark's cast
# also accepts forms like "1d" or "1f"; the guard keeps the parse strict.
NUMERIC_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Splits a double into two halves of at most 27 and 26 bits (Veltkamp).
_SPLIT = float(2**27 + 1)


def round_half_even(c, digits: int = 0) -> Column:
    """``round(x, digits)`` of Python: the decimal nearest to the binary value, half to even at exact ties.

    The scaled double ``p`` may land on a tie although the value lies beside it (2.675 * 100 == 267.5). The exact
    error of that product (Veltkamp's split and Dekker's product; a power of ten up to 10**8 is its own upper half)
    says on which side, and a quarter towards it decides ``rint``. From 2**53 on every double is its own rounding.
    """
    x = _c(c).cast("double")
    scale = F.lit(float(10 ** abs(digits)))
    if digits < 0:
        p = x / scale
        beside = x - p * scale  # exact: p is a half where it is used
    else:
        p = x * scale
        big = x * F.lit(_SPLIT)
        high = big - (big - x)
        beside = (high * scale - p) + (x - high) * scale
    nudge = F.when(p - F.floor(p) == 0.5, F.signum(beside) * F.lit(0.25)).otherwise(F.lit(0.0))
    whole = F.rint(p + nudge)
    return F.when(F.abs(p) >= 2.0**53, x).otherwise(whole * scale if digits < 0 else whole / scale)


def scaled_round(c, digits: int) -> Column:
    """``rint`` of the scaled double: to show results at a fixed precision, with the same bits on any engine."""
    scale = F.lit(float(10 ** digits))
    return F.rint(_c(c).cast("double") * scale) / scale


def round_half_up_js(c) -> Column:
    """``Math.round``: half rounds toward +infinity."""
    return F.floor(_c(c) + F.lit(0.5)).cast("double")


def na_to_null(c) -> Column:
    """CSV missing-value tokens become NULL (exact match, no trim)."""
    x = _c(c)
    return F.when(x.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(x)


def nan_to_null(c) -> Column:
    x = _c(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def to_number(text) -> Column:
    """Strict text -> double; anything not numeric -> NULL.

    The pattern admits no NaN or infinity spelling, so no NaN can come out.
    """
    t = _c(text)
    return F.when(t.rlike(NUMERIC_TEXT), t.try_cast("double"))


def clean_number(c) -> Column:
    """Number with thousands separators: strip commas, trim, parse."""
    return to_number(F.trim(F.regexp_replace(_c(c), ",", "")))


def coerce_number(c) -> Column:
    """Numeric coercion without comma stripping ("1,921" -> NULL)."""
    return to_number(F.trim(_c(c)))


def safe_float(c, default=None) -> Column:
    """NULL or NaN -> default."""
    x = nan_to_null(_c(c).cast("double"))
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def pct_change(latest, base) -> Column:
    """(latest - base) / base * 100, NULL when the base is NULL or 0."""
    lt, b = _c(latest), _c(base)
    return F.when(b.isNull() | (b == 0), F.lit(None).cast("double")) \
        .otherwise((lt - b) / b * F.lit(100.0))


def trend_label(change) -> Column:
    """Dead band of +-5 %: strictly inside is stable, NULL is stable."""
    ch = _c(change)
    return (F.when(ch.isNull() | (F.abs(ch) < 5), F.lit("stable"))
            .when(ch > 0, F.lit("rising")).otherwise(F.lit("falling")))


def plain_double_text(c) -> Column:
    """A double as text without an exponent up to 1e16 (``10000000.0``, ``0.0005``), shortest digits that
    read back the same; beyond that, and below 1e-4, ``1e+16`` and ``1e-05``."""
    x = _c(c).cast("double")
    text = x.cast("string")
    # The decimal is made from the double's shortest digits, so it holds them all.
    fixed = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), "0+$", "")
    fixed = F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    scientific = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
                          F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    return (F.when(~text.contains("E"), text)
            .when((F.abs(x) < 1e16) & (F.abs(x) >= 1e-4), fixed).otherwise(scientific))


def parse_number_lenient(c, fallback) -> Column:
    """``parseFloat`` of the text with every char but digits and dots removed.

    "-5" gives 5 and "1.2.3" gives 1.2 (leading number of the stripped text).
    """
    stripped = F.regexp_replace(_c(c).cast("string"), r"[^0-9.]", "")
    lead = F.regexp_extract(stripped, r"^([0-9]*[.]?[0-9]+|[0-9]+[.]?)", 1)
    num = F.when(lead != "", lead.try_cast("double"))
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("double")
    return F.coalesce(num, fb)


def cents_text(c) -> Column:
    """Render a double as text with thousands commas and two decimals.

    Integer cents (half-up on the scaled double) keep the rendering exact.
    """
    x = _c(c)
    cents = F.floor(F.abs(x) * F.lit(100.0) + F.lit(0.5))
    whole = F.floor(cents / F.lit(100))
    frac = (cents - whole * F.lit(100)).cast("long")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.format_number(whole, 0), F.lit("."),
                    F.lpad(frac.cast("string"), 2, "0"))

"""Property tests for numeric expressions against plain-Python statements.

Each hypothesis example is a batch of values evaluated in one Spark job.
"""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mandisight.functions.numbers import (parse_number_lenient, pct_change, round_half_even,
                                          trend_label)

finite = st.floats(min_value=-1e7, max_value=1e7, allow_nan=False, allow_infinity=False)


@settings(max_examples=4, deadline=None)
@given(st.lists(finite, min_size=1, max_size=300), st.sampled_from([0, 1, 2, 4, -1]))
def test_round_half_even_matches_python_round(spark, xs, digits):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_half_even("x", digits)).collect()]
    assert got == [round(x, digits) for x in xs]


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4, -1])
def test_values_at_and_beside_ties_round_as_in_python(spark, digits):
    rng = random.Random(digits)
    ties = [2.675, 1.005, 0.285, 0.5, 1.5, 2.5, -2.5, -0.285, 0.0, 1e15 + 0.5, 2.0**52 + 1, 2.0**53 + 2, 1e300, 5e-324]
    ties += [(2 * rng.randrange(10**6) + 1) * 5 / 10 ** (digits + 1) for _ in range(3000)]
    ties += [-x for x in ties]
    xs = ties + [math.nextafter(x, math.inf) for x in ties] + [math.nextafter(x, -math.inf) for x in ties]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_half_even("x", digits)).collect()]
    assert [(x, g) for x, g in zip(xs, got) if g != round(x, digits)] == []


def test_round_half_even_keeps_null_nan_and_infinity(spark):
    df = spark.createDataFrame([(None,), (math.inf,), (-math.inf,), (math.nan,)], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert got[:3] == [None, math.inf, -math.inf] and math.isnan(got[3])


def js_parse(value, fallback):
    s = re.sub(r"[^\d.]", "", str(value))
    m = re.match(r"\d+\.?\d*|\.\d+", s)
    return float(m.group()) if m else fallback


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,-+ e₹%ab", max_size=12), min_size=1, max_size=300))
def test_lenient_parse_matches_js_semantics(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_number_lenient("t", -1.0)).collect()]
    assert got == [js_parse(t, -1.0) for t in texts]


def py_trend(latest, base):
    change = None if base in (None, 0) else (latest - base) / base * 100
    if change is None or abs(change) < 5:
        return change, "stable"
    return change, "rising" if change > 0 else "falling"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5000).map(float), st.integers(0, 5000).map(float)),
                min_size=1, max_size=300))
def test_change_and_trend(spark, pairs):
    df = spark.createDataFrame(pairs, "latest double, base double")
    rows = df.select(pct_change("latest", "base").alias("c"),
                     trend_label(pct_change("latest", "base")).alias("t")).collect()
    for (latest, base), r in zip(pairs, rows):
        change, trend = py_trend(latest, base)
        assert r.t == trend
        assert (r.c is None and change is None) or math.isclose(r.c, change, rel_tol=0, abs_tol=1e-9)

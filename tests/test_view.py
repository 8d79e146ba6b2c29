"""K4, K6, A3 filters and the messages of I21 at their edges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mandisight.operators import market, view
from mandisight.schemas import API_ENVELOPE, SERIES
from mandisight.sources import reports
from mandisight.sources.labels import read_labels


def _view(spark, *answers, **form):
    rows = [(i, None if a is None else json.dumps(a), *[form.get(k) for k in ("crop", "market", "district")])
            for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "i int, answer string, form_crop string, form_market string, form_district string")
    out = view.advisory_view(df.withColumn("raw", F.from_json("answer", view.RAW_ADVISORY)), F.lit("2026-07-08").cast("date"))
    return [r.view for r in out.orderBy("i").collect()]


def test_empty_advisory_shows_every_default(spark):
    none, v = _view(spark, None, {"risk_level": None})
    assert none is None
    assert v.weather.asDict() == {"temperature": "—", "humidity": "—", "rainfall": "—", "wind_speed": "12 km/h", "condition": "sunny"}
    m = v.market
    assert (m.market_name, m.modal_price, m.highest_price, m.lowest_price) == ("Nearest Mandi", "₹2200", "₹2376", "₹1980")
    assert (m.arrival_date, m.trend, v.risk_level, v.confidence, v.decision) == ("2026-07-08", "Stable", "Low", 82, "hold")
    assert v.crop.asDict() == view.CROP_TIPS and v.recommendation == view.NO_RECOMMENDATION and v.audio_base64 is None
    assert v.reasons[0] == "Crop prices are trending stable at your selected market in your district."


def test_empty_texts_are_stated_but_names_are_not(spark):
    v, = _view(spark, {"market": {"market_name": "", "modal_price": "", "current_price": "900", "trend": ""},
                       "crop": {"storage_tip": ""}, "recommendation": "", "reasons": []}, market="Town", crop="Onion")
    assert v.market.market_name == "Town" and v.market.trend == "" and v.crop.storage_tip == ""
    assert v.market.modal_price_value == 2200.0  # an empty modal price is stated, and no number
    assert v.recommendation == "" and v.reasons == [] and v.decision == "hold"


def test_labels_fall_back_to_english_then_to_the_key(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"English": {"x": "X", "y": "Y", "z": ""}, "Tamil": {"x": "", "y": "ய"}}))
    (tmp_path / "b.json").write_text(json.dumps({"English": {"x": "X2"}}))
    asked = spark.createDataFrame([(1, "Tamil", "x"), (2, "Tamil", "y"), (3, "Odia", "y"), (4, "Tamil", "z"), (5, None, "none"),
                                   (6, "Tamil", None)], "n int, language string, key string")
    got = {r.n: r.label for r in view.translated(asked, read_labels(spark, str(tmp_path))).collect()}
    assert got == {1: "X2", 2: "ய", 3: "Y", 4: "z", 5: "none", 6: None}


def test_api_filters_and_limit_choose_inside_the_array(spark, tmp_path):
    rec = lambda **k: {c: k.get(c) for c in ("state", "district", "market", "commodity", "modal_price")}
    env = [{"status": "ok", "records": [rec(state="a", commodity="p", modal_price="1"), rec(state="b", commodity="p", modal_price="2"),
                                        rec(state="a", commodity="p", modal_price="3"), rec(state="a", modal_price="4")]},
           {"status": "ok", "records": None}, {"status": "error", "records": [rec(state="a", commodity="p")]}, {"status": "ok", "records": []}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, env)))

    def prices(**k):
        return [r.modal_price for r in reports.read_api_landing(spark, str(tmp_path), API_ENVELOPE, **k).orderBy("record_pos").collect()]

    assert prices() == ["1", "2", "3", "4"]
    assert prices(filters={"state": "a", "commodity": "p"}) == ["1", "3"]
    assert prices(filters={"state": "a", "market": None, "district": ""}, limit=2) == ["1", "3"]
    assert prices(limit=0) == []
    with pytest.raises(ValueError):
        prices(filters={"variety": "v"})


def test_market_messages(spark):
    rows = [("s", "d", "m", "good", dt.date(2026, 7, 1), 5.0), ("s", "d", "m", "empty", dt.date(2026, 7, 1), None),
            ("s", "d", "m", "undated", None, 5.0), ("s", None, "m", "good", None, None)]
    prices = spark.createDataFrame(rows, "state string, district string, market string, commodity string, arrival_date date, "
                                         "modal_price double").selectExpr(
        "*", "'v' variety", "'g' grade", "modal_price min_price", "modal_price max_price", "'u' price_unit")
    asked = spark.createDataFrame([("s", "d", "m", c) for c in ("good", "empty", "undated", "never")] + [("s", None, "m", "good")],
                                  ", ".join(f"{c} string" for c in SERIES))
    joined = asked.join(market.summarize(prices), SERIES, "left")
    got = {(r.district, r.commodity): (r.available, r.market_message) for r in market.with_availability(joined, prices).collect()}
    assert got == {("d", "good"): (True, None), ("d", "empty"): (False, market.MSG_NO_VALID),
                   ("d", "undated"): (False, market.MSG_NO_VALID), ("d", "never"): (False, market.MSG_NO_RECORDS),
                   (None, "good"): (False, market.MSG_NO_RECORDS)}

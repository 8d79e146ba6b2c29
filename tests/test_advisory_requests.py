"""The advisory flow for a table of farmer requests, through the command line."""

import json

from mandisight import cli
from mandisight.plans import jobs
from mandisight.sources.profiles import profile_document
from tests.test_golden_reports import _write_reports


def test_advisory_cli(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    table = str(tmp_path / "prices")
    jobs.run_bulk_load(spark, _write_reports(tmp_path / "raw"), table)

    reqs = [
        {"req_id": 1, "crop": "Potato", "state": "Andhra Pradesh", "district": "Chittor",
         "market": "Palamaner APMC", "language": "English", "location_id": 7},
        {"req_id": 2, "crop": "Brinjal", "state": "Andhra Pradesh", "district": "Chittor",
         "market": "Palamaner APMC", "language": "", "location_id": 8},
        {"req_id": 3, "crop": "Onion", "state": "", "district": "", "market": "",
         "language": "Telugu", "location_id": 7},
        {"req_id": 4, "crop": "Mango", "state": "Andhra Pradesh", "district": "Chittor",
         "market": "Palamaner APMC", "language": "Telugu", "location_id": 7},
    ]
    (tmp_path / "req.json").write_text("\n".join(json.dumps(r) for r in reqs))
    entry = lambda t, temp, pop: {"dt_txt": t, "main": {"temp": temp}, "pop": pop,
                                  "weather": [{"description": "clouds"}]}
    docs = [{"location_id": 7, "cod": "200", "city": {"name": "Palamaner"},
             "list": [entry("2026-07-10 00:00:00", 22.0, 0.2), entry("2026-07-10 12:00:00", 29.0, 0.1)]},
            {"location_id": 8, "cod": "404"}]
    (tmp_path / "fc").mkdir()
    (tmp_path / "fc" / "f.json").write_text("\n".join(json.dumps(d) for d in docs))
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "kb.json").write_text(profile_document())
    out = str(tmp_path / "out")
    cli.main(["advisory", table, str(tmp_path / "req.json"), str(tmp_path / "fc"),
              str(tmp_path / "kb"), out])

    rows = {r.req_id: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[4].missing_profile and rows[4].prompt is None and rows[4].recommended_decision is None
    assert not rows[1].missing_profile and len(rows[1].recent_prices) > 1
    potato, brinjal, onion = rows[1], rows[2], rows[3]
    assert potato.trend == "rising" and potato.recommended_decision == "monitor_for_1_day_before_selling"
    assert potato.weather_available and potato.rain_risk is False
    assert potato.prompt.startswith("Crop:Potato Market:Palamaner APMC,Chittor Lang:English\nPrice:1600.0/quintal")
    assert "'chg7d_pct': 23.1" in potato.user_prompt
    assert brinjal.trend == "falling" and brinjal.recommended_decision == "sell_soon"
    assert brinjal.weather_available is False and brinjal.language == "Telugu"
    assert onion.market == "Palamaner APMC" and onion.district == "Palamaner"
    assert onion.market_signal == "unknown" and onion.recommended_decision == "sell_soon"
    assert "with a change of recently" in onion.fallback_advisory
    assert "around current local mandi price" in onion.fallback_advisory
    assert (onion.current_price, onion.modal_price, onion.max_price, onion.min_price) == \
        ("₹2200 / Quintal", 2200.0, 2350.0, 2050.0)
    assert potato.current_price == "₹1600.0 / Quintal"

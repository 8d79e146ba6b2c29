"""A4: landed forecast documents (nested JSON) reduce like the flat feed."""

import json

from mandisight.operators import weather


def test_forecast_documents(spark, tmp_path):
    def entry(t, temp, pop, desc):
        return {"dt_txt": t, "main": {"temp": temp}, "pop": pop, "weather": [{"description": desc}]}
    docs = [
        {"location_id": 1, "cod": "200", "city": {"name": "Madanapalle", "coord": {"lat": 13.55, "lon": 78.5}},
         "list": [entry("2026-07-10 00:00:00", 24.0, 0.1, "light rain"),
                  entry("2026-07-10 03:00:00", 31.456, 0.62, "clear sky"),
                  entry("2026-07-10 06:00:00", 28.0, None, "clear sky"),
                  entry("bad time", 40.0, 0.9, "storm"),
                  {"dt_txt": "2026-07-11 00:00:00", "main": {"temp": 22.0}, "pop": 0.0, "weather": []}]},
        {"location_id": 2, "cod": 404, "city": {"name": "Nowhere"}, "list": []},
        {"location_id": 3, "cod": "200", "city": {"name": "Empty"}, "list": []},
    ]
    (tmp_path / "f.json").write_text("\n".join(json.dumps(d) for d in docs))
    blocks = weather.read_forecast_docs(spark, str(tmp_path))
    days = {(r.location_id, r.date): r for r in weather.daily(blocks).collect()}
    d = days[(1, "2026-07-10")]
    assert (d.min_temp_c, d.max_temp_c, d.rain_probability_max_percent) == (24.0, 31.46, 62.0)
    assert d.conditions == "clear sky, light rain"
    assert days[(1, "2026-07-11")].conditions == "unknown"
    h = {r.location_id: r for r in weather.horizon(blocks).collect()}
    assert h[1].available and h[1].n_days == 2 and h[1].location == "Madanapalle"
    assert not h[2].available and h[2].message == "Weather forecast is unavailable."
    assert not h[3].available and h[3].message == "Weather forecast contains no entries."
    assert h[2].max_rain_probability_percent == 0.0


def test_only_the_latest_document_counts(spark, tmp_path):
    def doc(fetched, day, temp, name, cod="200"):
        return {"location_id": 7, "fetched_at": fetched, "cod": cod, "city": {"name": name, "coord": {"lat": temp}},
                "list": [{"dt_txt": f"2026-07-{day} 00:00:00", "main": {"temp": temp}, "pop": 0.1, "weather": []}]}
    (tmp_path / "a.json").write_text("\n".join(json.dumps(d) for d in [
        doc("2026-07-10", 10, 20.0, "New"), doc("2026-07-01", "01", 45.0, "Old")]))
    (tmp_path / "b.json").write_text(json.dumps(doc("2026-07-05", "05", 50.0, "Older", "404")))
    h = weather.horizon(weather.read_forecast_docs(spark, str(tmp_path))).collect()
    assert [(r.location, r.n_days, r.max_forecast_temp_c, r.latitude, r.available) for r in h] == [
        ("New", 1, 20.0, 20.0, True)]

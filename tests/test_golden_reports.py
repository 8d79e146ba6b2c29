"""Report CSV ingestion and the market summary on small golden series.

The fixture files follow the report export layout: a title line, the
header line, quoted numbers with thousands separators, dd-MM-yyyy dates,
rows out of date order and a trailing blank line.
"""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mandisight.operators import market
from mandisight.plans.sync import bulk_load
from mandisight.schemas import PRICE_COLUMNS
from mandisight.sources import reports

TITLE = ",,,,,,,Daily Price Arrival Report-01-06-2026 to 08-07-2026 for Andhra Pradesh,,,,,,\n"
HEADER = ("State,District,Market,Commodity Group,Commodity,Variety,Grade,Min Price,Max Price,"
          "Modal Price,Price Unit,Arrival Quantity,Arrival Unit,Arrival Date\n")

# (crop, [(day of July 2026, modal price)], expected summary)
SERIES = {
    "Brinjal": ([(1, 5500), (2, 4000), (4, 3500), (5, 3500), (6, 3500), (7, 3000), (8, 3500)],
                dict(avg=3785.71, day=16.67, week=-36.36, trend="falling")),
    "Cauliflower": ([(1, 1300), (2, 1000), (4, 1200), (5, 800), (6, 2000), (7, 2000), (8, 1800)],
                    dict(avg=1442.86, day=-10.0, week=38.46, trend="rising")),
    "Potato": ([(1, 1300), (2, 1800), (4, 1800), (5, 1600), (6, 1600), (7, 1600), (8, 1600)],
               dict(avg=1614.29, day=0.0, week=23.08, trend="rising")),
}


def _money(v):
    return f'"{v:,.2f}"'


def _write_reports(tmp_path):
    for crop, (points, _) in SERIES.items():
        lines = [TITLE, HEADER]
        for day, modal in reversed(points):
            lines.append(f"Andhra Pradesh,Chittor,Palamaner APMC,Vegetables,{crop},{crop},FAQ,"
                         f"{_money(modal - 500)},{_money(modal + 500)},{_money(modal)},Rs./Quintal,"
                         f"1.90,Metric Tonnes,{day:02d}-07-2026\n")
        # an older date: outside the 7 latest reporting dates
        lines.append(f"Andhra Pradesh,Chittor,Palamaner APMC,Vegetables,{crop},{crop},FAQ,"
                     f"900.00,1100.00,1000.00,Rs./Quintal,2.00,Metric Tonnes,30-06-2026\n")
        lines.append("\n")
        (tmp_path / f"{crop}.csv").write_text("".join(lines))
    # a file that lost a column: skipped and reported
    (tmp_path / "Broken.csv").write_text("a,b,c\n1,2,3\n")
    return str(tmp_path)


@pytest.fixture()
def loaded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = _write_reports(tmp_path / "in")
    scan = reports.scan_reports(spark, path, str(tmp_path / "staged"))
    clean, report = scan.rows, scan.report
    return clean, report


def test_load_counts_and_bad_file(loaded):
    clean, report = loaded
    rows = {r.file_name: (r.status, r.valid_rows) for r in report.collect()}
    assert rows["Broken.csv"] == ("skipped", 0)
    for crop, (points, _) in SERIES.items():
        assert rows[f"{crop}.csv"] == ("loaded", len(points) + 1)
    assert clean.count() == sum(len(p) + 1 for p, _ in SERIES.values())


def _line(**changes):
    row = dict(zip(PRICE_COLUMNS, ["Andhra Pradesh", "Chittor", "Palamaner APMC", "Vegetables", "Potato", "V", "FAQ",
                                   "900.00", "1100.00", "1000.00", "Rs./Quintal", "2.00", "Metric Tonnes", "30-06-2026"]))
    return ",".join((row | changes).values())


def test_quarantine_names_every_lost_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bad = {_line(state=""): "no state", _line(market="N/A"): "no market", _line(commodity="null"): "no commodity",
           _line(arrival_date=""): "no arrival_date", _line(arrival_date="31-02-2026"): "bad arrival_date",
           _line(modal_price="NaN"): "no modal_price", _line(modal_price="1x"): "bad modal_price",
           "only,three,fields": "no commodity", ",".join(PRICE_COLUMNS): "bad arrival_date"}
    (tmp_path / "in" / "good.csv").write_text("\n".join([_line(), "", "   ", *bad, _line(modal_price='"1,000.00"')]) + "\n")
    (tmp_path / "in" / "wide.csv").write_text(_line() + "\n" + _line() + ",more\n")
    scan = reports.scan_reports(spark, str(tmp_path / "in"), str(tmp_path / "staged"))
    lost = {(r.source_file.rsplit("/", 1)[1], r.text, r.reason) for r in scan.quarantine.collect()}
    assert lost == {("good.csv", t, reason) for t, reason in bad.items()} | {
        ("wide.csv", t, "file has 15 fields") for t in (_line(), _line() + ",more")}
    assert [r.modal_price for r in scan.rows.orderBy("line").collect()] == [1000.0, 1000.0]
    files = {r.file_name: (r.status, r.n_fields, r.valid_rows) for r in scan.report.collect()}
    assert files == {"good.csv": ("loaded", 14, 2), "wide.csv": ("skipped", 15, 0)}


def test_bulk_load_without_a_valid_file_still_leaves_the_quarantine(spark, tmp_path):
    from mandisight.plans import jobs
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        jobs.run_bulk_load(spark, str(tmp_path / "in"), str(tmp_path / "table"), quarantine_path=str(tmp_path / "lost"))
    assert [(r.reason, r.text) for r in spark.read.parquet(str(tmp_path / "lost")).collect()] == [("file has 2 fields", "a,b")]


def test_numbers_and_dates_parsed(loaded):
    clean, _ = loaded
    r = clean.where((F.col("commodity") == "Brinjal") & (F.col("arrival_date") == dt.date(2026, 7, 1))).first()
    assert r.modal_price == 5500.0 and r.min_price == 5000.0 and r.max_price == 6000.0
    assert r.arrival_quantity == 1.9 and r.state == "Andhra Pradesh"


def test_summary_golden_values(spark, loaded):
    clean, _ = loaded
    table = bulk_load(clean.withColumn("seq", F.lit(0)), F.struct("seq"))
    s = {r.commodity: r for r in market.summarize(table).collect()}
    for crop, (points, exp) in SERIES.items():
        r = s[crop]
        assert r.n_days == 7
        assert r.period_from == dt.date(2026, 7, 1) and r.period_to == dt.date(2026, 7, 8)
        assert r.latest_modal_price == float(points[-1][1])
        assert r.seven_day_average_modal_price == pytest.approx(exp["avg"], abs=0.006)
        assert r.day_over_day_change_percent == pytest.approx(exp["day"], abs=0.006)
        assert r.seven_day_change_percent == pytest.approx(exp["week"], abs=0.006)
        assert r.trend == exp["trend"]
        assert [x.date.day for x in r.recent_prices] == [d for d, _ in points]


def test_single_record_series(spark):
    rows = [("S", "D", "M", "Vegetables", "Onion", "V", "FAQ", 1921.0, 1921.0, 1921.0,
             "Rs./Quintal", 1.0, "Metric Tonnes", dt.date(2026, 7, 2))]
    from mandisight.schemas import PRICE_SCHEMA
    df = spark.createDataFrame(rows, PRICE_SCHEMA)
    r = market.summarize(df).first()
    assert r.seven_day_change_percent == 0.0
    assert r.day_over_day_change_percent is None and r.previous_day_modal_price is None
    assert r.trend == "stable"

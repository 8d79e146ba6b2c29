"""What large tables need of disk: narrow shuffles, and none left behind a step whose result is written."""

import os

import pytest
from pyspark.sql import functions as F

from mandisight.plans import catalog_files, jobs
from mandisight.session import scratch_path, shuffles_released
from mandisight.sources import driver_tables as dt
from mandisight.sources import reports, sizing
from tests.conftest import SF0001


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange " in x and "BroadcastExchange" not in x and "Reused" not in x]


@pytest.fixture
def large_parts(monkeypatch):
    """``part`` is too large to broadcast, ``supplier`` is not."""
    monkeypatch.setattr(dt, "is_small", lambda spark, sf_dir, name: name != "part", raising=False)
    monkeypatch.setattr(dt, "broadcast_if_small", lambda df, source: F.broadcast(df) if "s_suppkey" in df.columns else df,
                        raising=False)
    monkeypatch.setattr(dt, "dimensions_are_small", lambda spark, sf_dir: False, raising=False)
    monkeypatch.setattr(sizing, "MAX_SPREAD_BYTES", 0)


def test_envelopes_of_large_parts_are_grouped_from_narrow_lines(spark, large_parts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_order = [x for x in shuffles(dt.api_envelopes(spark, SF0001)) if "hashpartitioning(l_orderkey" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(by_order) == 1 and "REPARTITION_BY_COL" in by_order[0]


def test_report_lines_are_dealt_before_their_texts_are_made(spark, monkeypatch):
    seen = []
    kind = type(spark.range(1))
    dealt = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: seen.append(self.columns) or dealt(self, *a))
    catalog_files.land_reports(spark, SF0001)
    by_key = [c for c in seen if "l_orderkey" in c]
    assert by_key and not any("price_unit" in c or "min_price" in c for c in by_key)


def test_shuffle_files_go_with_the_query(spark, tmp_path):
    def held():
        tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
        return tracker.shuffleStatuses().size()

    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = held()
    with shuffles_released(spark):
        df.write.parquet(str(tmp_path / "a"))
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    assert held() <= before and spark.read.parquet(str(tmp_path / "a")).count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_lines_of_few_files_are_not_shuffled(spark, tmp_path):
    path = catalog_files.land_reports(spark, SF0001)
    scan = reports.scan_reports(spark, path, str(tmp_path / "lines"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (scan.rows, scan.quarantine):
            # What is shuffled are the counts per file.
            assert all("hashpartitioning(source_file" in x for x in shuffles(df))
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_bulk_load_leaves_no_staged_folder_but_its_report(spark, tmp_path):
    base = os.path.dirname(scratch_path(spark, "x")).removeprefix("file://")
    path = catalog_files.land_reports(spark, SF0001)
    before = set(os.listdir(base))
    jobs.run_bulk_load(spark, path, str(tmp_path / "table"))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before} == {"stage-report"}

"""Plan checks and the driver contract.

Every query of the library must run on sf0.001, stay JVM-side (no Python
UDF nodes), contain no cartesian product, and the flagship plan must keep
the partial window limit and the broadcast profile join. (The queries of the
llm folder have tests of their own.)
"""

import pytest

import __spark_entry__ as entry_mod
from mandisight.plans.catalog import QUERIES
from tests.conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert len(df.columns) > 0
    assert df.count() > 0


def test_oracle_keys_subset():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_jvm_side(spark, name):
    df = QUERIES[name](spark, SF0001)
    plan = _plan(df)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in plan, (name, bad)
    df.count()


def test_flagship_plan_shape(spark):
    df = entry_mod.queries()["decision"](spark, SF0001)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "BroadcastHashJoin" in plan


def test_history_dates_uses_partial_limit(spark):
    df = entry_mod.queries()["history_latest_dates"](spark, SF0001)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["clean_csv_numbers", "bad_files", "landed_api_json",
                                  "incremental_sync", "profile_json_load"])
def test_landing_queries_rerun(spark, name):
    """Queries that land files first must give the same answer when called again."""
    q = entry_mod.queries()[name]
    assert q(spark, SF0001).count() == q(spark, SF0001).count() > 0


def _spark_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_keep_last_combines_map_side(spark):
    plan = _spark_plan(entry_mod.queries()["dedupe_keep_last"](spark, SF0001))
    assert "partial_max_by" in plan


def test_low_cardinality_join_is_salted(spark):
    plan = _spark_plan(entry_mod.queries()["markets_per_commodity"](spark, SF0001))
    assert "_salt" in plan


def test_report_loader_scans_the_text_once_and_never_shuffles_by_file(spark, tmp_path):
    from mandisight.sources import reports
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n")
    scan = reports.scan_reports(spark, str(tmp_path / "in"), str(tmp_path / "staged"))
    plan = _spark_plan(scan.rows)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(source_file" not in plan
    assert not any("FileScan text" in _spark_plan(df) for df in (scan.rows, scan.report, scan.quarantine))


def test_filtered_history_broadcasts_bounded_dates(spark):
    plan = _spark_plan(entry_mod.queries()["optional_filters"](spark, SF0001))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan

"""What large tables need of the plans: narrow sorts, one narrow shuffle per landing, compressed landings."""

import os

import pytest

import __spark_entry__ as entry_mod
from mandisight.operators.cleanse import reject_reason
from mandisight.plans import catalog_files
from mandisight.sources import driver_tables as dt
from tests.conftest import SF0001


@pytest.mark.parametrize("name", ["latest_row", "dedupe_keep_last", "carry_forward", "history_latest_rows",
                                  "blank_district_lookup", "market_payload_default", "price_band_position"])
def test_the_order_is_not_sorted_along_with_the_row(spark, name):
    plan = entry_mod.queries()[name](spark, SF0001)._jdf.queryExecution().optimizedPlan().toString()
    assert " AS _o#" not in plan and " AS _w0#" not in plan


def test_envelopes_shuffle_the_narrow_lines_only(spark):
    plan = dt.api_envelopes(spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange " in line and "BroadcastExchange" not in line]
    assert len(shuffles) == 1 and "hashpartitioning(l_orderkey" in shuffles[0]


@pytest.mark.parametrize("land, ending", [(catalog_files.land_api, ".json.gz"), (catalog_files.land_reports, ".csv.gz")])
def test_landed_text_is_compressed(spark, land, ending):
    files = [f for _, _, names in os.walk(land(spark, SF0001)) for f in names if f.startswith("part-")]
    assert files and all(f.endswith(ending) for f in files)


def test_the_reason_of_a_line_parses_nothing_again():
    text = str(reject_reason("_raw_")).lower()
    assert "no arrival_date" in text and "bad modal_price" in text
    assert "date(" not in text and "rlike" not in text and "regexp" not in text

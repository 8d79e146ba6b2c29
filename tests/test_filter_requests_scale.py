"""C5 over a table of requests when there are too many keys or requests to broadcast."""

import pytest
from pyspark.sql import functions as F

from mandisight.operators import history
from mandisight.sources import driver_tables as dt
from tests.conftest import SF0001
from tests.test_filter_requests import REQUEST, SHOW, _plain, _prices


@pytest.mark.parametrize("keys, size", [(0, 0), (2, 0), (100_000, 0), (0, 1 << 24)])
def test_shuffled_joins_equal_a_plain_filter(spark, tmp_path, monkeypatch, keys, size):
    monkeypatch.setattr(history, "MAX_BROADCAST_KEYS", keys)
    monkeypatch.setattr(history, "MAX_BROADCAST_BYTES", size)
    asked = [(i, c, *f) for i, (c, *f) in enumerate([
        ("p", None, None, None, None), ("p", "s1", None, None, None), ("q", None, None, "m1", None), ("q", "s1", "d1", "m2", "v"),
        ("p", None, "d1", None, "v"), ("p", None, None, "m2", "v"), (None, None, None, "m2", None), ("q", None, None, "mx", None),
        ("p", None, None, None, None), ("q", None, None, "m2", None), ("p", None, None, "m1", None)])]
    spark.createDataFrame(asked, REQUEST).write.parquet(str(tmp_path / "asked"))
    prices = _prices(spark)
    got = history.history_for_filters(prices, spark.read.parquet(str(tmp_path / "asked")), 2, SHOW).collect()
    rows = prices.collect()
    assert sorted(map(tuple, got), key=str) == sorted([x for r in asked for x in _plain(rows, r, 2)], key=str)


def test_many_requests_do_not_multiply_the_rows_before_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("mandisight.sources.sizing.MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(history, "MAX_BROADCAST_BYTES", 0, raising=False)
    dt.filter_requests(spark, SF0001).write.parquet(str(tmp_path / "asked"))
    prices = dt.prices(spark, SF0001)
    h = history.history_for_filters(prices, spark.read.parquet(str(tmp_path / "asked")))
    plan = h._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # The copies of a row, one a mask, meet the keys in a broadcast join.
    copies = [i for i, line in enumerate(plan) if "Generate explode([0,1,2" in line]
    joins = [next(x for x in reversed(plan[:i]) if " Join " in x) for i in copies]
    assert len(copies) == 2 and all("rightHint=(strategy=broadcast)" in j for j in joins)


def test_what_is_broadcast_is_bounded_over_all_masks(spark, tmp_path, monkeypatch):
    # Sixteen masks with fewer keys each than the bound are more than the bound together.
    monkeypatch.setattr(history, "MAX_BROADCAST_KEYS", 100, raising=False)
    dt.filter_requests(spark, SF0001).write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    masks = asked.where("commodity is not null").groupBy(history.open_mask().alias("m")).agg(F.countDistinct(
        "commodity", "state", "district", "market", "variety").alias("n")).collect()
    assert asked.count() > 100
    plan = history.history_for_filters(dt.prices(spark, SF0001), asked)._jdf.queryExecution().sparkPlan().toString()
    assert len(masks) == 16
    top = plan.splitlines()[:3]
    assert any("SortMergeJoin [_key" in line for line in top), top


def test_few_masks_are_broadcast_and_the_others_shuffled():
    ways = history._ways({m: 60_000 if m & 4 else 10 for m in range(16)})
    assert ways["placed"] == [m for m in range(16) if m & 4 and m != 4] and ways["broadcast"] == [0, 1, 2, 3, 4, *range(8, 12)]
    assert history._ways({0: 0}) == {"broadcast": [0]}

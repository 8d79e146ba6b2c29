"""C5 over a table of requests: each request against its own filtered history."""

import itertools

import pytest

from mandisight.operators import history
from tests.conftest import SF0001

SHOW = ["commodity", "state", "district", "market", "variety", "arrival_date", "modal_price"]
REQUEST = "req_id long, commodity string, state string, district string, market string, variety string"


def _prices(spark):
    import datetime as dt
    rows = []
    for i, (c, s, d, m, v) in enumerate(itertools.product(["p", "q"], ["s1", None], ["d1", None], ["m1", "m2"], ["v", None])):
        rows += [(c, s, d, m, v, dt.date(2026, 1, 1 + (i * 3 + k) % 20) if k else None, float(i), 7) for k in range(5)]
    return spark.createDataFrame(rows, "commodity string, state string, district string, market string, variety string, "
                                       "arrival_date date, modal_price double, _mask int")


def _plain(prices, request, days):
    rows = [r for r in prices if r.commodity == request[1] and r.arrival_date is not None
            and request[1] is not None
            and all(f is None or r[c] == f for c, f in zip(["state", "district", "market", "variety"], request[2:]))]
    dates = sorted({r.arrival_date for r in rows}, reverse=True)[:days]
    return [(request[0], *[r[c] for c in SHOW]) for r in rows if r.arrival_date in dates]


@pytest.mark.parametrize("days", [1, 3])
def test_every_mask_equals_a_plain_filter(spark, tmp_path, days):
    asked = [(i, c, *f) for i, (c, *f) in enumerate(itertools.product(
        ["p", None, "none"], ["s1", None], ["d1", None, "dx"], ["m2", None], ["v", None]))]
    asked += [(1000, "p", None, None, None, None), (1000, "p", None, None, None, None)]  # repeated requests answer twice
    spark.createDataFrame(asked, REQUEST).write.parquet(str(tmp_path / "asked"))
    prices = _prices(spark)
    got = history.history_for_filters(prices, spark.read.parquet(str(tmp_path / "asked")), days, SHOW).collect()
    rows = prices.collect()
    wanted = [x for r in asked for x in _plain(rows, r, days)]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_no_requests(spark, tmp_path):
    spark.createDataFrame([], REQUEST).write.parquet(str(tmp_path / "asked"))
    assert history.history_for_filters(_prices(spark), spark.read.parquet(str(tmp_path / "asked")), 7, SHOW).count() == 0


def test_plan_does_not_grow_with_the_requests(spark, tmp_path):
    from mandisight.sources import driver_tables as dt

    def plan(name, asked):
        asked.write.parquet(str(tmp_path / name))
        h = history.history_for_filters(dt.prices(spark, SF0001), spark.read.parquet(str(tmp_path / name)))
        return h._jdf.queryExecution().sparkPlan().toString()

    few = dt.filter_requests(spark, SF0001)
    many = few.unionAll(few).unionAll(few).unionAll(few)
    a, b = plan("few", few), plan("many", many)
    assert a.count("\n") == b.count("\n")
    assert "CartesianProduct" not in b and "NestedLoop" not in b
    assert a.count("lineitem") == 2

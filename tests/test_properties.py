"""Properties of the dedupe, upsert, carry-forward and stream jobs."""

import datetime as dt

from pyspark.sql import functions as F

from mandisight.operators.dedupe import keep_last
from mandisight.operators.upsert import upsert_counts, upsert_full, upsert_prices_only
from mandisight.plans import sync
from mandisight.schemas import KEY_COLUMNS, PRICE_COLUMNS, PRICE_SCHEMA
from mandisight.sources import driver_tables as dt_src
from tests.conftest import SF0001


def _rows(spark, rows):
    return spark.createDataFrame(rows, PRICE_SCHEMA)


D = dt.date(2026, 7, 1)


def _r(district, variety, modal, group="Vegetables", qty=1.0, unit="t", day=D):
    return ("AP", district, "M", group, "Onion", variety, "FAQ", modal - 1, modal + 1, modal,
            "Rs./Quintal", qty, unit, day)


def _sorted(df):
    return sorted(tuple(r) for r in df.select(*PRICE_COLUMNS).collect())


def test_keep_last_idempotent_and_partition_insensitive(spark):
    p = dt_src.prices(spark, SF0001)
    order = dt_src.ingest_order()
    once = keep_last(p.withColumn("_o", order), KEY_COLUMNS, F.col("_o")).drop("_o")
    twice = keep_last(once.withColumn("_o", order), KEY_COLUMNS, F.col("_o")).drop("_o")
    shuffled = keep_last(p.repartition(13).withColumn("_o", order), KEY_COLUMNS, F.col("_o")).drop("_o")
    assert _sorted(once) == _sorted(twice) == _sorted(shuffled)
    assert once.count() == once.select(*KEY_COLUMNS).distinct().count()


def test_keep_last_groups_null_key_parts(spark):
    df = _rows(spark, [_r(None, "v", 10.0), _r(None, "v", 20.0)]).withColumn("seq", F.monotonically_increasing_id())
    out = keep_last(df, KEY_COLUMNS, F.col("seq")).collect()
    assert len(out) == 1 and out[0].modal_price == 20.0


def test_upsert_full_replaces_and_inserts(spark):
    target = _rows(spark, [_r("D", "a", 10.0), _r("D", "b", 20.0)])
    incoming = _rows(spark, [_r("D", "a", 11.0, group=None, qty=None, unit=None), _r("D", "c", 30.0)])
    out = {r.variety: r for r in upsert_full(target, incoming).collect()}
    assert out["a"].modal_price == 11.0 and out["a"].commodity_group is None
    assert out["b"].modal_price == 20.0 and out["c"].modal_price == 30.0


def test_upsert_prices_only_keeps_preserved_columns(spark):
    target = _rows(spark, [_r("D", "a", 10.0, group="G", qty=5.0, unit="u")])
    incoming = _rows(spark, [_r("D", "a", 11.0, group=None, qty=None, unit=None),
                             _r("D", "n", 7.0, group=None, qty=None, unit=None)])
    out = {r.variety: r for r in upsert_prices_only(target, incoming).collect()}
    assert out["a"].modal_price == 11.0
    assert (out["a"].commodity_group, out["a"].arrival_quantity, out["a"].arrival_unit) == ("G", 5.0, "u")
    assert out["n"].commodity_group is None and out["n"].modal_price == 7.0
    c = upsert_counts(upsert_prices_only(target, incoming)).first()
    assert (c.rows_applied, c.inserted, c.updated, c.total_after) == (2, 1, 1, 2)


def test_upsert_null_key_parts_never_conflict_by_default(spark):
    target = _rows(spark, [_r(None, "a", 10.0)])
    incoming = _rows(spark, [_r(None, "a", 11.0)])
    assert upsert_prices_only(target, incoming).count() == 2
    assert upsert_prices_only(target, incoming, null_safe=True).count() == 1


def test_upsert_with_empty_batch_is_identity(spark):
    target = _rows(spark, [_r("D", "a", 10.0), _r("D", "b", 20.0)])
    empty = target.limit(0)
    assert _sorted(upsert_full(target, empty)) == _sorted(target)
    assert _sorted(upsert_prices_only(target, empty)) == _sorted(target)


def test_carry_forward_twice_adds_nothing(spark):
    p = dt_src.prices(spark, SF0001, with_ties=False)
    order = F.struct("variety", "grade", "modal_price")
    run = F.lit(dt.date(2030, 1, 1))
    first = sync.carry_forward(p, run, order)
    n = first.count()
    assert n == p.select("state", "district", "market", "commodity").distinct().count()
    after = p.select(*PRICE_COLUMNS).unionByName(first.select(*PRICE_COLUMNS))
    assert sync.carry_forward(after, run, order).count() == 0
    r = first.where(F.col("modal_price").isNotNull()).first()
    assert r.modal_price % 10 == 0 and r.arrival_date == dt.date(2030, 1, 1)


def test_carry_forward_defaults_for_missing_prices(spark):
    df = _rows(spark, [_r("D", "a", 0.0, qty=0.0)])
    r = sync.carry_forward(df, F.lit(dt.date(2026, 7, 2)), F.struct("variety")).first()
    assert r.modal_price == 1000.0 and r.arrival_quantity == 1.0


def test_stream_equals_batch(spark):
    """The file stream (availableNow) writes exactly the rows the batch
    normalisation produces from the same landed files; a rerun adds none."""
    from mandisight.operators.cleanse import normalize_api
    from mandisight.plans import catalog_files as cf
    from mandisight.sources import reports
    from mandisight.streaming import incremental_sync as inc

    landing = cf.land_api(spark, SF0001)
    clean, ckpt = cf._scratch(spark, "t-clean"), cf._scratch(spark, "t-ckpt")
    schema = inc.landing_schema(cf.RECORD_EXTRA, cf.ENVELOPE_EXTRA)
    inc.stream_to_clean(spark, landing, clean, ckpt, schema, cf.DRIVER_SUPPORTED, extra=["l_linenumber"])
    cols = PRICE_COLUMNS + ["batch_id", "record_pos", "l_linenumber"]
    streamed = spark.read.parquet(clean).select(*cols)
    batch = normalize_api(reports.read_api_landing(spark, landing, schema), cf.DRIVER_SUPPORTED,
                          order=None, extra=["batch_id", "record_pos", "l_linenumber"]).select(*cols)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    inc.stream_to_clean(spark, landing, clean, ckpt, schema, cf.DRIVER_SUPPORTED, extra=["l_linenumber"])
    assert spark.read.parquet(clean).count() == batch.count()

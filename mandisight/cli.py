"""Command line for the everyday flows over stored data.

  python -m mandisight.cli bulk-load REPORTS_DIR TABLE REPORT_OUT [--merge]
  python -m mandisight.cli api-sync LANDING_DIR TABLE [--commodities Onion,Potato,...]
  python -m mandisight.cli incremental-sync LANDING_DIR TABLE CHECKPOINT [--commodities ...]
  python -m mandisight.cli carry-forward TABLE LOG [--run-date YYYY-MM-DD]
  python -m mandisight.cli sync-status TABLE LOG
  python -m mandisight.cli history TABLE --commodity X [--market M] [--variety V]
                                         [--state S] [--district D] [--days 7] --out OUT
  python -m mandisight.cli advisory TABLE REQUESTS FORECASTS PROFILES OUT

Paths may be any Hadoop-compatible URI. Results that are tables, per-file load
reports and history answers included, are written whole with Spark as
Parquet; only single rows of counts or status are printed.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from .operators import history, weather
from .operators.history import SUPPORTED_COMMODITIES
from .plans import advisory, jobs, tails
from .schemas import PRICE_COLUMNS
from .sources import reports
from .sources.profiles import read_profiles
from .streaming import incremental_sync


def _session() -> SparkSession:
    return SparkSession.builder.appName("mandisight").getOrCreate()


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="mandisight")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("bulk-load")
    b.add_argument("reports")
    b.add_argument("table")
    b.add_argument("report_out")
    b.add_argument("--merge", action="store_true", help="upsert into the stored table instead of replacing it")
    b.add_argument("--quarantine", help="folder for the lines that gave no row, with their reason")
    a = sub.add_parser("api-sync")
    a.add_argument("landing")
    a.add_argument("table")
    a.add_argument("--commodities", default=",".join(SUPPORTED_COMMODITIES))
    n = sub.add_parser("incremental-sync")
    for arg in ("landing", "table", "checkpoint"):
        n.add_argument(arg)
    n.add_argument("--commodities", default=",".join(SUPPORTED_COMMODITIES))
    for loader in (b, a, n):
        loader.add_argument("--tails", help="tail table of the latest days per series, kept up to date")
    c = sub.add_parser("carry-forward")
    c.add_argument("table")
    c.add_argument("log")
    c.add_argument("--run-date")
    s = sub.add_parser("sync-status")
    s.add_argument("table")
    s.add_argument("log")
    h = sub.add_parser("history")
    h.add_argument("table")
    h.add_argument("--commodity", required=True)
    for opt in ("market", "variety", "state", "district"):
        h.add_argument(f"--{opt}")
    h.add_argument("--days", type=int, default=7)
    h.add_argument("--out", required=True)
    q = sub.add_parser("history-requests")
    for arg in ("table", "requests", "out"):
        q.add_argument(arg)
    q.add_argument("--days", type=int, default=7)
    m = sub.add_parser("summary")
    for arg in ("tails", "out"):
        m.add_argument(arg)
    v = sub.add_parser("advisory")
    for arg in ("table", "requests", "forecasts", "profiles", "out"):
        v.add_argument(arg)
    args = ap.parse_args(argv)

    spark = _session()
    if args.cmd == "bulk-load":
        m: dict = {}
        report = jobs.run_bulk_load(spark, args.reports, args.table, metrics=m, replace=not args.merge,
                                    quarantine_path=args.quarantine, tails_path=args.tails)
        report.write.mode("overwrite").parquet(args.report_out)
        print(m)
    elif args.cmd == "api-sync":
        jobs.run_api_sync(spark, args.landing, args.table, args.commodities.split(","),
                          tails_path=args.tails).show()
    elif args.cmd == "incremental-sync":
        for counts in incremental_sync.sync_table(spark, args.landing, args.table, args.checkpoint,
                                                  args.commodities.split(","), tails_path=args.tails):
            print(counts)
    elif args.cmd == "carry-forward":
        run = dt.date.fromisoformat(args.run_date) if args.run_date else None
        print(jobs.run_carry_forward(spark, args.table, args.log, run))
    elif args.cmd == "sync-status":
        jobs.sync_status(spark, args.table, args.log).show(truncate=False)
    elif args.cmd == "history":
        params = {"commodity": args.commodity, "market": args.market, "variety": args.variety,
                  "state": args.state, "district": args.district}
        t = reports.read_price_table(spark, args.table)
        history.filtered_history(t, params, args.days).write.mode("overwrite").parquet(args.out)
    elif args.cmd == "history-requests":
        t = reports.read_price_table(spark, args.table)
        asked = spark.read.schema(history.FILTER_REQUEST).json(args.requests)
        history.history_for_filters(t, asked, args.days, PRICE_COLUMNS).write.mode("overwrite").parquet(args.out)
    elif args.cmd == "summary":
        tails.summary(spark, args.tails).write.mode("overwrite").parquet(args.out)
    elif args.cmd == "advisory":
        t = reports.read_price_table(spark, args.table)
        req = spark.read.json(args.requests)
        blocks = weather.read_forecast_docs(spark, args.forecasts)
        prof = read_profiles(spark, args.profiles).withColumnRenamed("crop_key", "commodity_key")
        out = advisory.advisory_for_requests(t, req, blocks, prof)
        out.drop("fast").write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()

"""Date and timestamp parsing expressions (bad text -> NULL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_report_date(c) -> Column:
    """Report CSV date ``dd-MM-yyyy`` (one or two digit day/month)."""
    return F.try_to_date(_c(c), "d-M-yyyy")


def parse_api_date(c) -> Column:
    """Open-data API date ``dd/MM/yyyy``."""
    return F.try_to_date(_c(c), "d/M/yyyy")


def parse_lenient_timestamp(c) -> Column:
    """ISO date or date-time text (``T`` or space separated)."""
    return F.try_to_timestamp(_c(c))

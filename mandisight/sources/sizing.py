"""Size checks from the scan's own statistics.

A file scan's statistics are the bytes of its files at planning time, so
nothing is counted, run or remembered: a table that has grown is judged by
its new size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tables of at most this many file bytes (a million or two narrow rows) are
# broadcast; larger ones take a shuffle join.
MAX_BROADCAST_BYTES = 16 << 20
# Tables of at most this many file bytes may be dealt over the cores.
MAX_SPREAD_BYTES = 256 << 20


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files a plain scan reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, source: DataFrame, rows_each: int = 1) -> DataFrame:
    """``broadcast(df)`` when ``source``, the scan it comes from, is small
    (``df`` must not have more than ``rows_each`` rows per row of its source table)."""
    return F.broadcast(df) if file_bytes(source) * rows_each <= MAX_BROADCAST_BYTES else df


def spread_small(df: DataFrame) -> DataFrame:
    """Deal a small table over the cores.

    A small file written as one row group reads as one task, so every
    per-row step above it would run on one core. The shuffle is bounded by
    ``MAX_SPREAD_BYTES``; larger tables are read as they are split on disk,
    whatever the number of cores.
    """
    if file_bytes(df) > MAX_SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)

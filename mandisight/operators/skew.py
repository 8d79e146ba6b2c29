"""Salted equi-join for keys with few distinct values.

Joining a large table on a low-cardinality key (a commodity, a file) hash-
partitions by that key, so one hot value lands whole in one task. The large
side gets a salt from a hash of its other columns, the small side (one row
per key) is replicated once per salt value, and the join runs on
(key, salt): a hot key is spread over ``buckets`` tasks. The small side
grows only by ``buckets`` times its own (small) size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 32


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``big`` JOIN ``small`` USING ``on``; ``spread_by`` columns of ``big``
    pick the salt (deterministic, so retried tasks reproduce it)."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(buckets))
    b = big.withColumn("_salt", salt.cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, list(on) + ["_salt"], how).drop("_salt")

"""Keep-last dedupe (D1-D3) as partial aggregation.

``max_by(row, order)`` grouped by the key is a hash/sort aggregate with a
map-side partial step, so every task ships at most one row per key it has
seen: a key that holds a third of all rows is combined before the shuffle
instead of landing whole in one task, which a ``row_number`` window would do.
NULL key parts group together, like a pandas ``drop_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _extreme(df: DataFrame, keys: Sequence[str], order: Column | Sequence[str], keep: Sequence[str] | None,
             by: Callable[[Column, Column], Column]) -> DataFrame:
    if not isinstance(order, Column):
        order = F.struct(*[F.col(c) for c in order])
    # The order column itself need not travel with the row.
    out = [c for c in df.columns if c != "_o"] if keep is None else [*keys, *keep]
    payload = [c for c in out if c not in keys]
    packed = F.struct(*[F.col(c) for c in payload])
    return (df.groupBy(*keys).agg(by(packed, order).alias("_row"))
            .select(*keys, *[F.col("_row")[c].alias(c) for c in payload])
            .select(*out))


def keep_last(df: DataFrame, keys: Sequence[str], order: Column | Sequence[str],
              keep: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order``.

    ``order`` must totally order the rows of a key (ties are broken by the
    payload itself, so equal-order duplicates give identical output).
    ``keep``: the columns wanted besides the keys (all, if not given). An
    ``order`` made of columns of ``df`` is best given as an expression: as a
    column of its own it is sorted along with the columns it repeats.
    """
    return _extreme(df, keys, order, keep, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Column | Sequence[str],
               keep: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the row with the smallest ``order``; ``keep`` as in ``keep_last``."""
    return _extreme(df, keys, order, keep, F.min_by)

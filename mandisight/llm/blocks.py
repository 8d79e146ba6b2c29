"""Pairwise work inside groups, cut into pairs of bounded blocks.

A group of n members is dealt into ceil(n / size) blocks, and every pair of
blocks is one unit of work that a task does in memory. No row is made per
pair of members: a unit returns, for each member with links, how many it has
and the smallest id it reaches there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mandisight.llm.common import written
from mandisight.llm.components import connected_components, local_components

#: Rows of units that one task compares.
ROWS_PER_TASK = 8192

#: Links of a unit as (position, position); ``left`` marks members of the first block.
Finder = Callable[[pd.DataFrame, np.ndarray, bool], tuple[np.ndarray, np.ndarray]]


def in_block_pairs(members: DataFrame, group: list[str], size: int, group_sizes: DataFrame) -> tuple[DataFrame, int]:
    """A row of ``members`` (with ``rep``) for every unit it takes part in: ``_i``, ``_j`` and its block ``_b``;
    and how many rows that makes.

    ``group_sizes``: the group columns and ``_n``, the number of members.
    """
    blocks = F.ceil(F.col("_n") / size).cast("int")
    dealt = members.join(group_sizes, group).withColumn("_b", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    rows = group_sizes.agg(F.sum(F.col("_n") * blocks)).first()[0] or 0
    return dealt.withColumn("_o", other).select(
        *members.columns, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b"), rows


def link_rows(rep: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """(rep, n_links, root) of the members of a unit that the links (a, b) touch."""
    links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
    # Members in the order of their ids, so that the smallest index is the smallest id.
    order = np.argsort(rep, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    root = rep[order][local_components(len(rep), place[a], place[b])[place]]
    on = links > 0
    return pd.DataFrame({"rep": rep[on], "n_links": links[on].astype(np.int64), "root": root[on]})


def linked(units: DataFrame, group: list[str], find: Finder, rows: int) -> DataFrame:
    """(rep, n_links, root) of the members that have links in a unit; ``units`` has ``rep`` and ``copies``.

    ``rows``: how many rows ``units`` has. The tasks follow it, since comparing costs more than the bytes show.
    """
    keys = [*group, "_i", "_j"]

    def work(unit: pd.DataFrame) -> pd.DataFrame | None:
        inner = unit["_i"].iloc[0] == unit["_j"].iloc[0]
        left = (unit["_b"] == unit["_i"]).to_numpy()
        if len(unit) < 2 or not inner and (left.all() or not left.any()):
            return None
        a, b = find(unit, left, bool(inner))
        if not len(a):
            return None
        return link_rows(unit["rep"].to_numpy(), unit["copies"].to_numpy(), a, b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for batch in batches:
            # Rows of a unit follow one another; a unit may go on in the next batch.
            change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            cuts = np.flatnonzero(change).tolist()
            if not cuts or cuts[0] != 0:
                cuts = [0, *cuts]
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part = batch.iloc[a:b]
                now = tuple(part[keys].iloc[0])
                if now != key and held:
                    out = work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True))
                    held = []
                    if out is not None:
                        yield out
                key = now
                held.append(part)
        if held:
            out = work(pd.concat(held, ignore_index=True))
            if out is not None:
                yield out

    dealt = units.repartition(max(1, -(-rows // ROWS_PER_TASK)), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "rep long, n_links long, root long")


def classes(found: DataFrame) -> DataFrame:
    """(rep, n_links, component) of the members with links, from ``linked`` rows."""
    found = written(found, "links")
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return counts.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "n_links", F.coalesce("component", "rep").alias("component"))

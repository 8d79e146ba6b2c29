"""History reads over the price table.

The reference answers one (commodity, market, ...) request at a time with
SQL ``ORDER BY ... LIMIT``; here each operator returns the answer for every
series at once, and request tables join to those per-series answers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SERIES
from ..sources.sizing import MAX_BROADCAST_BYTES, file_bytes
from .dedupe import keep_first, keep_last
from .skew import salted_join

# What a price history shows of a row.
PRICE_VIEW = ["arrival_date", "max_price", "modal_price", "min_price"]

# Crops the price sync accepts (exact case).
SUPPORTED_COMMODITIES = ["Brinjal", "Cauliflower", "Green Chilli", "Onion", "Potato", "Tomato"]


def latest_n_dates(df: DataFrame, n: int, series: Sequence[str] = SERIES) -> DataFrame:
    """All rows on the n latest distinct dates of each series, with ``date_rank`` (1 = latest).

    The dates of a series are distinct (series, date) pairs, reduced inside
    the tasks, and only those are ranked; the rows then join the ranked dates
    on (series, date), an equi-join whose hot keys adaptive execution splits.
    So a series that holds a third of all rows is no single task, however many
    of them fall on its latest dates. NULL parts of a series match (``<=>``).
    """
    w = Window.partitionBy(*series).orderBy(F.col("arrival_date").desc())
    dates = (df.select(*series, "arrival_date").distinct().withColumn("date_rank", F.row_number().over(w))
             .where(F.col("date_rank") <= n))
    keys = [*series, "arrival_date"]
    dates = dates.select(*[F.col(c).alias(f"_d_{c}") for c in keys], "date_rank")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in keys])
    return df.join(dates, same).select(*df.columns, "date_rank")


def latest_n_rows(df: DataFrame, n: int, order: Column | Sequence[str], series: Sequence[str] = SERIES) -> DataFrame:
    """H2: the n latest rows per series (``order`` breaks same-date ties; given as column names, no struct of them
    has to be sorted along with the row)."""
    ties = [order] if isinstance(order, Column) else [F.col(c) for c in order]
    w = Window.partitionBy(*series).orderBy(*[c.desc() for c in (F.col("arrival_date"), *ties)])
    return df.withColumn("row_rank", F.row_number().over(w)).where(F.col("row_rank") <= n)


def latest_row(df: DataFrame, order: Column, series: Sequence[str] = SERIES,
               keep: Sequence[str] | None = None) -> DataFrame:
    """H1 / H9: the single latest row per series as a partial aggregate.

    ``keep``: the columns wanted besides the series (all, if not given); the
    others do not travel with the candidates.
    """
    return keep_last(df, list(series), F.struct(F.col("arrival_date"), order), keep)


def latest_date_rows(df: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Every row on the latest date of its series (ties kept).

    The latest date per series is a partial aggregate; the rows join it on
    (series, date), an equi-join whose hot keys adaptive execution splits, so
    a series with very many rows on its last date is no single task. As in
    the reference's self join, a series with a NULL part has no rows.
    """
    last = df.groupBy(*series).agg(F.max("arrival_date").alias("arrival_date"))
    return df.join(last, [*series, "arrival_date"], "left_semi").select(*df.columns)


def first_of_latest_date(df: DataFrame, order: Column, series: Sequence[str] = SERIES,
                         keep: Sequence[str] | None = None) -> DataFrame:
    """One row per series from its latest date (the first by ``order``): one partial aggregate. ``keep`` as in
    ``latest_row``."""
    latest_first = F.coalesce(-F.unix_date("arrival_date"), F.lit(2**31 - 1))
    return keep_first(df, list(series), F.struct(latest_first, order), keep)


def filter_predicate(params: dict, mode: str = "not_none") -> Column:
    """Conjunction of equality filters for the parameters that are set.

    ``not_none``: a parameter set to anything but None applies (history);
    ``truthy``: empty strings are skipped too (API parameters);
    ``blank_trim``: a whitespace-only value is skipped (district in lookups).
    """
    def applies(v) -> bool:
        if mode == "not_none":
            return v is not None
        if mode == "truthy":
            return bool(v)
        if mode == "blank_trim":
            return v is not None and str(v).strip() != ""
        raise ValueError(mode)

    terms = [F.col(k) == F.lit(v) for k, v in params.items() if applies(v)]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def filtered_history(df: DataFrame, params: dict, days: int = 7) -> DataFrame:
    """The history query for one parameter set: rows on the latest ``days``
    distinct dates among the rows that pass the filters.

    The date list is a global top-``days`` (``orderBy().limit()`` plans as a
    bounded TakeOrderedAndProject), so the semi join broadcasts at most
    ``days`` rows: a proven bound.
    """
    sel = df.where(filter_predicate(params, "not_none"))
    dates = sel.select("arrival_date").distinct().orderBy(F.col("arrival_date").desc()).limit(days)
    # H8: oldest first, then market and variety (NULLs first, binary order).
    return (sel.join(F.broadcast(dates), "arrival_date", "left_semi")
            .orderBy("arrival_date", "market", "variety"))


def filtered_history_sets(df: DataFrame, param_sets: Sequence[dict], days: int = 7) -> DataFrame:
    """The history query for many parameter sets in one pass (set-wide C5).

    Rows are tagged with the ids of the sets they pass (a row may serve
    several), distinct dates per set are reduced map-side and cut to the
    latest ``days`` per set; that table has at most ``days`` rows per set (a
    proven bound), so the final semi join broadcasts it. Two scans in total,
    whatever the number of sets.
    """
    # A row that passes no set goes before anything is built for it, at the scan where the set's fields allow it.
    df = df.where(reduce(lambda a, b: a | b, [filter_predicate(p, "not_none") for p in param_sets]))
    ids = F.array_compact(F.array(*[F.when(filter_predicate(p, "not_none"), F.lit(i))
                                    for i, p in enumerate(param_sets)]))
    tagged = df.withColumn("filter_id", F.explode(ids))
    w = Window.partitionBy("filter_id").orderBy(F.col("arrival_date").desc())
    top = (tagged.select("filter_id", "arrival_date").distinct()
           .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= days).drop("_r"))
    return (tagged.join(F.broadcast(top), ["filter_id", "arrival_date"], "left_semi")
            .orderBy("filter_id", "arrival_date", "market", "variety"))


# Filters of a history request besides the commodity; each may be left open (NULL).
OPEN_FILTERS = ["state", "district", "market", "variety"]
FILTER_REQUEST = "req_id long, commodity string, state string, district string, market string, variety string"


def open_mask() -> Column:
    """Which of OPEN_FILTERS a request sets, as a bit mask (at most 16 values)."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") * (1 << k) for k, c in enumerate(OPEN_FILTERS)])


#: Filter keys that are broadcast, of all masks together (a key costs the driver up to 1 kB while its table is made:
#: the rows, their hash table and its serialized form); of more the join is shuffled. Also the most requests and
#: (commodity, market) pairs that are broadcast.
MAX_BROADCAST_KEYS = 100_000


def _masked(df: DataFrame, masks: Sequence[int], *carry: str) -> DataFrame:
    """Each row once per mask, with the filter columns that the mask leaves open set to NULL (``_k_*``)."""
    each = df.withColumn("_mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    keys = [F.when(F.col("_mask").bitwiseAND(1 << k) != 0, F.col(c)).alias(f"_k_{c}") for k, c in enumerate(OPEN_FILTERS)]
    return each.select(*carry, "_mask", F.col("commodity").alias("_k_commodity"), *keys)


_FILTER_KEYS = ["_mask", "_k_commodity", *[f"_k_{c}" for c in OPEN_FILTERS]]
_PLACE = OPEN_FILTERS.index("market")


#: The planner judges a stored table by its compressed bytes, and would broadcast what became of a few MB of requests.
_SHUFFLED = "merge"


def _ways(counts: dict[int, int]) -> dict[str, list[int]]:
    """How the masks meet the price rows. ``counts``: how many filter keys each mask has; those of fewest keys are
    broadcast, as long as they are few together."""
    few, total = [], 0
    for mask, n in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        total += n
        if total <= MAX_BROADCAST_KEYS:
            few.append(mask)
    many = [m for m in counts if m not in few]
    ways = {"broadcast": sorted(few), "placed": [m for m in many if m >> _PLACE & 1], "copied": [m for m in many if not m >> _PLACE & 1]}
    return {way: masks for way, masks in ways.items() if masks}


def _of_keys(prices: DataFrame, keys: DataFrame, way: str, masks: Sequence[int], *carry: str) -> DataFrame:
    """Every filter key (distinct _FILTER_KEYS of ``masks``, and what else ``keys`` has) with the ``carry`` columns of
    each price row that passes it.

    No price row is multiplied before a shuffle while a mask has few keys or sets the market: few keys are broadcast
    to the rows, and the many keys of markets meet the rows on (commodity, market), where a row stands once. Only
    the many keys of a mask without the market cost a copy of each row.
    """
    if way == "placed":
        rows = prices.select(*carry, *[F.col(c).alias(f"_p_{c}") for c in ("commodity", *OPEN_FILTERS)])
        passes = [keys[f"_k_{c}"].isNull() | (keys[f"_k_{c}"] == rows[f"_p_{c}"]) for c in OPEN_FILTERS if c != "market"]
        same = reduce(lambda a, b: a & b, [keys[f"_k_{c}"] == rows[f"_p_{c}"] for c in ("commodity", "market")] + passes)
        return rows.join(keys.hint(_SHUFFLED), same).select(*keys.columns, *carry)
    rows = _masked(prices, masks, *carry)
    wanted = F.broadcast(keys) if way == "broadcast" else keys.hint(_SHUFFLED)
    # Open filters are NULL on both sides; a set filter is not NULL in the request.
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(wanted[c]) for c in _FILTER_KEYS])
    return rows.join(wanted, same).select(*[wanted[c] for c in keys.columns], *carry)


def _cutoffs(dated: DataFrame, days: int) -> DataFrame:
    """Per filter key the earliest of its latest ``days`` distinct dates (``_cutoff``).

    The dates travel as bits, a number for 32 days, so a key leaves a task with a row a month at most.
    """
    day = F.unix_date("arrival_date")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), day.bitwiseAND(31))
    blocks = dated.where(F.col("arrival_date").isNotNull()).select(
        *_FILTER_KEYS, F.shiftright(day, 5).alias("_block"), bit.alias("_bit")).groupBy(*_FILTER_KEYS, "_block").agg(
        F.bit_or("_bit").alias("_bits"))
    # Every block holds a date, so the latest ``days`` dates lie in the latest ``days`` blocks.
    newest = Window.partitionBy(*_FILTER_KEYS).orderBy(F.col("_block").desc())
    last = blocks.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= days)
    each = last.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(31)))).where(
        F.expr("shiftright(_bits, _k) & 1 = 1")).withColumn("_day", F.col("_block") * 32 + F.col("_k"))
    latest = Window.partitionBy(*_FILTER_KEYS).orderBy(F.col("_day").desc())
    return (each.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= days)
            .groupBy(*_FILTER_KEYS).agg(F.date_from_unix_date(F.min("_day")).alias("_cutoff")))


def history_for_filters(prices: DataFrame, requests: DataFrame, days: int = 7,
                        show: Sequence[str] = (*SERIES, "variety", "grade", *PRICE_VIEW)) -> DataFrame:
    """C5 for a table of requests (req_id, commodity, state, district, market, variety): the rows of each request
    on the latest ``days`` distinct dates among the rows that pass its filters.

    A NULL filter is left open; a NULL commodity matches nothing (SQL ``=``). A set filter never matches a NULL.
    ``requests`` is a stored table: which filters its requests set is at most 16 masks, so every join is an
    equi-join and the plan does not grow with the number of requests. Equal filters are answered once (see
    ``_of_keys``): a narrow scan of the prices for the dates and one for the rows, for each of at most three ways in
    which masks meet the prices; what a filter found meets the requests that ask for it last, salted, since many may
    ask for the same. What is broadcast is bounded by MAX_BROADCAST_KEYS, whatever the number of requests.
    """
    asked = requests.where(F.col("commodity").isNotNull()).select(
        "req_id", open_mask().alias("_mask"), *[F.col(c).alias(f"_k_{c}") for c in ("commodity", *OPEN_FILTERS)])
    wanted = asked.select(*_FILTER_KEYS).distinct()
    per_mask = (asked.groupBy(*_FILTER_KEYS).agg(F.count(F.lit(1)).alias("r")).groupBy("_mask")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r")).orderBy("_mask").collect())  # at most 16
    counts = {r["_mask"]: r["n"] for r in per_mask} or {0: 0}
    n_requests = sum(r["r"] for r in per_mask)
    found = []
    for way, masks in _ways(counts).items():
        keys = wanted.where(F.col("_mask").isin(masks))
        of = prices
        if way == "placed":
            places = keys.select(F.col("_k_commodity").alias("commodity"), F.col("_k_market").alias("market")).distinct()
            if places.count() <= MAX_BROADCAST_KEYS:
                # Rows of markets that no request names need not be shuffled.
                of = prices.join(F.broadcast(places), ["commodity", "market"], "left_semi")
        cutoffs = _cutoffs(_of_keys(of, keys, way, masks, "arrival_date"), days)
        rows = _of_keys(of.withColumn("_row", F.struct(*show)), cutoffs, way, masks, "_row", "arrival_date")
        found.append(rows.where(F.col("arrival_date") >= F.col("_cutoff")).select(*_FILTER_KEYS, "_row"))
    # Keys as text: an open filter is no NULL there, so the join is a plain one.
    key = F.to_json(F.struct(*_FILTER_KEYS)).alias("_key")
    found, asked = reduce(DataFrame.unionAll, found).select(key, "_row"), asked.select("req_id", key)
    if n_requests <= MAX_BROADCAST_KEYS and file_bytes(requests) <= MAX_BROADCAST_BYTES // 4:
        return found.join(F.broadcast(asked), "_key").select("req_id", "_row.*")
    return salted_join(found, asked.hint(_SHUFFLED), ["_key"], ["_row"]).select("req_id", "_row.*")


def supported(df: DataFrame, names: Sequence[str] = SUPPORTED_COMMODITIES,
              column: str = "commodity") -> DataFrame:
    """C4: exact-case membership; a literal IN list is pushed to the scan."""
    return df.where(F.col(column).isin(list(names)))


def markets_per_commodity(df: DataFrame) -> DataFrame:
    """G6 set-wide: distinct (commodity, market) rows plus the market count.

    The reference returns one list per commodity; a list per key would put a
    whole commodity in one task, so the market list stays a table.
    """
    pairs = df.select("commodity", "market").distinct()
    counts = pairs.groupBy("commodity").agg(F.count(F.lit(1)).alias("n_markets"))
    # Few commodities: a plain join on commodity would put each commodity's
    # markets in one task; the salted join spreads a hot commodity.
    return salted_join(pairs, counts, ["commodity"], ["market"])


def lookup_latest(requests: DataFrame, latest_full: DataFrame, latest_no_district: DataFrame,
                  req_cols: Sequence[str] = ("state", "district", "market", "commodity")) -> DataFrame:
    """Latest row per request; a blank district matches any district.

    Two equi-join branches (blank / non-blank district), unioned, so neither
    side needs an OR-join condition.
    """
    blank = F.trim(F.coalesce(F.col("district"), F.lit(""))) == ""
    with_d = requests.where(~blank).join(latest_full, list(req_cols), "left")
    no_d = (requests.where(blank)
            .join(latest_no_district, [c for c in req_cols if c != "district"], "left"))
    return with_d.unionByName(no_d, allowMissingColumns=True)


def history_for_requests(prices: DataFrame, requests: DataFrame, order: Column | Sequence[str], n: int = 30) -> DataFrame:
    """H2 + C6 for a table of requests (req_id, state, district, market, commodity): each request's ``n`` latest
    rows, ``seq`` 1 = oldest. A blank district matches any district.

    The rows are cut to the latest of each series (of each series over all
    districts for blank requests) before the requests join them, so a series
    that holds a third of all rows leaves at most ``n`` rows a task.
    """
    blank = F.trim(F.coalesce(F.col("district"), F.lit(""))) == ""
    wide = [c for c in SERIES if c != "district"]
    narrow = latest_n_rows(prices, n, order).drop("location_id")
    any_district = latest_n_rows(prices, n, order, wide).drop("district", "location_id")
    asked = requests.select("req_id", *SERIES)
    found = asked.where(~blank).join(narrow, SERIES).select("req_id", *PRICE_VIEW, "row_rank").unionByName(
        asked.where(blank).join(any_district, wide).select("req_id", *PRICE_VIEW, "row_rank"))
    newest_first = Window.partitionBy("req_id").orderBy(F.col("row_rank").desc())
    return found.withColumn("seq", F.row_number().over(newest_first)).drop("row_rank")

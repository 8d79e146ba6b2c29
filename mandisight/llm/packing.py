"""Operator 8: best-fit packing with exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut; the first piece takes the remainder). Which pieces share a sequence
depends on their lengths alone, so the plan is made from the histogram of
piece lengths, at most ``capacity`` rows whatever the corpus holds:

1. Lengths are taken from the longest down. The gap behind a length is looked
   up by hash: among the single lengths, in the index of pair sums, in that of
   triple sums. A combination that fills the gap exactly is consumed as often
   as the counts allow, and leaves the index when a length has run out.
2. What is left is placed best-fit: the open sequence with the smallest gap
   that still holds the length, else a new sequence.

The plan is a list of intervals "pieces number a..b of length L go to
sequences s.. at offset o". Pieces of one length are numbered without a
single ordering task: a length that many pieces share is split into salted
groups, numbered inside and shifted by the counts of the groups before.

Defined results: null and empty texts are one piece holding only the end id;
repeated rows are packed as rows of their own; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mandisight.llm import vocab
from mandisight.llm.common import given_back, offsets_of, table, text_chunks, written

CAPACITY = 2048
END_ID = 0
#: Pieces of one length numbered by one task.
PIECES_PER_GROUP = 512

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n_tokens, capacity))]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text), with their ids if ``keep_ids``."""
    file = path or vocab.tokenizer_path(vocab.BYTE_BPE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = vocab.library_encoder(file, False)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in text_chunks(texts):
                flat, counts = encode(texts[a:b])
                cuts, rows = offsets_of(counts), []
                for k, doc_id in enumerate(batch["doc_id"].iloc[a:b]):
                    ids = np.append(flat[cuts[k]:cuts[k + 1]], end_id).astype("<u4")
                    for i, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                        part = ids[start:start + length]
                        rows.append((doc_id, i, start, length, zlib.crc32(part.tobytes()),
                                     *([part.astype(np.int32)] if keep_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32",
                                                  *(["ids"] if keep_ids else [])])

    return docs.select("doc_id", "text").mapInPandas(lambda batches: given_back(run(batches)), PIECE_SCHEMA + ", ids array<int>" * keep_ids)


class SumIndex:
    """Pairs and triples of available lengths by their sum.

    The entries of a sum are made when it is first asked for. Counts only fall, so an entry that has run out leaves
    for good; one that merely lacks a length which the caller has ``taken`` stays.
    """

    def __init__(self, left: list[int]):
        self.left = left
        #: sum -> [(a, b)] with a >= b, ascending; sum -> [a], the largest of three, ascending.
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.firsts: dict[int, list[int]] = {}

    def _entries(self, total: int) -> list[tuple[int, int]]:
        if total not in self.pairs:
            left = self.left
            self.pairs[total] = [(a, total - a) for a in range((total + 1) // 2, total) if left[a] and left[total - a]]
        return self.pairs[total]

    def pair(self, total: int, most: int, taken: dict[int, int]) -> tuple[int, int] | None:
        """The pair of the largest first length up to ``most``."""
        entries = self._entries(total)
        for i in range(bisect_right(entries, most, key=itemgetter(0)) - 1, -1, -1):
            a, b = entries[i]
            wanted = 2 if a == b else 1
            if self.left[a] < wanted or self.left[b] < wanted:
                del entries[i]
            elif self.left[a] - taken.get(a, 0) >= wanted and self.left[b] - taken.get(b, 0) >= wanted:
                return a, b
        return None

    def triple(self, total: int, taken: dict[int, int]) -> tuple[int, int, int] | None:
        """The triple of the largest first length."""
        if total not in self.firsts:
            self.firsts[total] = [a for a in range(-(-total // 3), total - 1) if self.left[a]]
        firsts = self.firsts[total]
        for i in range(len(firsts) - 1, -1, -1):
            a = firsts[i]
            if self.left[a] - taken.get(a, 0) >= 1:
                rest = self.pair(total - a, a, taken | {a: taken.get(a, 0) + 1})
                if rest:
                    return (a, *rest)
            if not self.left[a] or not self._entries(total - a):
                del firsts[i]
        return None


class Plan:
    """Sequences made from a histogram {length: count}."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for length, count in histogram.items():
            self.left[length] += count
        self.used = [0] * (capacity + 1)
        self.index = SumIndex(self.left)
        self.sequences = 0
        #: per length: (first number, first sequence, offset)
        self.intervals: dict[int, list[tuple[int, int, int]]] = {}
        self._fill_exactly()
        self._best_fit()

    def _put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.intervals.setdefault(length, []).append((self.used[length], sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def complement(self, gap: int, taken: dict[int, int]) -> tuple[int, ...] | None:
        """A single length, a pair or a triple that fills ``gap`` exactly besides what is ``taken``."""
        if self.left[gap] - taken.get(gap, 0) > 0:
            return (gap,)
        return self.index.pair(gap, gap, taken) or self.index.triple(gap, taken)

    def _fill_exactly(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                rest = self.complement(self.capacity - length, {length: 1}) if length < self.capacity else ()
                if rest is None:
                    break
                wanted: dict[int, int] = {}
                for x in (length, *rest):
                    wanted[x] = wanted.get(x, 0) + 1
                count = min(self.left[x] // n for x, n in wanted.items())
                offset = 0
                for x in (length, *rest):
                    self._put(x, count, self.sequences, offset)
                    offset += x
                self.sequences += count

    def _best_fit(self) -> None:
        gaps: list[int] = []  # open gaps, ascending
        open_: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)

        def leave(gap: int, first: int, count: int) -> None:
            if gap:
                if gap not in open_:
                    insort(gaps, gap)
                open_.setdefault(gap, []).append((first, count))

        for length in range(self.capacity, 0, -1):
            while (count := self.left[length]) > 0:
                at = bisect_left(gaps, length)
                if at < len(gaps):
                    gap = gaps[at]
                    first, bins = open_[gap].pop()
                    if not open_[gap]:
                        del open_[gap], gaps[at]
                    n = min(count, bins)
                    self._put(length, n, first, self.capacity - gap)
                    leave(gap - length, first, n)
                    leave(gap, first + n, bins - n) if bins > n else None
                else:
                    each = self.capacity // length  # a new sequence takes as many of this length as fit
                    full, rest = divmod(count, each)
                    for n, k in ((full, each), (1 if rest else 0, rest)):
                        if n:
                            for j in range(k):
                                self._put(length, n, self.sequences, j * length)
                            leave(self.capacity - k * length, self.sequences, n)
                            self.sequences += n

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by their length and number within it."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            first, base, off = np.array(self.intervals[length], np.int64).T
            at = np.searchsorted(first, numbers[rows], side="right") - 1
            sequence[rows], offset[rows] = base[at] + numbers[rows] - first[at], off[at]
        return sequence, offset


def numbered(parts: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``parts`` with ``number``: 0.. within each length."""
    groups = {length: -(-count // PIECES_PER_GROUP) for length, count in histogram.items()}
    many = F.create_map(*[F.lit(x) for kv in groups.items() if kv[1] > 1 for x in kv]) \
        if any(g > 1 for g in groups.values()) else None
    salts = F.coalesce(many[F.col("length")], F.lit(1)) if many is not None else F.lit(1)
    parts = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), salts.cast("long")))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    shift = (parts.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    return (parts.withColumn("_in", F.row_number().over(inside) - 1)
            .join(shift, ["length", "_group"])
            .withColumn("number", F.col("_in") + F.col("_shift"))
            .drop("_group", "_in", "_shift"))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (a written table: read several times)."""
    # At most ``capacity`` rows, one per length.
    histogram = {r["length"]: r["n"] for r in
                 parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(histogram, capacity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seq, off = plan.place(batch["length"].to_numpy(), batch["number"].to_numpy())
            yield batch.drop(columns="number").assign(sequence_id=seq, offset=off)

    ordered = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return numbered(parts, histogram).select(*ordered, "number").mapInPandas(
        run, schema + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(written(pieces(docs, path, capacity, end_id), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))

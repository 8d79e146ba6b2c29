"""Operator 11: alignment of two tokenizers over the same bytes, by lockstep vectorised merging.

A is a byte-level vocabulary on a space and the text, B a sentencepiece model
on the text (it adds that space). The ends of a text's A tokens and of its B
tokens are two ascending lists of byte offsets. One NumPy state vector holds an
A pointer and a B pointer for every text of a batch. Each step compares all
pairs of ends at once: equal ends emit a link and a cut and advance both
pointers, else the pointer of the smaller end advances; texts that have
reached their last end are compacted away. A long text takes part as several
entries, one per stretch of ``STRETCH`` bytes: equal ends lie in the same
stretch, so nothing is lost at its borders and the number of steps is bounded
whatever the longest text.

Tokens of a linked pair end at the same byte, so the bytes of one end with the
bytes of the other. The pairs of ids that can ever be linked are therefore
known from the two vocabularies alone (``PairTable``, some hundred thousand):
links are stored as numbers of this table, counted with one array per task,
and the corpus-wide counts go back to the documents as an array of that size.

Defined results: null and empty texts, and texts whose joined token bytes are
not a space and the text, have no tokens (zeros and an empty digest); special
token strings are plain text; repeated rows count again; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mandisight.llm import vocab
from mandisight.llm.common import gather_runs, given_back, offsets_of, table, text_runs, written

PIECE_MODEL = "piece_bpe_32k.model"
#: Bytes of a text that one entry of the state vector walks through.
STRETCH = 1024
#: Text aligned together; a token costs some hundred bytes of arrays on the way.
RUN_BYTES = 400_000

SPACE_MARK = "▁"


@functools.cache
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of every piece; control pieces have none."""
    model, out = piece_model(path), []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[1:-1], 16)]))
        else:
            out.append(b"" if model.is_control(i) else piece.replace(SPACE_MARK, " ").encode())
    return out


class ByteTable:
    """Bytes of the ids of a vocabulary, as one array."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.starts = offsets_of(self.lengths)[:-1]
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return gather_runs(self.flat, self.starts[ids], self.lengths[ids])


class PairTable:
    """Every (A id, B id) whose bytes can end together, numbered in the order of (B, A)."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        by_bytes_a: dict[bytes, list[int]] = {}
        by_bytes_b: dict[bytes, list[int]] = {}
        for table_, entries in ((by_bytes_a, a), (by_bytes_b, b)):
            for i, x in enumerate(entries):
                if x:
                    table_.setdefault(x, []).append(i)
        pairs = {(j, i) for i, x in enumerate(a) for k in range(len(x)) for j in by_bytes_b.get(x[k:], ())}
        pairs |= {(j, i) for j, x in enumerate(b) for k in range(len(x)) for i in by_bytes_a.get(x[k:], ())}
        rows = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.b, self.a = rows[:, 0], rows[:, 1]
        self.codes = self.b << 32 | self.a

    def __len__(self) -> int:
        return len(self.codes)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, b.astype(np.int64) << 32 | a)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Which pairs have the highest count of their B id."""
        top = np.zeros(int(self.b.max()) + 1 if len(self.b) else 0, np.int64)
        np.maximum.at(top, self.b, counts)
        return counts == top[self.b]


@functools.cache
def pair_table(path_a: str, path_b: str) -> PairTable:
    return PairTable(vocab.token_bytes(path_a), piece_bytes(path_b))


def lockstep(ends_a: np.ndarray, cuts_a: np.ndarray, ends_b: np.ndarray, cuts_b: np.ndarray,
             stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of the tokens that end together, for all texts of a batch.

    ``ends``: ascending byte offsets within each text; ``cuts``: where each text's ends start, and the total.
    """
    n = len(cuts_a) - 1
    text_a, text_b = np.repeat(np.arange(n), np.diff(cuts_a)), np.repeat(np.arange(n), np.diff(cuts_b))
    # A stretch is numbered over the whole batch; tokens of one stretch are neighbours in both lists.
    per_text = np.zeros(n, np.int64)
    filled = np.diff(cuts_a) > 0
    per_text[filled] = ends_a[cuts_a[1:][filled] - 1] // stretch + 1
    first = offsets_of(per_text)
    lane_a, lane_b = first[text_a] + ends_a // stretch, first[text_b] + ends_b // stretch
    lanes = np.arange(first[-1] + 1)
    starts_a, starts_b = np.searchsorted(lane_a, lanes), np.searchsorted(lane_b, lanes)
    i, stop_i, j, stop_j = starts_a[:-1], starts_a[1:], starts_b[:-1], starts_b[1:]
    found_i, found_j = [], []
    while True:
        on = (i < stop_i) & (j < stop_j)
        if not on.all():
            i, stop_i, j, stop_j = i[on], stop_i[on], j[on], stop_j[on]
        if not len(i):
            break
        x, y = ends_a[i], ends_b[j]
        same = x == y
        found_i.append(i[same])
        found_j.append(j[same])
        i, j = i + (x <= y), j + (y <= x)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_i, found_j = np.concatenate(found_i), np.concatenate(found_j)
    order = np.argsort(found_i)
    return found_i[order], found_j[order]


class Aligned:
    """The alignment of a batch: ids, cuts per text, and the places of the tokens that close a group."""

    def __init__(self, n: int, a: vocab.Ragged, b: vocab.Ragged, bytes_a: ByteTable, bytes_b: ByteTable):
        self.n, self.a, self.b = n, a[0], b[0]
        self.cuts_a, self.cuts_b = offsets_of(a[1]), offsets_of(b[1])
        ends = []
        for ids, cuts, entries in ((self.a, self.cuts_a, bytes_a), (self.b, self.cuts_b, bytes_b)):
            total = offsets_of(entries.lengths[ids])
            ends.append(total[1:] - np.repeat(total[cuts[:-1]], np.diff(cuts)))
        self.close_a, self.close_b = lockstep(ends[0], self.cuts_a, ends[1], self.cuts_b)
        self.cuts_g = np.searchsorted(self.close_a, self.cuts_a)

    @staticmethod
    def _groups_before(closing: np.ndarray, n: int) -> np.ndarray:
        """How many groups have closed before each of ``n`` tokens."""
        mark = np.zeros(n, np.int64)
        mark[closing] = 1
        return np.cumsum(mark) - mark

    @functools.cached_property
    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        # Token places in the order of the string: all A tokens of a group, then its B tokens.
        group_a, group_b = (self._groups_before(*x) for x in ((self.close_a, len(self.a)), (self.close_b, len(self.b))))
        size_b = np.diff(self.close_b, prepend=-1)
        at_a = np.arange(len(self.a)) + offsets_of(size_b)[group_a]
        at_b = np.arange(len(self.b)) + self.close_a[group_b] + 1
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        marks[at_a[self.close_a]] = 1
        marks[at_b[self.close_b]] = 2
        cuts = self.cuts_a + self.cuts_b
        last = cuts[1:][np.diff(cuts) > 0] - 1
        marks[last] = 3
        words = _marked_words()
        out = list(map(words.__getitem__, (ids * 4 + marks).tolist()))
        return ["".join(out[s:e]) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class _Words(dict):
    """id * 4 + mark -> decimal id and what follows it."""

    def __missing__(self, key: int) -> str:
        word = self[key] = f"{key >> 2}{',|;'[key & 3:][:1] if key & 3 < 3 else ''}"
        return word


@functools.cache
def _marked_words() -> _Words:
    return _Words()


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.encode_a, self.model_b = vocab.plain_ids(path_a), piece_model(path_b)
        self.bytes_a, self.bytes_b = ByteTable(vocab.token_bytes(path_a)), ByteTable(piece_bytes(path_b))
        self.pieces = vocab.RunCache(lambda runs: vocab.ragged(self.model_b.encode(runs, num_threads=1)))
        # A run after one space can be encoded apart only if no piece holds a space behind another character.
        self.splits = not any(b" " in x.lstrip(b" ") for x in piece_bytes(path_b))

    def _pieces(self, texts: list[str]) -> vocab.Ragged:
        """Ids of B, as the model's encode gives them: every distinct run between single spaces once."""
        if not self.splits:
            return vocab.ragged(self.model_b.encode(texts, num_threads=1))
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded, ends = pc.dictionary_encode(parts.flatten()), parts.offsets.to_numpy().astype(np.int64)
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        at = self.pieces.lookup(distinct.to_pylist())
        lengths, odd = self.pieces.lengths[at][codes], np.zeros(len(texts), bool)
        # Spaces at an end or in a row leave empty runs: the model sees those texts whole.
        empty = pc.equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)
        if empty.any():
            odd = np.add.reduceat(empty[codes], ends[:-1]) > 0
            lengths[np.repeat(odd, np.diff(ends))] = 0
        flat = gather_runs(self.pieces.flat, self.pieces.starts[at][codes], lengths)
        per_text = np.add.reduceat(lengths, ends[:-1]) if len(texts) else np.zeros(0, np.int64)
        return vocab.with_whole(flat, per_text, odd, lambda i: np.array(
            self.model_b.encode(texts[i], num_threads=1), np.int32))

    def align(self, texts: list) -> Aligned:
        """Texts without tokens (see above) have empty rows."""
        n = len(texts)
        spaced = [" " + t if t else "" for t in texts]
        a = vocab.ragged([np.array(self.encode_a(t) if t else [], np.int32) for t in spaced])
        # The model would give an empty text no pieces, and a run of its own no place here.
        some = [i for i, t in enumerate(texts) if t]
        flat, counts = self._pieces([texts[i] for i in some])
        lengths = np.zeros(n, np.int64)
        lengths[some] = counts
        b = flat, lengths
        wanted = np.frombuffer("".join(spaced).encode(), np.uint8)
        sizes = np.array([len(t.encode()) for t in spaced], np.int64)
        bad = self._differs(a, wanted, sizes, self.bytes_a) | self._differs(b, wanted, sizes, self.bytes_b)
        return Aligned(n, _without(a, bad), _without(b, bad), self.bytes_a, self.bytes_b)

    @staticmethod
    def _differs(ids: vocab.Ragged, wanted: np.ndarray, sizes: np.ndarray, entries: ByteTable) -> np.ndarray:
        """Texts whose joined token bytes are not the wanted ones."""
        total = offsets_of(entries.lengths[ids[0]])
        cuts = total[offsets_of(ids[1])]
        bad = np.diff(cuts) != sizes
        # Only texts of equal size are compared byte by byte.
        rows = np.repeat(~bad, sizes)
        flat, lengths = _without(ids, bad)
        unequal = entries.join(flat) != wanted[rows]
        if unequal.any():
            owner = np.repeat(np.arange(len(sizes)), np.where(bad, 0, sizes))
            bad = bad | (np.bincount(owner[unequal], minlength=len(sizes)) > 0)
        return bad


def _without(ids: vocab.Ragged, gone: np.ndarray) -> vocab.Ragged:
    if not gone.any():
        return ids
    return ids[0][np.repeat(~gone, ids[1])], np.where(gone, 0, ids[1])


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or vocab.tokenizer_path(vocab.BYTE_BPE), path_b or vocab.tokenizer_path(PIECE_MODEL)


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None,
               keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, pairs, groups_sha256) of ``docs``: ``pairs`` numbers its links in the PairTable.

    ``keep_groups`` adds ``groups``, the string behind the digest. A written table.
    """
    file_a, file_b = paths(path_a, path_b)
    names = ["doc_id", "n_a", "n_b", "n_groups", "pairs", "groups_sha256", *(["groups"] if keep_groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, pairs = aligner(file_a, file_b), pair_table(file_a, file_b)
        for run_ in text_runs(batches, RUN_BYTES):
            al = work.align(run_.column("text").to_pylist())
            links = pairs.number(al.a[al.close_a], al.b[al.close_b]).astype(np.int32)
            groups = al.groups
            yield pa.RecordBatch.from_arrays([
                run_.column("doc_id"), np.diff(al.cuts_a), np.diff(al.cuts_b), np.diff(al.cuts_g),
                pa.ListArray.from_arrays(pa.array(al.cuts_g, pa.int32()), pa.array(links)),
                pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]),
                *([pa.array(groups)] if keep_groups else [])], names=names)

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: given_back(run(batches)), "doc_id long, n_a long, n_b long, n_groups long, pairs array<int>, groups_sha256 string"
        + ", groups string" * keep_groups), "alignments")


def pair_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, n): how many links of the corpus each pair of ids has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("pairs").flatten().to_numpy(), minlength=n_pairs)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pair, total[pair]], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum in place of ``pairs``."""
    spark, pairs = aligned.sparkSession, pair_table(*paths(path_a, path_b))
    # Bounded by the vocabularies (see PairTable), not by the corpus.
    found = pair_counts(aligned, len(pairs)).toPandas()
    counts = np.zeros(len(pairs), np.int64)
    counts[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast((counts, pairs.best(counts)))
    columns = [c for c in aligned.columns if c != "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = held.value
        for batch in batches:
            links = batch.column("pairs")
            cuts, flat = links.offsets.to_numpy().astype(np.int64), links.values.to_numpy()
            sums = [offsets_of(x[flat].astype(np.int64))[cuts] for x in (best, count)]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, columns), np.diff(cuts), *map(np.diff, sums)],
                names=[*columns, "n_links", "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "pairs")
    return aligned.mapInArrow(run, schema + ", n_links long, n_best long, count_sum long")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return with_counts(alignments(docs)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

"""Operator 7: BPE encoding and decoding with a contiguous rank array.

A short word is held as an array of part ids (its boundaries) beside an array
with the merge rank of every adjacent pair. The word is scanned for its
minimum rank, the boundary there is deleted, and only the two ranks next to
the merged part are looked up again; this repeats until no pair has a rank.
All distinct words of a batch with the same byte length are rows of one
matrix, so every scan, deletion and refresh is one array operation over the
words still being merged. Words are encoded once per worker (see ``vocab``);
decoding concatenates the bytes of the ids and reads them as UTF-8.

Defined results: null and empty texts have no ids (digests of the empty
string); special-token text is one id, as in the library; ids of equal texts
are equal; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from mandisight.llm import vocab
from mandisight.llm.common import gather_runs, offsets_of, table, text_chunks

NO_RANK = np.int32(2**31 - 1)


class PairRanks:
    """(left id, right id) -> (rank, merged id) in an open-addressing table."""

    def __init__(self, merges) -> None:
        rows = np.array(list(merges), np.int64).reshape(-1, 3)
        keys = (rows[:, 0] << 32 | rows[:, 1]).astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rows)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.ranks = np.full(size, NO_RANK)
        self.merged = np.zeros(size, np.int32)
        slots = self._slot(keys)
        left, self.probes = np.arange(len(rows)), 0
        # Place all keys at their slot; those that lose the slot try the next one.
        while len(left):
            at = (slots[left] + self.probes) & (size - 1)
            free = self.keys[at] == np.uint64(2**64 - 1)
            winner = np.zeros(len(left), bool)
            winner[np.unique(at, return_index=True)[1]] = True
            put = free & winner
            self.keys[at[put]], self.ranks[at[put]] = keys[left[put]], left[put]
            self.merged[at[put]] = rows[left[put], 2]
            left, self.probes = left[~put], self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NO_RANK if the pair does not merge) and merged ids; an id of -1 is no part."""
        keys = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        rank, merged = np.full(len(keys), NO_RANK), np.zeros(len(keys), np.int32)
        open_, mask = np.flatnonzero((left >= 0) & (right >= 0)), (1 << self.bits) - 1
        for step in range(self.probes):
            at = (slot[open_] + step) & mask
            hit = self.keys[at] == keys[open_]
            rank[open_[hit]], merged[open_[hit]] = self.ranks[at[hit]], self.merged[at[hit]]
            open_ = open_[~hit & (self.keys[at] != np.uint64(2**64 - 1))]
            if not len(open_):
                break
        return rank, merged


class RankArrayBpe:
    """Encoder over a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        words, merges = vocab.merge_ranks(path)
        alphabet = vocab.byte_alphabet()
        self.byte_ids = np.array([words[alphabet[b]] for b in range(256)], np.int32)
        self.pairs = PairRanks(merges)
        self.pattern = regex.compile(vocab.BYTE_PATTERN)
        self.special = {t["content"]: t["id"] for t in vocab.model_file(path)["added_tokens"]}
        self.special_pattern = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        self.pieces = vocab.RunCache(self.encode_words)
        self.cache = vocab.RunCache(self.encode_runs)
        self.token_bytes = vocab.token_bytes(path)
        lengths = np.fromiter(map(len, self.token_bytes), np.int64, len(self.token_bytes))
        self.byte_lengths, self.byte_starts = lengths, offsets_of(lengths)[:-1]
        self.byte_flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    # -- merging ---------------------------------------------------------
    def merge_matrix(self, parts: np.ndarray) -> np.ndarray:
        """Merge the rows of ``parts`` (words x parts); freed places hold -1 at the end of a row."""
        parts = parts.copy()
        count, width = parts.shape
        if width < 2 or not count:
            return parts
        ranks = np.full((count, width), NO_RANK)
        merged = np.zeros((count, width), np.int32)
        r, m = self.pairs.find(parts[:, :-1].ravel(), parts[:, 1:].ravel())
        ranks[:, :-1], merged[:, :-1] = r.reshape(count, -1), m.reshape(count, -1)
        rows = np.arange(count)
        column = np.arange(width)
        while True:
            at = ranks[rows].argmin(axis=1)  # the first of equal ranks, as in the library
            on = ranks[rows, at] != NO_RANK
            rows, at = rows[on], at[on]
            if not len(rows):
                return parts
            parts[rows, at] = merged[rows, at]
            # Delete the boundary behind the merged part: everything after it moves one place left.
            source = np.minimum(column + (column > at[:, None]), width - 1)
            for array, empty in ((parts, -1), (ranks, NO_RANK), (merged, 0)):
                moved = np.take_along_axis(array[rows], source, axis=1)
                moved[:, -1] = empty
                array[rows] = moved
            # Refresh the pair that starts at the merged part and the pair that ends there.
            nxt = np.where(at + 1 < width, parts[rows, np.minimum(at + 1, width - 1)], -1)
            prev = np.where(at > 0, parts[rows, np.maximum(at - 1, 0)], -1)
            ranks[rows, at], merged[rows, at] = self.pairs.find(parts[rows, at], nxt)
            r, m = self.pairs.find(prev, parts[rows, at])
            inner = at > 0
            ranks[rows[inner], at[inner] - 1], merged[rows[inner], at[inner] - 1] = r[inner], m[inner]

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """One long word (beyond the matrix width): the same scan on a row of its own."""
        parts = word.copy()
        ranks, merged = self.pairs.find(parts[:-1], parts[1:])
        while len(ranks):
            low = ranks.min()
            if low == NO_RANK:
                break
            # All places of the lowest rank that do not overlap merge in one scan, left to right.
            at = np.flatnonzero(ranks == low)
            if len(at) > 1:
                keep, last = [], -2
                for p in at.tolist():
                    if p > last + 1 or last < 0:
                        keep.append(p)
                        last = p
                at = np.array(keep)
            parts[at] = merged[at]
            stay = np.ones(len(parts), bool)
            stay[at + 1] = False
            parts = parts[stay]
            # Only the pairs beside the merged parts changed.
            old = np.flatnonzero(stay)
            place = at - np.arange(len(at))
            ranks, merged = (np.append(a, b)[old[:-1]] if len(old) > 1 else a[:0]
                             for a, b in ((ranks, NO_RANK), (merged, np.int32(0))))
            near = np.unique(np.concatenate([place, place - 1]))
            near = near[(near >= 0) & (near < len(parts) - 1)]
            ranks[near], merged[near] = self.pairs.find(parts[near], parts[near + 1])
        return parts

    def encode_words(self, words: list[str], widest: int = 32) -> vocab.Ragged:
        """Ids of every pre-token."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        starts, counts = offsets_of(lengths)[:-1], np.zeros(len(raw), np.int64)
        done = []
        for length in np.unique(lengths).tolist():
            members = np.flatnonzero(lengths == length)
            if length > widest:
                rows = [self.merge_long(data[starts[i]:starts[i] + length]) for i in members]
                counts[members] = [len(r) for r in rows]
                done.append((members, np.concatenate(rows)))
            else:
                merged = self.merge_matrix(data[starts[members][:, None] + np.arange(length)])
                counts[members] = (merged >= 0).sum(axis=1)
                done.append((members, merged[merged >= 0]))
        # Back into the order of the words.
        flat = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int32)
        placed = np.concatenate([m for m, _ in done]) if done else np.zeros(0, np.int64)
        begin = np.zeros(len(raw), np.int64)
        begin[placed] = offsets_of(counts[placed])[:-1]
        return gather_runs(flat, begin, counts), counts

    def encode_runs(self, runs: list[str]) -> vocab.Ragged:
        return vocab.split_and_encode(runs, self.pattern, self.pieces)

    def encode_whole(self, text: str) -> np.ndarray:
        """A text with special tokens or unusual white space."""
        pieces = self.special_pattern.split(text) if self.special_pattern else [text]
        ids = [np.array([self.special[p]], np.int32) if p in self.special else self.encode_runs([p])[0]
               for p in pieces if p]
        return np.concatenate(ids) if ids else np.zeros(0, np.int32)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text)."""
        return vocab.encode_texts(texts, self.cache, self.encode_whole)

    # -- decoding --------------------------------------------------------
    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        lengths = self.byte_lengths[flat]
        data = gather_runs(self.byte_flat, self.byte_starts[flat], lengths).tobytes()
        ends = offsets_of(lengths)[offsets_of(counts)]
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.cache
def encoder(path: str) -> RankArrayBpe:
    """One encoder per worker and file."""
    return RankArrayBpe(path)


def decimal_digests(flat: np.ndarray, counts: np.ndarray, decimals: np.ndarray) -> list[str]:
    """SHA-256 of the decimal ids joined by commas, per text."""
    ends = offsets_of(counts)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out.append(hashlib.sha256(b",".join(decimals[flat[a:b]].tolist())).hexdigest())
    return out


def encode_decode(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``, ``decoded``
    with ``keep_ids``) for every row of ``docs`` (doc_id, text)."""
    file = path or vocab.tokenizer_path(vocab.BYTE_BPE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(file)
        decimals = np.array([str(i).encode() for i in range(len(bpe.token_bytes))], object)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            doc_ids = batch["doc_id"]
            for a, b in text_chunks(texts):
                flat, counts = bpe.encode(texts[a:b])
                decoded = bpe.decode(flat, counts)
                out = {
                    "doc_id": doc_ids.iloc[a:b].array, "n_tokens": counts,
                    "ids_sha256": decimal_digests(flat, counts, decimals),
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded],
                }
                if keep_ids:
                    ends = offsets_of(counts)
                    out |= {"ids": [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], "decoded": decoded}
                yield pd.DataFrame(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInPandas(
        run, schema + (", ids array<int>, decoded string" if keep_ids else ""))


def op7_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"))

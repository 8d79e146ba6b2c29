"""Operator 12: drop lines that many documents share, by a sharded minimal perfect hash.

1. Every document gives each of its distinct line keys once, as a 128-bit
   hash. The hashes are counted inside the tasks and then over the corpus.
2. The distinct hashes found in at least ``least`` documents are dealt into
   shards by their high bits. A shard's minimal perfect hash maps its n hashes
   to the places 0..n-1 without gaps: level by level a hash takes a bit that
   no other hash of the level wants, and the rest goes on to the next level.
   A place indexes two arrays, fingerprints and document counts. One file per
   shard lies in the shared folder.
3. Documents are read again and probe the arrays. A task looks up the distinct
   lines of a run of texts shard by shard and keeps a bounded number of bytes
   of shards; no line is shuffled, joined or collected.

Lines below ``least`` need no place: an absent hash lands on some place whose
64-bit fingerprint (the second half of the hash; the first half chooses shard
and place) differs. So the index is at most lines / ``least`` entries of about
12.5 bytes, and dropping by a higher count than ``least`` needs no new index.

Defined results: null and empty texts are one empty line; rows that repeat a
doc_id are documents of their own; a null doc_id is carried on; an empty table
gives an empty index and no rows; extra columns are not read. Counts beyond
2**32 - 1 stay there.
"""

from __future__ import annotations

import functools
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mandisight.llm import store
from mandisight.llm.common import ASCII_SPACE, fresh_path, offsets_of, table, text_runs, written

MIN_DOCS = 10
MIN_CHARS = 1
#: Expected hashes of a shard: what one task builds, and what one probe loads.
KEYS_PER_SHARD = 1 << 20
#: Bits per hash of a level; more bits, fewer levels.
GAMMA = 2
#: Bytes of shards that a worker keeps between runs of texts.
HELD_BYTES = 64 << 20
#: Text that is split and probed together.
RUN_BYTES = 4_000_000

MAGIC = b"LINEMPH1"


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """64 fresh bits per hash and level."""
    with np.errstate(over="ignore"):
        x = h1 + h2 * np.uint64(2 * level + 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def scaled(bits: np.ndarray, n: int) -> np.ndarray:
    """The high halves of ``bits`` spread evenly over 0..n-1 (n < 2**31)."""
    return (bits >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


class PerfectHash:
    """Distinct (h1, h2) -> 0..n-1. ``levels``: bit words; ``ranks``: set bits before each word of all levels."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.ranks = offsets_of(np.bitwise_count(words).astype(np.int64))
        self.bases = offsets_of(np.array([len(x) for x in levels], np.int64))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1):
            words = -(-GAMMA * len(h1) // 64)
            at = scaled(mixed(h1, h2, len(levels)), words * 64).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(levels)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Places; a hash that was not built in gets some place, or -1."""
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for level, words in enumerate(self.levels):
            if not len(open_):
                break
            at = scaled(mixed(h1[open_], h2[open_], level), len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word] >> bit & np.uint64(1) == 1
            word, bit = word[held], bit[held]
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[held]] = self.ranks[self.bases[level] + word] + below
            open_ = open_[~held]
        return out


class LineShard:
    """A shard: perfect hash, fingerprint and count arrays."""

    def __init__(self, places: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray):
        self.places, self.fingerprints, self.counts = places, fingerprints, counts
        self.nbytes = fingerprints.nbytes + counts.nbytes + places.ranks.nbytes + sum(x.nbytes for x in places.levels)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> LineShard:
        places = PerfectHash.build(h1, h2)
        at = places.find(h1, h2)
        fingerprints, held = np.empty(len(h1), "<u8"), np.empty(len(h1), "<u4")
        fingerprints[at], held[at] = h2, np.minimum(counts, 2**32 - 1)
        return cls(places, fingerprints, held)

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of every hash; 0 for a hash without a place."""
        at = self.places.find(h1, h2)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == h2[known]
        out = np.zeros(len(h1), np.int64)
        out[known] = self.counts[at[known]]
        return out

    def write(self, uri: str) -> None:
        sizes = [len(x) for x in self.places.levels]
        with store.create(uri) as out:
            out.write(MAGIC + struct.pack(f"<QQ{len(sizes)}Q", len(self.counts), len(sizes), *sizes))
            for array in (*self.places.levels, self.fingerprints, self.counts):
                out.write(array.tobytes())

    @classmethod
    def read(cls, uri: str) -> LineShard:
        with store.open_random(uri) as file:
            data = file.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{uri} is not a line shard")
        n, n_levels = struct.unpack_from("<QQ", data, 8)
        sizes, at, levels = struct.unpack_from(f"<{n_levels}Q", data, 24), 24 + 8 * n_levels, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(PerfectHash(levels), np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n))


@functools.cache
def _held_shards() -> OrderedDict:
    return OrderedDict()


def shard_at(uri: str) -> LineShard:
    """A shard, kept while the worker's shards stay under HELD_BYTES."""
    held = _held_shards()
    if uri in held:
        held.move_to_end(uri)
        return held[uri]
    shard = LineShard.read(uri)
    while held and sum(x.nbytes for x in held.values()) + shard.nbytes > HELD_BYTES:
        held.popitem(last=False)
    held[uri] = shard
    return shard


def split_lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.DictionaryArray]:
    """Line offsets per text, the lines, and their keys as codes into the distinct keys."""
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(flat, characters=ASCII_SPACE))
    return lines.offsets.to_numpy().astype(np.int64), flat, pc.dictionary_encode(keys)


def hashes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit halves per key."""
    digests = b"".join(map(xxhash.xxh3_128_digest, keys.cast(pa.binary()).to_pylist()))
    both = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n): the number of documents that hold each distinct line key of at least ``min_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_ in text_runs(batches, RUN_BYTES):
            texts = run_.column("text")
            offsets, _, coded = split_lines(texts)
            codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            once = np.unique(doc * len(distinct) + codes) % len(distinct)
            n = np.bincount(once, minlength=len(distinct))
            long_enough = pc.greater_equal(pc.utf8_length(distinct), min_chars)
            h1, h2 = hashes(distinct.filter(long_enough))
            n = n[long_enough.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([h1.view(np.int64), h2.view(np.int64), n], names=["h1", "h2", "n"])

    found = docs.select("text").mapInArrow(run, "h1 long, h2 long, n long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, least: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """The index of the lines found in at least ``least`` documents: (shard, n_shards, uri, n_keys), one row per file."""
    spark = docs.sparkSession
    keys = written(line_counts(docs, min_chars).where(F.col("n") >= least), "line-counts")
    n_shards = max(1, -(-keys.count() // keys_per_shard))
    folder = fresh_path(spark, "line-shards")
    shard = F.shiftright(F.shiftrightunsigned("h1", 32) * F.lit(n_shards).cast("long"), 32).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64)
        uri = f"{folder}/shard-{rows['shard'].iloc[0]:06d}-{uuid.uuid4().hex}.lines"
        LineShard.build(h1, h2, rows["n"].to_numpy()).write(uri)
        return pd.DataFrame([(rows["shard"].iloc[0], n_shards, uri, len(rows))],
                            columns=["shard", "n_shards", "uri", "n_keys"])

    dealt = keys.withColumn("shard", shard).repartition(n_shards, "shard")
    return written(dealt.groupBy("shard").applyInPandas(build, "shard int, n_shards int, uri string, n_keys long"),
                   "line-index")


class LineIndex:
    """Counts of lines by the shard files of an index."""

    def __init__(self, n_shards: int, uris: dict[int, str]):
        self.n_shards, self.uris = n_shards, uris

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), np.int64)
        shard = scaled(h1, self.n_shards).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.n_shards + 1))
        for k, uri in sorted(self.uris.items()):
            rows = order[cuts[k]:cuts[k + 1]]
            if len(rows):
                out[rows] = shard_at(uri).count(h1[rows], h2[rows])
        return out


def drop_lines(docs: DataFrame, index: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): ``docs`` without the lines that the index finds in ``min_docs`` documents."""
    # One row per shard file, a millionth of the indexed lines.
    files = index.select("shard", "n_shards", "uri").collect()
    lines = LineIndex(files[0]["n_shards"] if files else 1, {r["shard"]: r["uri"] for r in files})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_ in text_runs(batches, RUN_BYTES):
            ids, texts = run_.column("doc_id"), run_.column("text")
            offsets, flat, coded = split_lines(texts)
            long_enough = pc.greater_equal(pc.utf8_length(coded.dictionary), min_chars).to_numpy(zero_copy_only=False)
            gone = (lines.count(*hashes(coded.dictionary)) >= min_docs) & long_enough
            keep = ~gone[coded.indices.to_numpy()]
            cuts = offsets_of(keep)[offsets]
            kept = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat.filter(pa.array(keep)))
            n_lines = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([ids, n_lines, n_lines - np.diff(cuts), pc.binary_join(kept, "\n")],
                                             names=["doc_id", "n_lines", "n_dropped", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, text string")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return drop_lines(docs, build_index(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH split AS (
  SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT row_no, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_no) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY row_no, doc_id
"""

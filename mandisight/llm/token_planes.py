"""Operator 6: token-id files of bit or byte planes.

A shard file holds, in ascending document order, blocks of ``block`` ids. A
block is transposed into planes (all lowest bytes, then all second bytes, ...
or one bit of every id per plane), each plane is compressed with zstandard on
its own, and planes above the highest used one are not stored. Behind the
blocks lies a document index (ids and counts) per reading unit; the footer is
the chunk index (ids, plane places and a crc32 per block) with the places of
the document indexes, and the last 16 bytes say where it starts.

Writing range-partitions documents by id, so shard k holds lower ids than
shard k + 1. Every shard lists reading units (runs of whole documents of
about ``unit`` ids), so that reading splits further than shards and one long
document is one unit. A reader fetches only the index of its unit and the blocks that this touches.

Defined results: null and empty texts hold only the end id; rows that repeat
a doc_id are kept, ordered by text; a null doc_id sorts first; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mandisight.llm import store, vocab
from mandisight.llm.common import fresh_path, given_back, offsets_of, table, text_runs, written

MAGIC = b"TIDPLAN1"
BLOCK = 1 << 16
UNIT = 1 << 20
UNITS_PER_TASK = 4
#: Text encoded together: the more, the more words repeat.
CHUNK_BYTES = 4_000_000
END_ID = 1


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of ids, the lowest first; planes beyond the highest used one are left out."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    high = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(-(-high // 8))]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(high)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        octets = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        octets = np.packbits(bits, axis=1, bitorder="little")
    return octets.view("<u4").ravel()


class ShardWriter:
    def __init__(self, uri: str, kind: str = "byte", block: int = BLOCK, unit: int = UNIT, level: int = 3):
        self.uri, self.kind, self.block, self.unit = uri, kind, block, unit
        self.file, self.squeeze = store.create(uri), zstandard.ZstdCompressor(level=level)
        self.file.write(MAGIC)
        self.at, self.held, self.n_held, self.ids = len(MAGIC), [], 0, 0
        self.chunks: list = []
        self.doc_ids: list = []
        self.counts: list[int] = []
        self.units: list[list[int]] = []  # first document, documents, first id, ids

    def add(self, doc_id, ids: np.ndarray) -> None:
        if not self.units or self.units[-1][3] >= self.unit:
            self.units.append([len(self.counts), 0, self.ids, 0])
        self.units[-1][1] += 1
        self.units[-1][3] += len(ids)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(flat) if last else len(flat) // self.block * self.block
        for a in range(0, stop, self.block):
            ids = flat[a:min(a + self.block, stop)].astype("<u4")
            sizes = []
            for plane in to_planes(ids, self.kind):
                packed = self.squeeze.compress(plane)
                self.file.write(packed)
                sizes.append(len(packed))
            self.chunks.append([self.at, len(ids), zlib.crc32(ids.tobytes()), sizes])
            self.at += sum(sizes)
        self.held, self.n_held = [flat[stop:]], len(flat) - stop

    def close(self) -> None:
        self._flush(last=True)
        places = []
        for first, n_docs, _, _ in self.units:
            index = self.squeeze.compress(json.dumps([self.doc_ids[first:first + n_docs],
                                                      self.counts[first:first + n_docs]]).encode())
            self.file.write(index)
            places.append([self.at, len(index)])
            self.at += len(index)
        footer = self.squeeze.compress(json.dumps({
            "kind": self.kind, "block": self.block, "chunks": self.chunks, "units": places}).encode())
        self.file.write(footer)
        self.file.write(struct.pack("<Q", self.at) + MAGIC)
        self.file.close()


class ShardReader:
    def __init__(self, uri: str):
        self.file, self.expand = store.open_random(uri), zstandard.ZstdDecompressor()
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a complete shard")
        start = struct.unpack("<Q", tail[:8])[0]
        footer = json.loads(self.expand.decompress(self.file.read_at(size - 16 - start, start)))
        self.kind, self.block, self.chunks, self.units = (footer[k] for k in ("kind", "block", "chunks", "units"))

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, sizes = self.chunks[k]
        data, planes = self.file.read_at(sum(sizes), at), []
        for size in sizes:
            planes.append(self.expand.decompress(data[:size]))
            data = data[size:]
        ids = from_planes(planes, n, self.kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self, unit: int, first_id: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of a unit's documents, holding a few blocks at a time."""
        at, size = self.units[unit]
        doc_ids, counts = json.loads(self.expand.decompress(self.file.read_at(size, at)))
        k = first_id // self.block
        start, base, flat = first_id, k * self.block, np.zeros(0, "<u4")
        for doc_id, count in zip(doc_ids, counts, strict=True):
            stop = start + count
            if base + len(flat) < stop:
                # Blocks before this document's start are done with; the next ones up to its end are joined once.
                done = (start - base) // self.block * self.block
                more, have = [flat[done:]], base + len(flat)
                while have < stop:
                    more.append(self.chunk(k))
                    have += len(more[-1])
                    k += 1
                flat, base = np.concatenate(more), base + done
            yield doc_id, start, flat[start - base:stop - base]
            start = stop


UNIT_COLUMNS = ["shard", "uri", "unit", "first_doc", "n_docs", "first_id", "n_ids"]
UNIT_SCHEMA = "shard int, uri string, unit int, first_doc long, n_docs long, first_id long, n_ids long"


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID,
                 kind: str = "byte", block: int = BLOCK, unit: int = UNIT) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard files under ``folder``; the
    returned table (one row per reading unit) is the manifest and names the files that count."""
    file = path or vocab.tokenizer_path(vocab.WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, writer = vocab.library_encoder(file, True), None
        shard = TaskContext.get().partitionId()
        for run_ in text_runs(batches, CHUNK_BYTES):
            flat, counts = encode(run_.column("text"))
            # The end id behind every document's ids.
            closed = np.insert(flat.astype("<u4"), np.cumsum(counts), end_id)
            cuts = offsets_of(counts + 1)
            if writer is None:
                writer = ShardWriter(f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tid", kind, block, unit)
            for doc_id, a, b in zip(run_.column("doc_id").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                writer.add(doc_id, closed[a:b])
        if writer:
            writer.close()
            rows = [(shard, writer.uri, i, *u) for i, u in enumerate(writer.units)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=UNIT_COLUMNS).astype({"shard": "int32", "unit": "int32"}),
                                             preserve_index=False)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(lambda batches: given_back(run(batches)), UNIT_SCHEMA), "token-manifest")


def read_units(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Documents of the shards, with the number of ids before each in the whole set."""
    # One row per shard passes the single ordering window, whatever the corpus holds in a shard.
    totals = manifest.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("shard_start"))
    # The rows are few but each stands for up to a million ids: a stated number of tasks keeps them apart.
    tasks = -(-manifest.count() // UNITS_PER_TASK)
    units = manifest.join(starts, "shard").repartition(max(1, tasks), F.col("shard"), F.col("unit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for u in batch.itertuples():
                rows = [(doc_id, u.shard_start + start, len(ids), zlib.crc32(ids.tobytes()),
                         *([ids.astype(np.int32)] if keep_ids else []))
                        for doc_id, start, ids in ShardReader(u.uri).documents(u.unit, u.first_id)]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32",
                                                  *(["ids"] if keep_ids else [])])
                yield out.astype({"doc_id": "Int64"})

    return units.select("uri", "unit", "first_id", "shard_start").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return read_units(write_shards(docs, fresh_path(spark, "token-shards")))

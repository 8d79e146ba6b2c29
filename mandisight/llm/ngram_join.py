"""Operator 3: n-gram Jaccard join by MinHash banding.

Texts are sets of five-word shingles; two texts are linked when the Jaccard
similarity of the full sets is at least 0.8.

1. Texts of equal words are one class (smallest doc_id, number of copies),
   combined inside every task before the shuffle.
2. Each class gets a MinHash signature. Bands and rows follow from a target
   recall at the threshold: of all row counts whose bands fit the number of
   hashes, the largest, which leaves the fewest false candidates.
3. Classes are shuffled on their band hashes; every member of a band points
   to the band's smallest member, and the connected pieces of these pointers
   are the candidate groups. A pair that shares a band is in one group.
4. Groups are verified on the full shingle sets in pairs of bounded blocks.
   A unit returns link counts and the smallest linked id, no row per pair, so
   a group of any size is split and no link between different texts is lost.

Defined results: words are separated by ASCII white space and compared as
they are; a text of one to four words is a single shingle of all its words; a
text without a word (null, empty, white space) links with nothing; rows with
a null doc_id keep a null class and no links; rows that repeat a doc_id
count as copies where their words are equal and are joined as any two texts
where not (of a linked pair with one doc_id, one text is kept); an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mandisight.llm.blocks import classes, in_block_pairs, linked
from mandisight.llm.common import ASCII_SPACE, offsets_of, table, text_chunks, written
from mandisight.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9995
MAX_HASHES = 256
BLOCK = 64
SLAB = 1 << 14
MULTIPLIERS = np.random.default_rng(20240229).integers(0, 1 << 31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def banding(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the largest row count whose bands reach ``recall`` at ``threshold`` within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall with so many hashes")
    return best


def normalised(text) -> F.Column:
    """The words of a text with one space between them."""
    spaced = F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, " " * len(ASCII_SPACE))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of normalised texts: (flat, shingles per text), repeats included."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    counts = np.diff(parts.offsets.to_numpy())
    coded = pc.dictionary_encode(parts.flatten())
    hashed = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), object), categorize=False)
    h = hashed[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    empty = np.fromiter((t == "" for t in texts), bool, len(texts))
    starts = offsets_of(counts)
    out, lengths = [], np.zeros(len(texts), np.int64)
    # Polynomial over consecutive words; places whose window leaves the text are not used.
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(rolled)]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    for i, (a, n) in enumerate(zip(starts[:-1].tolist(), counts.tolist(), strict=True)):
        if empty[i]:
            continue
        if n >= words:
            run = rolled[a:a + n - words + 1]
        else:
            value = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[a:a + n]:
                    value = value * np.uint64(0xD6E8FEB86659FD93) + x
            run = np.array([value], np.uint64)
        out.append(run)
        lengths[i] = len(run)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), lengths


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature of a shingle set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    signature = np.empty(bands * rows, np.uint32)
    step = max(1, (1 << 16) // max(1, len(low)))
    for k in range(0, bands * rows, step):
        m = MULTIPLIERS[k:min(k + step, bands * rows), None]
        if len(low) <= 1 << 16:
            signature[k:k + len(m)] = (m * low).min(axis=1)
        else:
            signature[k] = min(int((m[0] * low[a:a + (1 << 16)]).min()) for a in range(0, len(low), 1 << 16))
    value = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in signature.reshape(bands, rows).T:
        value = (value ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        value ^= value >> np.uint64(33)
    return value.view(np.int64)


def signatures(distinct: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """The columns of ``distinct`` with ``words`` (normalised text) replaced by ``bands``."""
    others = [f for f in distinct.schema if f.name != "words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["words"].tolist()
            for a, b in text_chunks(texts):
                flat, counts = shingle_hashes(texts[a:b], words)
                cuts = offsets_of(counts)
                yield batch.iloc[a:b].drop(columns="words").assign(bands=[
                    band_hashes(flat[x:y], bands, rows) if y > x else np.zeros(0, np.int64)
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True)])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return distinct.select(*[f.name for f in others], "words").mapInPandas(run, schema + ", bands array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """The columns of ``texts`` with ``words`` (normalised text) replaced by ``shingles``: the sorted set as bytes."""
    others = [f for f in texts.schema if f.name != "words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["words"].tolist()
            for a, b in text_chunks(rows):
                flat, counts = shingle_hashes(rows[a:b], words)
                cuts = offsets_of(counts)
                yield batch.iloc[a:b].drop(columns="words").assign(shingles=[
                    np.unique(flat[x:y]).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return texts.select(*[f.name for f in others], "words").mapInPandas(run, schema + ", shingles binary")


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common shingles of every set of ``left`` with every set of ``right`` (positions)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    code = np.cumsum(new) - 1
    shared = np.bincount(code) > 1  # a shingle of one set alone adds nothing
    keep = shared[code]
    column, owner = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
    total = np.zeros((len(left), len(right)), np.float64)
    n_columns = int(shared.sum())
    for a in range(0, n_columns, SLAB):
        x, y = np.searchsorted(column, [a, a + SLAB])
        dense = np.zeros((len(sets), min(SLAB, n_columns - a)), np.float32)
        dense[owner[x:y], column[x:y] - a] = 1
        total += dense[left] @ dense[right].T  # exact: counts stay below 2 ** 24
    return total


def find_links(threshold: float):
    """A unit's pairs with Jaccard similarity of at least ``threshold``."""

    def find(unit: pd.DataFrame, left: np.ndarray, inner: bool) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"]]
        rows = np.arange(len(sets)) if inner else np.flatnonzero(left)
        cols = np.arange(len(sets)) if inner else np.flatnonzero(~left)
        common = intersections(sets, rows, cols)
        sizes = np.array([len(s) for s in sets], np.float64)
        union = sizes[rows][:, None] + sizes[cols] - common
        ok = (common > 0) & (common >= threshold * union - 1e-9)
        if inner:
            ok = np.triu(ok, 1)
        a, b = np.nonzero(ok)
        return rows[a], cols[b]

    return find


def word_key(text) -> F.Column:
    """The class of equal words of a text; null without a word."""
    words = normalised(text)
    return F.when(words != "", F.sha2(words, 256))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS,
                 recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_links (other documents linked directly), class_id (smallest doc_id reachable) and kept for every
    row of ``docs`` (doc_id, text)."""
    return keyed_join(docs, threshold, words, recall, block).drop("key")


def keyed_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS,
               recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """As ``jaccard_join``, with the ``word_key`` of every row (null without a doc_id)."""
    bands, rows = banding(threshold, recall)
    members = written(docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), word_key(F.col("text"))).alias("key")),
                      "members")
    copies = written(members.where(F.col("key").isNotNull()).groupBy("key")
                     .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    # A number of its own for every class, in the order of the smallest doc_ids; written, so that it stays the same.
    copies = written(copies.orderBy("first", "key").withColumn("rep", F.monotonically_increasing_id()), "copies")
    # A class is represented by a row of its smallest doc_id; equal ids of equal words are one row.
    source = docs.select(F.col("doc_id").alias("first"), word_key(F.col("text")).alias("key"),
                         normalised(F.col("text")).alias("words")).where(
        F.col("first").isNotNull() & F.col("key").isNotNull())
    signed = written(signatures(source, bands, rows, words), "signatures")
    signed = signed.join(copies.select("first", "key", "rep"), ["first", "key"])
    banded = signed.select("rep", F.explode("bands").alias("band"))
    shared = (banded.groupBy("band").agg(F.min("rep").alias("root"), F.max("rep").alias("_last"))
              .where(F.col("_last") > F.col("root")).drop("_last"))
    # A class points to the smallest of its bands' roots, and the other roots point there too: as connected as a
    # pointer per band, but about one per class, since the classes of a large group share their few roots.
    roots = banded.join(shared, "band").groupBy("rep").agg(F.collect_set("root").alias("roots")).select(
        "rep", "roots", F.array_min("roots").alias("b"))
    pointers = roots.select(F.col("rep").alias("a"), "b").unionByName(
        roots.select(F.explode("roots").alias("a"), "b")).where("a <> b").distinct()
    candidates = connected_components(pointers).select(F.col("node").alias("rep"), F.col("component").alias("_group"))
    # Cut to the candidates first: the join leaves their rows by (first, key), where repeats then go without a shuffle.
    sets = written(shingle_sets(
        source.join(candidates.join(copies, "rep"), ["first", "key"]).dropDuplicates(["first", "key"])
        .drop("first", "key"), words), "shingles")
    sizes = sets.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    units, n = in_block_pairs(sets, ["_group"], block, sizes)
    found = classes(linked(units, ["_group"], find_links(threshold), n))
    # One row per class of equal words, then back to every document of the class.
    result = copies.join(found, "rep", "left").select(
        "key", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), "rep",
        F.coalesce("component", "rep").alias("component"))
    # The smallest number of a component is that of its smallest doc_id.
    result = result.join(copies.select(F.col("rep").alias("component"), F.col("first").alias("class_id")), "component")
    result = result.select("key", "n_links", "class_id", (F.col("rep") == F.col("component")).alias("_root"))
    return members.join(result, "key", "left").select(
        "doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce((F.col("doc_id") == F.col("class_id")) & F.col("_root"), F.lit(True)).alias("kept"), "key")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
pairs AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, class_id, doc_id = class_id AS kept
FROM documents JOIN classes ON classes.x = doc_id LEFT JOIN degree ON degree.x = doc_id
"""

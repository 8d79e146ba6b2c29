"""Operator 5: near-duplicate embeddings by randomly rotated binary codes.

Vectors of one label whose cosine is at least 0.93 are linked. Equal vectors
are one class, combined inside every task before the shuffle. Every class
stores a binary code, the signs of its unit vector after a random rotation,
and a correction factor, the inner product f of the unit vector with its
code. For a code b of x and a rotated unit vector y, <b, y> / f is an unbiased
estimate of <x, y>; its error is sqrt((1 - f^2) / f^2) * sqrt(1 - <x, y>^2)
times a unit inner product of spread 1 / sqrt(d - 1). A pair whose estimate
lies below what a cosine at the threshold can show at the asked confidence
(never asking for more than the certain Cauchy-Schwarz bound) is out; all
others are recomputed exactly in double precision, and only that decides.

Vectors are dealt by their nearest pivot (of a bounded sample) and in order
of the angle to it; blocks whose angles to the pivots prove that no pair can
reach the threshold are never compared. The others are compared in pairs of
bounded blocks that return counts, no row per pair. Every block is stored once
in the shared folder, codes apart from vectors, and the task of a pair reads
the two from there: the pairs grow with the square of a label, but nothing that
is written or shuffled for them holds a vector. A stored table goes as soon as
the next step has read it.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows with a null label, link with nothing; a null vec_id
links with nothing and has a null component; vectors of different length
never link; rows that repeat a vec_id count as vectors; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mandisight.llm import store
from mandisight.llm.blocks import classes, link_rows
from mandisight.llm.common import drop, fresh_path, given_back, table, written, written_at

THRESHOLD = 0.93
#: Standard deviations of the estimate allowed for; 6 leaves about one wrong rejection in 10 ** 8.
CONFIDENCE = 6.0
#: Distinct vectors in a block.
BLOCK = 512
#: Vectors collected to choose the pivots that prune pairs of blocks (they never decide a pair).
PIVOT_SAMPLE = 2000
PIVOTS = 16
#: Dimensions that get pivots, the most frequent first; vectors of others are compared in all their pairs of blocks.
PIVOT_DIMS = 8
#: Pairs of one second block that follow one another in a task, and of a task.
PAIRS_IN_ROW = 16
PAIRS_PER_TASK = 16
#: Rows of the table of angle steps that is broadcast (some 100 bytes each).
MAX_BROADCAST_STEPS = 100_000
#: Files a task holds open at once.
OPEN_FILES = 32


@functools.lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, made once per worker and dimension."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of unit vectors, and their correction factors."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors with rotated unit vectors."""
    dim = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    return (signs / (np.sqrt(dim) * factors[:, None])).astype(np.float32) @ turned.T.astype(np.float32)


def least_estimate(factors: np.ndarray, dim: int, threshold: float, confidence: float) -> np.ndarray:
    """The smallest estimate that a pair at or above ``threshold`` shows at this confidence."""
    spread = min(1.0, confidence / np.sqrt(max(1, dim - 1)))
    error = np.sqrt(np.maximum(0.0, 1 - factors ** 2)) / factors * np.sqrt(1 - threshold ** 2)
    return threshold - spread * error - 1e-5  # the estimates are single precision


def pivots_of(vectors: np.ndarray, k: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Unit pivots by spherical k-means on a bounded sample."""
    k = min(k, len(vectors))
    pivots = vectors[np.random.default_rng(3).permutation(len(vectors))[:k]].copy()
    for _ in range(rounds):
        near = (vectors @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), pivots)
    return pivots


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors in double precision, scaled by a power of two, which rounds nothing, so that squares of tiny or huge
    values stay finite."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


@dataclass
class Block:
    """A stored block: ids, copies, factors and codes; the vectors are read when they are asked for."""

    rep: np.ndarray
    copies: np.ndarray
    factors: np.ndarray
    codes: np.ndarray
    file: object
    at: int
    dim: int
    width: int

    @functools.cached_property
    def vectors(self) -> np.ndarray:
        raw = self.file.read_at(len(self.rep) * self.dim * self.width, self.at)
        return scaled(np.frombuffer(raw, f"<f{self.width}").reshape(len(self.rep), self.dim))

    @functools.cached_property
    def norms(self) -> np.ndarray:
        return np.sqrt((self.vectors * self.vectors).sum(axis=1))

    @functools.cached_property
    def turned(self) -> np.ndarray:
        return (self.vectors / self.norms[:, None]) @ rotation(self.dim)


def block_bytes(rows: pd.DataFrame) -> bytes:
    """A block as it is stored: the ids, the copies, the factors, the codes, then the vectors."""
    return b"".join([rows["rep"].to_numpy(np.int64).tobytes(), rows["copies"].to_numpy(np.int64).tobytes(),
                     rows["factor"].to_numpy(np.float64).tobytes(), *rows["code"], *rows["vector"]])


def read_block(file, at: int, n: int, dim: int, width: int) -> Block:
    code = -(-dim // 8)
    head = file.read_at(n * (24 + code), at)
    ids, copies = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.int64, n, 8 * n)
    return Block(ids, copies, np.frombuffer(head, np.float64, n, 16 * n),
                 np.frombuffer(head, np.uint8, n * code, 24 * n).reshape(n, code), file, at + len(head), dim, width)


def stored(dealt: DataFrame, folder: str) -> DataFrame:
    """Write the blocks (label, dim, _b) of ``dealt``, a file per task, into ``folder``; their places."""
    keys = ["label", "dim", "_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, out, at, places, held = f"{uuid.uuid4().hex}.blocks", None, 0, [], []

        def put() -> None:
            nonlocal out, at
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            out = out or store.create(f"{folder}/{name}")
            data = block_bytes(rows)
            out.write(data)
            places.append((*rows[keys].iloc[0], name, at, len(rows)))
            at += len(data)
            held.clear()

        key = None
        for batch in batches:
            # Rows of a block follow one another; a block may go on in the next batch.
            change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            cuts = sorted({0, *np.flatnonzero(change).tolist()}) if len(batch) else []
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part = batch.iloc[a:b]
                now = tuple(part[keys].iloc[0])
                if now != key and held:
                    put()
                key = now
                held.append(part)
        if held:
            put()
        if out is not None:
            out.close()
            yield pd.DataFrame(places, columns=[*keys, "file", "at", "n"])

    kind = dealt.schema["label"].dataType.simpleString()
    rows = dealt.select(*keys, "rep", "copies", "factor", "code", "vector").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(lambda batches: given_back(run(batches)),
                            f"label {kind}, dim int, _b string, file string, at long, n int")


def links_between(left: Block, right: Block, inner: bool, threshold: float, confidence: float) -> pd.DataFrame | None:
    """(rep, n_links, root) of the members of two blocks, or of one, whose cosine is at least ``threshold``."""
    open_ = estimates(left.codes, left.factors, right.turned) >= \
        least_estimate(left.factors, left.dim, threshold, confidence)[:, None]
    if inner:
        open_ = np.triu(open_, 1)
    a, b = np.nonzero(open_)
    keep = np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 16):  # exact recomputation in bounded steps
        x, y = a[s:s + (1 << 16)], b[s:s + (1 << 16)]
        dots = np.einsum("ij,ij->i", left.vectors[x], right.vectors[y])
        keep[s:s + (1 << 16)] = dots / (left.norms[x] * right.norms[y]) >= threshold
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    if inner:
        return link_rows(left.rep, left.copies, a, b)
    return link_rows(np.concatenate([left.rep, right.rep]), np.concatenate([left.copies, right.copies]), a, b + len(left.rep))


def linked(pairs: DataFrame, n: int, folder: str, width: int, threshold: float, confidence: float) -> DataFrame:
    """(rep, n_links, root) of the members that have links in a pair of stored blocks; ``pairs``: where both stand.

    ``n``: how many pairs there are. The tasks follow it, since comparing costs more than the bytes show.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict[str, object] = {}

        def block(name: str, at: int, rows: int, dim: int) -> Block:
            if name not in files:
                if len(files) >= OPEN_FILES:
                    files.pop(next(iter(files))).close()
                files[name] = store.open_random(f"{folder}/{name}")
            return read_block(files[name], at, rows, dim, width)

        place, right = None, None
        for batch in batches:
            for p in batch.itertuples(index=False):
                if place != (p.j_file, p.j_at):  # pairs of one second block follow one another
                    place, right = (p.j_file, p.j_at), block(p.j_file, p.j_at, p.j_n, p.dim)
                    _ = right.turned
                inner = place == (p.i_file, p.i_at)
                found = links_between(right if inner else block(p.i_file, p.i_at, p.i_n, p.dim), right, inner,
                                      threshold, confidence)
                if found is not None:
                    yield found
        for file in files.values():
            file.close()

    ends = [f"{side}_{c}" for side in "ij" for c in ("file", "at", "n")]
    dealt = (pairs.select("dim", *ends, "_row").repartition(max(1, -(-n // PAIRS_PER_TASK)), "j_file", "j_at", "_row")
             .sortWithinPartitions("j_file", "j_at", "i_file", "i_at"))
    return dealt.mapInPandas(lambda batches: given_back(run(batches)), "rep long, n_links long, root long")


def digest(v: Column, kind: str) -> Column:
    """SHA-256 of a vector of finite ``kind`` numbers: different vectors have different digests."""
    return F.unhex(F.sha2(F.concat_ws(",", F.transform(v, lambda x: (x + F.lit(0.0).cast(kind)).cast("string"))), 256))


def is_usable() -> Column:
    """Whether a row can link at all."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))
            & F.col("vec_id").isNotNull() & F.col("label").isNotNull())


def width_of(kind: str) -> int:
    """Bytes of a component of an array type."""
    return 4 if kind == "array<float>" else 8


def coded(distinct: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Classes (rep, label, dim, copies, v) with vector bytes, code, factor, nearest pivot and the angle to it."""
    width = width_of(distinct.schema["v"].dataType.simpleString())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                raw = np.stack(rows["v"].to_numpy()).astype(f"<f{width}")
                v = scaled(raw)
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                codes, factors = codes_of(unit)
                near = unit @ pivots[dim].T if dim in pivots else np.ones((len(unit), 1))
                cell = near.argmax(axis=1)
                yield rows[["rep", "label", "dim", "copies"]].assign(
                    vector=[x.tobytes() for x in raw], code=[x.tobytes() for x in codes], factor=factors,
                    cell=cell.astype(np.int32),
                    angle=np.arccos(np.clip(near[np.arange(len(unit)), cell], -1, 1)))

    kind = distinct.schema["label"].dataType.simpleString()
    return distinct.select("rep", "label", "dim", "copies", "v").mapInPandas(
        run, f"rep long, label {kind}, dim int, copies long, vector binary, code binary, factor double, "
             "cell int, angle double")


def block_pairs(cells: DataFrame, pivots: dict[int, np.ndarray], threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """``cells`` with the name of a block within (label, dim), and the pairs of blocks that may hold a link."""
    group = ["label", "dim"]
    # Angle steps that hold about one block each: counts per fine step, a bounded number of rows per cell.
    step = F.floor(F.col("angle") * 512).cast("int")
    salts = F.greatest(F.lit(1), F.ceil(F.col("_n") / block)).cast("int")
    fine = cells.withColumn("_step", step).groupBy(*group, "cell", "_step").agg(
        F.count(F.lit(1)).alias("_n"), F.min("angle").alias("_low"), F.max("angle").alias("_high"))
    run = Window.partitionBy(*group, "cell").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("_run", F.floor(F.coalesce(F.sum("_n").over(run), F.lit(0)) / block).cast("int"))
    runs = fine.groupBy(*group, "cell", "_run").agg(
        F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high")).withColumn("_salts", salts)
    steps = written(fine.select(*group, "cell", "_step", "_run").join(
        runs.select(*group, "cell", "_run", "_salts"), [*group, "cell", "_run"]), "steps")
    # The vectors need no shuffle of their own while the steps are few.
    steps = F.broadcast(steps) if steps.count() <= MAX_BROADCAST_STEPS else steps
    dealt = cells.withColumn("_step", step).join(steps, [*group, "cell", "_step"]).withColumn(
        "_salt", F.pmod(F.xxhash64("rep"), F.col("_salts")).cast("int"))
    name = F.concat_ws("-", "cell", "_run", "_salt")
    blocks = runs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select(
        *group, name.alias("_block"), "cell", "_low", "_high")
    angles = {d: np.arccos(np.clip(p @ p.T, -1, 1)) for d, p in pivots.items()}
    between = F.lit(0.0)
    if angles:
        flat = F.create_map(*[x for d, m in angles.items() for x in (
            F.lit(d), F.array(*[F.lit(float(v)) for v in m.ravel()]))])
        width = F.create_map(*[F.lit(x) for d, m in angles.items() for x in (d, len(m))])
        between = F.get(flat[F.col("dim")], F.col("a.cell") * width[F.col("dim")] + F.col("b.cell"))
    reach = float(np.arccos(threshold)) + 1e-6
    far = F.when(F.col("a.cell") == F.col("b.cell"), F.greatest(
        F.col("b._low") - F.col("a._high"), F.col("a._low") - F.col("b._high"))).otherwise(
        F.coalesce(between, F.lit(0.0)) - F.col("a._high") - F.col("b._high"))
    pairs = (blocks.alias("a").join(blocks.alias("b"), group)
             .where((F.col("a._block") <= F.col("b._block")) & (far <= reach))
             .select(*group, F.col("a._block").alias("_i"), F.col("b._block").alias("_j")))
    return dealt.withColumn("_b", name).drop("_step", "_run", "_salts", "_salt"), pairs


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, confidence: float = CONFIDENCE,
                    block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.where(is_usable()).select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("v"))
    distinct, distinct_at = written_at(
        rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dim", F.size("v")), "vectors")
    known = written(distinct.select("label", digest(F.col("v"), kind).alias("_digest"), "rep", "copies"), "vector-digests")
    dims = [r["dim"] for r in distinct.groupBy("dim").count().orderBy(F.desc("count")).limit(PIVOT_DIMS).collect()]
    pivots: dict[int, np.ndarray] = {}
    for dim in dims:
        some = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("rep")).select("v").limit(PIVOT_SAMPLE).collect()
        x = np.array([r["v"] for r in some], float)
        pivots[dim] = pivots_of(x / np.linalg.norm(x, axis=1, keepdims=True))
    cells, cells_at = written_at(coded(distinct, pivots), "codes")
    drop(spark, distinct_at)
    dealt, pairs = block_pairs(cells, pivots, threshold, block)
    pairs, folder = written(pairs, "pairs"), fresh_path(spark, "blocks")
    places = written(stored(dealt, folder), "block-places")
    drop(spark, cells_at)
    # A pair names the places of its blocks; the same second block follows itself in short runs.
    group = ["label", "dim"]
    for side in "ij":
        at = places.select(*group, F.col("_b").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in ("file", "at", "n")])
        pairs = pairs.join(at, [*group, f"_{side}"])
    number = F.row_number().over(Window.partitionBy("j_file", "j_at").orderBy("i_file", "i_at"))
    pairs, pairs_at = written_at(pairs.select("dim", *[f"{s}_{c}" for s in "ij" for c in ("file", "at", "n")], F.floor(
        (number - 1) / PAIRS_IN_ROW).cast("int").alias("_row")), "placed-pairs")
    found = classes(linked(pairs, pairs.count(), folder, 4 if kind == "float" else 8, threshold, confidence))
    drop(spark, folder, pairs_at)
    # Classes of one vector without a link are what their row says.
    result = written(known.join(found, "rep", "left").where((F.col("copies") > 1) | F.col("n_links").isNotNull()).select(
        "label", "_digest", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("_links"),
        F.coalesce("component", "rep").alias("_component")), "vector-classes")
    ids = rows.select("vec_id", "label", digest(F.col("v"), kind).alias("_digest")).join(
        result, ["label", "_digest"], "left").select(
        "vec_id", F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"))
    rest = vectors.where(~is_usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ids.unionByName(rest).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL))
    AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
groups AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN groups ON groups.x = vec_id LEFT JOIN degree ON degree.x = vec_id
"""

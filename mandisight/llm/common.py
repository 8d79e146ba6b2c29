"""Helpers shared by the operators: shared folder, checkpoints, ragged arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the five ASCII controls \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch: with texts of some kB a few MB, on both sides of the pipe.
TEXTS_PER_BATCH = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a scratch folder
    is made and recorded in the session.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written table or set of files."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, and what was
    chosen once (row order, partition) stays the same in every later use.
    """
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, with the folder, for ``drop`` once nothing reads the table any more. The write's shuffle files go
    with it."""
    from mandisight.session import shuffles_released  # on the driver only: workers have this folder alone
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove folders of the shared folder that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this folder to the executors once per application, as ``--py-files`` would; and let Arrow batches hold
    fewer rows than Spark's default, which is meant for narrow rows, not for texts (a setting of the user stays)."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(TEXTS_PER_BATCH))
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), "llm_code.zip")
    with zipfile.ZipFile(name, "w") as out:
        out.write(os.path.join(os.path.dirname(here), "__init__.py"), "mandisight/__init__.py")
        for file in sorted(os.listdir(here)):
            if file.endswith(".py"):
                out.write(os.path.join(here, file), f"mandisight/llm/{file}")
    context.addPyFile(name)
    context._llm_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")
                   if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % folds


def text_chunks(texts: list, max_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose texts together hold about ``max_chars``
    characters (one longer text is a run of its own)."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if held and held + n > max_chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def text_runs(batches: Iterator[pa.RecordBatch], max_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows whose ``text`` holds about ``max_bytes`` (one longer text is a run of its
    own); null texts become empty."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, "text", pc.fill_null(batch.column(at), ""))
        held = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = held[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(held, done + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def given_back(rows: Iterator) -> Iterator:
    """Pass a task's rows on; at its end the worker, which Spark keeps for later tasks, gives unused memory back."""
    try:
        yield from rows
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Start offsets, with the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s + n]`` for every (s, n) without a Python loop."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    # Position p in the output reads flat[p + (start of its run - position of its run)].
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    begins = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - begins, lengths) + np.arange(total)]


"""Spark session helpers.

The library never hard-codes cluster settings: it reads what the session
already carries (``spark.checkpoint.dir`` in particular) and only fills in
defaults where they are unset, which is the case in local tests.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT methods over 8000 bytes; a stage whose generated
    # method is larger falls back to per-operator codegen instead of running
    # as interpreted bytecode.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # PySpark records the Python call site of every Column it builds (for
    # error messages); that costs several py4j calls per expression when a
    # plan is built. Jobs here build plans with thousands of expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "mandisight", cpus: int | str = "*",
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench; clusters pass their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    n = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    builder = builder.config("spark.sql.shuffle.partitions", str(n))
    builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Where it is absent a
    scratch folder is set for a single-machine session (tests, bench); on a
    cluster each machine would have its own, so that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="mandisight-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


#: Spark deletes shuffle files when the driver happens to collect the query as garbage; with this, when it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside take their shuffle files with them: for steps whose result is written. A session that
    does not know the setting (before Spark 4.1) goes on as before."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)

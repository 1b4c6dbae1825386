"""Session helpers shared by the jobs: local sessions, lineage cuts, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of (narrow) rows a job may hand to ``broadcast``.
MAX_BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch while a table is written.
ARROW_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cores: int | str = "*", app: str = "glossmill") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("GLOSSMILL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        # a task only gets whole source files, so keep Arrow batches small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; fall back to a local one.

    The fallback only applies where ``spark.checkpoint.dir`` is unset on a single
    machine; on a cluster other machines would not see a local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="glossmill-checkpoint-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Let Python tasks get at most ``rows`` rows at once while a job of ours runs.

    Rows hold whole texts, so the default of 10,000 rows can be hundreds of megabytes in
    every task, outside the heap. A smaller setting of the session is kept.
    """
    before = spark.conf.get(_ARROW_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def materialise(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut the lineage of a repeatedly read table: write it once and read it back.

    The table lies in the shared checkpoint folder, so it survives lost executors.
    Unlike a checkpointed plan it is computed once, is columnar and has a size
    that later joins can plan with.
    """
    path = scratch_path(df.sparkSession, "table")
    with small_arrow_batches(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; stops reading beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join to shuffle.

    ``df`` should be materialised: it is counted here and read again by the join.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df

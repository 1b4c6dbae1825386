"""Helpers shared by the operators: Arrow maps, shared files, fixed-size filters."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from glossmill.session import scratch_path


#: Rows that a worker turns into Python objects at once.
ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text, as an empty text where it is null; nothing else is read."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


#: The cached function whose tables this Python worker holds from task to task.
_HELD = None


def hold(tables=None) -> None:
    """Begin a task: tables that a worker still has from other operators go.

    ``tables`` is the ``lru_cache`` function that makes this operator's own ones. Workers
    serve one job after the other, so without this the tables of all stages add up.
    """
    global _HELD
    if _HELD is not None and _HELD is not tables:
        _HELD.cache_clear()
        give_back()
    _HELD = tables


def give_back() -> None:
    """Return freed memory to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str | StructType,
    tables=None,
) -> DataFrame:
    """Apply ``fn`` to slices of at most ``ROWS`` rows of every Arrow batch.

    A worker so holds the Python objects and the results of few rows at once, however
    many rows the session puts in a batch. ``tables`` see ``hold``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(tables)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield fn(batch.slice(start, ROWS))
        give_back()

    return df.mapInArrow(run, schema)




def filter_rows(
    docs: DataFrame, keeps: Callable[[str | None], bool], text: str = "text"
) -> DataFrame:
    """The rows whose text is kept, with all their columns, without moving any.

    Only texts go to the Python workers and only decisions come back.
    """

    @F.arrow_udf(BooleanType())
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hold()
        for batch in batches:
            found: list[bool] = []
            for start in range(0, len(batch), ROWS):
                found += map(keeps, batch.slice(start, ROWS).to_pylist())
            yield pa.array(found, pa.bool_())
        give_back()

    return docs.where(kept(F.col(f"`{text}`")))


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that Python tasks write, in the shared folder."""
    path = scratch_path(spark, name)
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return path


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a URI, local or not."""
    return pafs.FileSystem.from_uri(uri)


def fresh_name(partition: int, suffix: str) -> str:
    """A file name no other attempt of the same task uses.

    A repeated attempt writes another file; readers only open the files that the
    manifest of the committed attempts names.
    """
    return f"part-{partition:06d}-{uuid.uuid4().hex}{suffix}"


class Bloom:
    """A bit table of fixed size over 64-bit keys, built by Spark, read with numpy."""

    def __init__(self, words: np.ndarray, log_bits: int):
        self.words, self.log_bits = words, log_bits

    @staticmethod
    def _slots(keys: np.ndarray, log_bits: int) -> list[np.ndarray]:
        unsigned = keys.view(np.uint64) if keys.dtype == np.int64 else keys
        out = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            out.append((unsigned * np.uint64(factor)) >> np.uint64(64 - log_bits))
        return out

    @classmethod
    def of(cls, keys: DataFrame, column: str, log_bits: int) -> Bloom:
        """Set the bits of a long column; the driver gets ``2**log_bits`` bits at most."""

        def slots(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            both = np.concatenate(cls._slots(values, log_bits)).astype(np.int64)
            both = np.unique(both)
            return pa.RecordBatch.from_arrays(
                [pa.array(both >> 6), pa.array(np.int64(1) << (both & 63))], ["word", "bits"]
            )

        rows = (
            map_batches(keys.select(column), slots, "word long, bits long")
            .groupBy("word")
            .agg(F.bit_or("bits").alias("bits"))
            .toArrow()
        )
        words = np.zeros(1 << (log_bits - 6), dtype=np.int64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        return cls(words, log_bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that was set, and for a few others."""
        found = np.ones(len(keys), dtype=bool)
        for slot in self._slots(keys, self.log_bits):
            slot = slot.astype(np.int64)
            found &= (self.words[slot >> 6] >> (slot & 63)) & 1 == 1
        return found

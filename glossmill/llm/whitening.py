"""Whitened embeddings; the covariance comes from exact squares by polarisation.

1. Entries become whole numbers, ``floor(scale * c)``; equal vectors count once. Vectors
   travel as packed numbers of the least width that holds them.
2. Exact sums per dimension give the mean.
3. For every dimension, and for the sum of every pair of dimensions, the squared
   deviations from the mean are summed exactly. With ``y`` centred,
   ``2 cov(a, b) = var(a + b) - var(a) - var(b)``: differences of variances give all
   cross-covariances, in whole numbers, without loss.
4. The matrix (dimensions squared, whatever the number of rows) is assembled on the
   driver for ``eigh``; the rows are projected where they lie.

A deviation ``n x - S`` is kept as ``n u - r`` with ``u`` the distance from the mean's
whole part and ``0 <= r < n``. ``u`` is small, so tasks sum squares in 64 bits, by blocks;
a block whose squares could leave 64 bits is summed in unbounded whole numbers. The
share of ``n`` and ``r`` in the squares is the same for all rows and put back exactly.

Rows whose vector is null, empty, or holds a null or a value that is not finite are
dropped. Repeated rows get their results each. Vectors of different lengths, or with
entries beyond 64 bits once scaled, end the job with an error. An empty table gives no
rows. A component without variance has null ``whitened`` values and takes no part in
``identity_error``; if no component has any, that and ``explained`` are null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import materialise

SCALE = 256
#: Rows whose squares are summed at once.
BLOCK = 2048
#: A row of exact sums per dimension and task.
_SUMS = "length int, i int, n long, total decimal(38,0)"


def _pack(row: np.ndarray) -> bytes:
    for code in (b"2", b"4"):
        kind = np.iinfo(f"<i{code.decode()}")
        if row.min() >= kind.min and row.max() <= kind.max:
            return code + row.astype(f"<i{code.decode()}").tobytes()
    return b"8" + row.astype("<i8").tobytes()


def unpack(column: pa.Array) -> np.ndarray:
    """A matrix of the packed vectors, a row each; they have one length."""
    rows = column.to_pylist()
    return np.stack([np.frombuffer(x, f"<i{x[:1].decode()}", offset=1) for x in rows]).astype(np.int64)


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """The key and the packed whole numbers of every vector that is whole and finite."""
    source = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, packed = [], []
            for row in batch.column(1):
                if row.values is None or not len(row.values):
                    keep.append(False)
                    continue
                entries = row.values.to_numpy(zero_copy_only=False)  # nulls become NaN
                keep.append(bool(np.isfinite(entries).all()))
                if keep[-1]:
                    x = np.floor(scale * entries)
                    if not (np.abs(x) < 2.0**62).all():
                        raise OverflowError("an entry is too large for a whole number of 64 bits")
                    packed.append(_pack(x.astype(np.int64)))
            keys = batch.column(0).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(packed, pa.binary())], [key, "x"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {kind}, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], place: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield unpack(batch.column(place).slice(start, BLOCK))


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[bytes]] = {}
            for x in batch.column(0).to_pylist():
                by_length.setdefault((len(x) - 1) // int(x[:1]), []).append(x)
            for length, rows in by_length.items():
                total = unpack(pa.array(rows, pa.binary())).astype(object).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([length] * length, pa.int32()),
                        pa.array(range(length), pa.int32()),
                        pa.array([len(rows)] * length, pa.int64()),
                        pa.array([Decimal(int(x)) for x in total], pa.decimal128(38, 0)),
                    ],
                    ["length", "i", "n", "total"],
                )

    rows = (
        fit.mapInArrow(run, _SUMS)
        .groupBy("length", "i")
        .agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
        .orderBy("length", "i")
        .collect()
    )
    if len({row["length"] for row in rows}) > 1:
        raise ValueError("the vectors have different lengths")
    return (rows[0]["n"], [int(row["total"]) for row in rows]) if rows else (0, [])


@dataclass(frozen=True)
class Mean:
    """The exact mean ``S / n``: its whole part and the rest ``r / n`` of each dimension."""

    n: int
    whole: tuple[int, ...]
    rest: tuple[int, ...]

    @classmethod
    def of(cls, n: int, total: list[int]) -> Mean:
        return cls(n, tuple(t // n for t in total), tuple(t % n for t in total))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """``u``: whole numbers; the deviation is ``u - r / n``."""
        return x - np.array(self.whole, dtype=np.int64)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """In doubles, rounded once."""
        return self.distances(x) - np.array([r / self.n for r in self.rest])

    def squared(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of ``(n x - S)^2``, by row."""
        u = self.distances(x).astype(object)
        rest = np.array(self.rest, dtype=object)
        own, mixed, fixed = (u * u).sum(axis=1), u @ rest, int((rest * rest).sum())
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + fixed for a, b in zip(own, mixed, strict=True)]


def pair_squares(u: np.ndarray) -> np.ndarray:
    """Summed squares of each dimension (diagonal) and of each sum of two (above it)."""
    d = u.shape[1]
    out = np.zeros((d, d), dtype=object)
    reach = 2 * int(np.abs(u).max(initial=0))
    if reach * reach * len(u) >= 2**62:
        u = u.astype(object)
    for i in range(d):
        pairs = u[:, i:] + u[:, i : i + 1]
        pairs[:, 0] = u[:, i]
        out[i, i:] = (pairs * pairs).sum(axis=0)
    return out


def covariance(fit: DataFrame, mean: Mean) -> np.ndarray:
    """The covariance matrix, each entry rounded once from exact whole numbers."""
    d, n = len(mean.whole), mean.n
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=object)
        for x in _blocks(batches):
            total = total + pair_squares(mean.distances(x))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(upper[0], pa.int32()),
                pa.array(upper[1], pa.int32()),
                pa.array([Decimal(int(v)) for v in total[upper]], pa.decimal128(38, 0)),
            ],
            ["i", "j", "squares"],
        )

    rows = (
        fit.mapInArrow(run, "i int, j int, squares decimal(38,0)")
        .groupBy("i", "j")
        .agg(F.sum("squares").cast("decimal(38,0)").alias("squares"))
        .collect()
    )
    # sum of (n p - q)^2 over all rows, where the p themselves sum to q
    rest = mean.rest
    spread = {}
    for i, j, squares in rows:
        q = rest[i] if i == j else rest[i] + rest[j]
        spread[i, j] = n * n * int(squares) - n * q * q
    out = np.zeros((d, d))
    for i, j in spread:
        twice = 2 * spread[i, i] if i == j else spread[i, j] - spread[i, i] - spread[j, j]
        out[i, j] = out[j, i] = twice / (2 * n**3)
    return out


def identity_error(fit: DataFrame, mean: Mean, map_: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    k = map_.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for x in _blocks(batches):
            w = mean.deviations(x) @ map_
            total += w.T @ w
        cells = [(a, b) for a in range(k) for b in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k * a + b for a, b in cells], pa.int32()), pa.array([total[c] for c in cells])],
            ["cell", "v"],
        )

    found = fit.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    got = np.zeros(k * k)
    for cell, v in found:
        got[cell] = v / mean.n
    return float(np.abs(got.reshape(k, k) - np.eye(k)).max())


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = SCALE
) -> DataFrame:
    """Per row and component: key, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is exact, of 38 digits; components are numbered by falling variance.
    """
    packed = materialise(quantised(vectors, key, vector, scale))
    fit = materialise(packed.select("x").distinct())
    kind = packed.schema[key].dataType.simpleString()
    schema = (
        f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    n, total = sums(fit)
    if not n:
        return packed.sparkSession.createDataFrame([], schema)
    mean = Mean.of(n, total)
    matrix = covariance(fit, mean)
    values, axes = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes, trace = values[order], axes[:, order], float(np.trace(matrix))
    varied = values > len(matrix) * np.finfo(float).eps * max(values[0], 0.0)
    map_ = axes[:, varied] / np.sqrt(values[varied])
    error = identity_error(fit, mean, map_) if varied.any() else None
    explained = [float(v) / trace if trace > 0 else None for v in values]
    numbers = np.flatnonzero(varied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                some = batch.slice(start, BLOCK)
                x = unpack(some.column(1))
                made = np.full((len(x), len(values)), np.nan)
                made[:, numbers] = mean.deviations(x) @ map_
                deviation = pa.array([Decimal(v) for v in mean.squared(x)], pa.decimal128(38, 0))
                for c in range(len(values)):
                    m = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column(0),
                            pa.array([c + 1] * m, pa.int32()),
                            pa.array([n] * m, pa.int64()),
                            deviation,
                            pa.array(made[:, c], mask=np.isnan(made[:, c])),
                            pa.array([explained[c]] * m, pa.float64()),
                            pa.array([error] * m, pa.float64()),
                        ],
                        [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return packed.mapInArrow(run, schema)

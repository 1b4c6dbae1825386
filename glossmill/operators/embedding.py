"""Word vectors and their projection, without a model on the driver.

Skip-gram with negative samples factorises the words' shifted log ratios: for words that
occur ``n`` times within a window, ``log(n N / (n_i n_j)) - log(negative)``, where that is
positive. The vectors here are that matrix' leading singular vectors, found by randomised
block power iteration:

1. co-occurrences are counted, joined with their words' totals and kept as a sparse table;
   entries of a row block and a chunk of columns are one row of packed arrays, a tile;
2. a random basis of a few hundred columns, a chunk of words per row, is multiplied with the
   table, some times over, and made orthonormal: tiles meet their chunk in a join and go to
   the one task of their row block, which adds up the block's rows. A chunk travels once per
   row block, with four bytes a number until the last product;
3. only square matrices of the basis' width reach the driver.

A basis as wide as the vocabulary spans everything; then no iteration is needed and the
result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators.vocabulary import context_pairs, dense_ids, word_counts, word_numbers
from glossmill.session import checked_broadcast, materialise, small_arrow_batches

# Training parameters of the published word vectors.
DIMENSIONS = 300
MIN_COUNT = 3
MIN_COUNT_STRUCTURES = 1
WINDOW = 7
SEED = 1

NEGATIVE = 5
#: Columns of the basis besides the dimensions asked for.
OVERSAMPLE = 10
ITERATIONS = 4
#: Words whose totals travel to the tasks; with more of them pairs are joined by shuffle.
MAX_TOTALS = 1_000_000
#: Bytes of a row block's sums, which a task holds, and of a chunk's vectors, which are one row.
BLOCK_BYTES, CHUNK_BYTES = 256 << 20, 4 << 20
#: Rows of an Arrow batch or a file that holds vectors of chunks.
_CHUNK_ROWS = 16
#: Entries that are packed at once, and products that are summed at once.
_PACKED, _ENTRIES = 1 << 21, 1024
_FILE_ROWS = "spark.sql.files.maxRecordsPerFile"
_CHUNKS = "chunk int, vectors binary"
_TILES = "block int, chunk int, places binary, columns binary, values binary, short binary"


# --- the matrix ------------------------------------------------------------------------


def numbered_words(
    rows: DataFrame, tokens: Column, min_count: int = MIN_COUNT, max_words: int | None = None
) -> DataFrame:
    """``word, n, id`` of frequent words, the most frequent first; stored."""
    counts = word_counts(rows, tokens, min_count)
    words = materialise(
        dense_ids(counts, F.col("n").desc(), F.col("word"), kind="long").select("word", "n", "id")
    )
    return words if max_words is None else words.filter(F.col("id") < max_words)


def log_ratios(
    rows: DataFrame, tokens: Column, words: DataFrame, window: int = WINDOW, negative: float = NEGATIVE
) -> DataFrame:
    """``i, j, value``: the positive shifted log ratios of the words' co-occurrences; stored."""
    numbers = word_numbers(rows, tokens, words.select(F.col("word").alias("token"), "id"))
    found = context_pairs(numbers, "ids", window).filter(F.col("center") <= F.col("context"))
    pairs = materialise(found.select(F.col("center").alias("i"), F.col("context").alias("j"), "n"), codec="zstd")
    ends = pairs.select("i", "n").unionAll(pairs.filter(F.col("i") < F.col("j")).select("j", "n"))
    totals = materialise(ends.groupBy("i").agg(F.sum("n").cast("double").alias("total")))
    all_pairs = totals.agg(F.coalesce(F.sum("total"), F.lit(0.0))).first()[0]
    others = totals.select(F.col("i").alias("j"), F.col("total").alias("other"))
    expected = F.col("total") * F.col("other") / F.lit(all_pairs)
    value = F.log(F.col("n") / expected) - F.log(F.lit(float(negative)))
    upper = materialise(
        pairs.join(checked_broadcast(totals, MAX_TOTALS), "i")
        .join(checked_broadcast(others, MAX_TOTALS), "j")
        .select("i", "j", value.alias("value"))
        .filter(F.col("value") > 0),
        codec="zstd",
    )

    def directed(i: str, j: str) -> Column:
        return F.struct(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), "value")

    both = F.when(F.col("i") == F.col("j"), F.array(directed("i", "j"))).otherwise(
        F.array(directed("i", "j"), directed("j", "i"))
    )
    return upper.select(F.explode(both).alias("e")).select("e.*")


@contextmanager
def _wide_rows(spark: SparkSession) -> Iterator[None]:
    """Few rows of megabytes in an Arrow batch, and in a file, which tasks read whole."""
    before = spark.conf.get(_FILE_ROWS)
    spark.conf.set(_FILE_ROWS, str(_CHUNK_ROWS))
    try:
        with small_arrow_batches(spark, _CHUNK_ROWS):
            yield
    finally:
        spark.conf.set(_FILE_ROWS, before)


def _bytes(values: list[np.ndarray], kind: str) -> pa.Array:
    return pa.array([v.astype(kind).tobytes() for v in values], pa.binary())


def _arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def tiles(entries: DataFrame, blocks: int, chunks: int) -> DataFrame:
    """``block, chunk`` and their entries, packed in the order of rows; stored.

    ``places`` are rows within the block, ``columns`` within the chunk, ``short`` the values
    in four bytes. Ids are dealt to blocks and chunks in turn, so that frequent words spread
    evenly. A task packs its own entries by tile; only such pieces are shuffled. The matrix is
    symmetric, so its upper half is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            i, j, value = (np.concatenate([h[c] for h in held]) for c in range(3))
            other = i < j
            i, j, value = (np.concatenate((x, y[other])) for x, y in ((i, j), (j, i), (value, value)))
            tile = i % blocks * chunks + j % chunks
            if blocks * chunks <= 1 << 16:
                tile = tile.astype(np.uint16)  # sorted by radix
            order = np.argsort(tile, kind="stable")
            tile = tile[order].astype(np.int64)
            firsts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
            found = tile[firsts]
            parts = [np.split(x[order], firsts[1:]) for x in (i // blocks, j // chunks, value)]
            where = [pa.array(x.astype(np.int32)) for x in (found // chunks, found % chunks)]
            return pa.RecordBatch.from_arrays(
                [*where, _bytes(parts[0], "<u4"), _bytes(parts[1], "<u2"), _bytes(parts[2], "<f8")],
                ["block", "chunk", "places", "columns", "values"],
            )

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in range(3)])
            n += batch.num_rows
            if n >= _PACKED:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pieces = batch.column(2).slice(row, 1).flatten()
                places, columns, values = (
                    np.concatenate(_arrays(pieces.field(c), kind)) for c, kind in enumerate(("<u4", "<u2", "<f8"))
                )
                order = np.lexsort((columns, places))
                arrays = [(places, "<u4"), (columns, "<u2"), (values, "<f8"), (values, "<f4")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, 1) for c in range(2)), *(_bytes([x[order]], k) for x, k in arrays)],
                    ["block", "chunk", "places", "columns", "values", "short"],
                )

    upper = entries.filter(F.col("i") <= F.col("j")).select("i", "j", "value")
    pieces = upper.mapInArrow(run, _TILES.rpartition(",")[0])
    grouped = pieces.groupBy("block", "chunk").agg(F.collect_list(F.struct("places", "columns", "values")).alias("pieces"))
    with _wide_rows(entries.sparkSession):
        return materialise(grouped.mapInArrow(merged, _TILES))


# --- bases: tables of (chunk, vectors) -----------------------------------------------------


def first_basis(spark: SparkSession, width: int, n: int, chunks: int, seed: int, kind: str) -> DataFrame:
    """Random rows, from the word's number alone; unit rows if the basis is wide enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                ids = np.arange(chunk, n, chunks)
                if width >= n:
                    made = np.zeros((len(ids), width))
                    made[np.arange(len(ids)), ids] = 1.0
                else:
                    made = np.array([np.random.default_rng((seed, i)).standard_normal(width) for i in ids.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), _bytes([made], kind)], ["chunk", "vectors"])

    return spark.range(min(chunks, n)).mapInArrow(run, _CHUNKS)


def transformed(basis: DataFrame, map_: np.ndarray, kind: str = "<f8") -> DataFrame:
    """Every vector times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [v.reshape(-1, len(map_)) @ map_ for v in _arrays(batch.column(1), "<f8")]
            yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(made, kind)], ["chunk", "vectors"])

    return basis.mapInArrow(run, _CHUNKS)


def gram(basis: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of all columns with each other, and the columns' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            for v in _arrays(batch.column(1), "<f8"):
                some = v.reshape(-1, width)
                total[:width] += some.T @ some
                total[width] += some.sum(axis=0)
        cells = np.arange(total.size, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.reshape(-1))], ["cell", "v"])

    rows = basis.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros((width + 1) * width)
    with small_arrow_batches(basis.sparkSession, _CHUNK_ROWS):
        for cell, v in rows.collect():
            out[cell] = v
    out = out.reshape(width + 1, width)
    return (out[:width] + out[:width].T) / 2, out[width]


def orthonormal(basis: DataFrame, width: int, rounds: int) -> np.ndarray:
    """The matrix that gives the basis orthonormal columns; dependent columns go.

    A second round mends the rounding of the first.
    """
    map_ = np.eye(width)
    for k in range(rounds):
        values, axes = np.linalg.eigh(gram(transformed(basis, map_) if k else basis, map_.shape[1])[0])
        kept = values > 1e-13 * max(values[-1], 0.0)
        map_ = map_ @ (axes[:, kept] / np.sqrt(values[kept]))
    return map_


def _added(total: np.ndarray, places: np.ndarray, columns: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
    """Add ``values`` times rows of ``vectors`` to rows of ``total``.

    Rows with equally many entries are multiplied together, so each row is written once.
    """
    order = np.argsort(places, kind="stable")
    places, columns, values = places[order], columns[order], values[order]
    firsts = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    sizes = np.diff(np.append(firsts, len(places)))
    by_size = np.argsort(sizes, kind="stable")
    found, cuts = np.unique(sizes[by_size], return_index=True)
    for size, a, b in zip(found.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True):
        step = max(_ENTRIES // size, 1)
        for start in range(a, b, step):
            first = firsts[by_size[start : min(start + step, b)]]
            at = first[:, None] + np.arange(size)
            met = vectors.take(columns[at], axis=0)
            total[places[first]] += np.matmul(values[at][:, None, :], met)[:, 0]


def multiplied(
    tiles: DataFrame, basis: DataFrame, width: int, n: int, blocks: int, chunks: int, kind: str = "<f8"
) -> DataFrame:
    """The matrix times the basis of numbers of ``kind``: a join by chunk, sums by row block; stored.

    A row block is a partition of its own and its task holds the block's sums alone, so memory
    does not depend on the number of entries. Vectors and products come in 8 bytes.
    """
    values = F.col("values" if kind == "<f8" else "short").alias("values")
    # wide rows that a plan's estimate takes for a few bytes must not be broadcast
    met = tiles.select("block", "chunk", "places", "columns", values).join(basis.hint("merge"), "chunk")
    placed = met.select("block", "places", "columns", "values", "vectors").repartitionById(blocks, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if total is None:
                block = batch.column(0)[0].as_py()
                total = np.zeros((-(-(n - block) // blocks), width))
            vectors = [v.reshape(-1, width) for v in _arrays(batch.column(4), kind)]
            before = np.cumsum([0, *map(len, vectors[:-1])])
            places, columns, values = (_arrays(batch.column(c), k) for c, k in ((1, "<u4"), (2, "<u2"), (3, kind)))
            columns = [c + first for c, first in zip(columns, before, strict=True)]
            _added(total, *map(np.concatenate, (places, columns, values, vectors)))
        if total is not None:
            # chunks are dealt out like blocks, and are a multiple of them: a block has whole chunks
            for chunk in range(block, min(chunks, n), blocks):
                own = total[(chunk - block) // blocks :: chunks // blocks]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), _bytes([own], "<f8")], ["chunk", "vectors"])

    with _wide_rows(tiles.sparkSession):
        return materialise(placed.mapInArrow(run, _CHUNKS))


def unfolded(basis: DataFrame, map_: np.ndarray, chunks: int) -> DataFrame:
    """``id, vector``: a row per word, its vector times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, v in zip(batch.column(0).to_pylist(), _arrays(batch.column(1), "<f8"), strict=True):
                made = v.reshape(-1, len(map_)) @ map_
                bounds = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                lists = pa.ListArray.from_arrays(bounds, pa.array(made.reshape(-1)))
                ids = pa.array(chunk + np.arange(len(made), dtype=np.int64) * chunks)
                yield pa.RecordBatch.from_arrays([ids, lists], ["id", "vector"])

    return basis.mapInArrow(run, "id long, vector array<double>")


# --- vectors ---------------------------------------------------------------------------------


def factorised(
    entries: DataFrame,
    words: DataFrame,
    dimensions: int = DIMENSIONS,
    power: float = 0.5,
    seed: int = SEED,
    iterations: int = ITERATIONS,
    block: int | None = None,
) -> DataFrame:
    """``word, vector``: singular vectors of the symmetric ``entries`` times ``singular ** power``.

    With ``power`` 1 the products of vectors are those of the matrix' rows. Dimensions
    beyond the rank are zero; a word without entries has the zero vector. Components are
    signed so that their sum over all words is not negative. ``block`` is the number of words
    of a row block, ``BLOCK_BYTES`` of sums unless it is given.
    """
    n = words.count()
    width = min(dimensions + OVERSAMPLE, n)
    zero = F.array_repeat(F.lit(0.0), dimensions)
    if not n:
        return words.select("word", zero.alias("vector"))
    blocks = -(-n // (block or max(BLOCK_BYTES // (8 * width), 1)))
    chunks = blocks * -(-n // (blocks * min(max(CHUNK_BYTES // (8 * width), 1), 1 << 16)))
    packed = tiles(entries, blocks, chunks)
    steps = iterations if width < n else 0
    kinds = ["<f4"] * steps + ["<f8"]  # rounding on the way only turns the basis a little
    basis = first_basis(words.sparkSession, width, n, chunks, seed, kinds[0])
    image = multiplied(packed, basis, width, n, blocks, chunks, kinds[0])
    for kind in kinds[1:]:
        map_ = orthonormal(image, width, 2 if kind == "<f8" else 1)  # before, only its span counts
        width = map_.shape[1]
        if not width:
            return words.select("word", zero.alias("vector"))
        image = multiplied(packed, transformed(image, map_, kind), width, n, blocks, chunks, kind)
    products, sums = gram(image, width)
    values, axes = np.linalg.eigh(products)
    order = np.argsort(-values, kind="stable")[:dimensions]
    singular, axes = np.sqrt(np.maximum(values[order], 0)), axes[:, order]
    axes = axes * np.where(sums @ axes < 0, -1.0, 1.0)
    real = singular > 1e-7 * max(singular[0], 1e-300)
    scale = np.where(real, np.where(real, singular, 1.0) ** (power - 1), 0.0)
    map_ = np.zeros((width, dimensions))
    map_[:, : len(order)] = axes * scale
    found = unfolded(image, map_, chunks)
    return words.join(found.hint("merge"), "id", "left").select("word", F.coalesce("vector", zero).alias("vector"))


def train_word_vectors(
    rows: DataFrame,
    tokens: Column,
    dimensions: int = DIMENSIONS,
    min_count: int = MIN_COUNT,
    window: int = WINDOW,
    seed: int = SEED,
    max_words: int | None = None,
    power: float = 0.5,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """``word, vector`` of all words seen ``min_count`` times, stored.

    ``max_words`` keeps the most frequent ones only, if a caller wants that.
    """
    words = numbered_words(rows, tokens, min_count, max_words)
    entries = log_ratios(rows, tokens, words, window)
    return materialise(factorised(entries, words, dimensions, power, seed, iterations))


def similarity(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``center, context, product, cosine`` of given pairs of words."""

    def product(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    sized = vectors.withColumn("size", F.sqrt(product("vector", "vector")))
    one = sized.select(F.col("word").alias("center"), F.col("vector").alias("_a"), F.col("size").alias("_m"))
    two = sized.select(F.col("word").alias("context"), F.col("vector").alias("_b"), F.col("size").alias("_n"))
    both = pairs.select("center", "context").join(one, "center").join(two, "context")
    return both.select("center", "context", product("_a", "_b").alias("product"), "_m", "_n").select(
        "center", "context", "product", F.try_divide("product", F.col("_m") * F.col("_n")).alias("cosine")
    )


def nearest(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word, neighbour, cosine``: of the words a word occurs with, the most similar one."""
    found = similarity(vectors, pairs.filter(F.col("center") != F.col("context")))
    cosine = F.round("cosine", 6)
    return (
        found.filter(F.col("cosine").isNotNull())
        .groupBy(F.col("center").alias("word"))
        .agg(F.min(F.struct((-cosine).alias("c"), "context")).alias("best"))
        .select("word", F.col("best.context").alias("neighbour"), (-F.col("best.c")).alias("cosine"))
    )


def project(vectors: DataFrame) -> DataFrame:
    """``word, x, y``: the two principal components of stored word vectors."""
    features = vectors.select("word", array_to_vector("vector").alias("features"))
    xy = PCA(k=2, inputCol="features", outputCol="xy").fit(features).transform(features)
    return xy.select("word", vector_to_array("xy").alias("xy")).select(
        "word", F.get("xy", 0).alias("x"), F.get("xy", 1).alias("y")
    )

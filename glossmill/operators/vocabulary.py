"""Word vocabularies: frequencies, dense ids, encoding, co-occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.session import materialise

UNK = "UNK"
#: Largest lookup table that travels to every task, and what an entry takes besides its bytes.
MAX_LOOKUP_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Tokens that are looked up together where the lookup table is joined.
CHUNK = 1 << 18
#: Tokens whose pairs a task counts together.
PAIR_TOKENS = 1 << 20


def word_counts(rows: DataFrame, tokens: Column | str, min_count: int = 1) -> DataFrame:
    """``word, n`` of words seen at least ``min_count`` times.

    Counts are combined per task before the shuffle, so frequent words arrive as
    one row per task. The outer form of explode is deliberate: for the inner form
    the optimiser adds a filter on the array's size, which would tokenise every
    text a second time.
    """
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    counts = (
        rows.select(F.explode_outer(col).alias("word"))
        .filter(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts if min_count <= 1 else counts.filter(F.col("n") >= min_count)


def dense_ids(
    rows: DataFrame, *order: Column | str, first: int = 0, out: str = "id", kind: str = "int"
) -> DataFrame:
    """Consecutive ids in a global order without a single-task window.

    The range-sorted rows are written once; a row's id is the number of rows in
    earlier partitions plus its position. Only one count per partition is ranked
    and broadcast.
    """
    placed = materialise(
        rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_offset") + position + first).cast(kind).alias(out)
    )


def vocabulary(counts: DataFrame) -> DataFrame:
    """``token, id, n`` by falling frequency; id 1 is the unknown word."""
    known = dense_ids(
        counts.filter(F.col("word") != UNK), F.col("n").desc(), F.col("word"), first=2
    ).select(F.col("word").alias("token"), "id", "n")
    unknown = counts.sparkSession.range(1).select(
        F.lit(UNK).alias("token"), F.lit(1).alias("id"), F.lit(None).cast("long").alias("n")
    )
    return unknown.unionByName(known)


def lookup_bytes(vocab: DataFrame) -> int:
    """What a lookup table takes in memory, by its tokens' bytes and their number."""
    row = vocab.agg(F.sum(F.octet_length("token")), F.count(F.lit(1))).first()
    return (row[0] or 0) + ENTRY_BYTES * row[1]


def word_ids(tokens: Column, vocab: DataFrame, unknown: int | None = 1) -> Column:
    """Ids of an array of words, ``unknown`` for other words; ``vocab`` is of checked bytes.

    A batch makes a dictionary of its words, looks each of them up once and gathers the
    ids as arrays. Nothing is unfolded, shuffled or regrouped.
    """
    known = dict(vocab.select("token", "id").toPandas().itertuples(index=False))
    shared = vocab.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = shared.value.get
        for batch in batches:
            words = batch.flatten().dictionary_encode()
            found = [get(w, unknown) for w in words.dictionary.to_pylist()]
            ids = pa.array(found, pa.int32()).take(words.indices)
            yield _rebuilt(batch, ids if unknown is None else ids.fill_null(unknown))

    return ids_of(F.coalesce(tokens, F.array().cast("array<string>")))


def id_words(ids: Column, vocab: DataFrame) -> Column:
    """The words of an array of ids: the inverse of ``word_ids``."""
    known = {i: t for t, i in vocab.select("token", "id").toPandas().itertuples(index=False)}
    shared = vocab.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def words_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = shared.value.get
        for batch in batches:
            numbers = batch.flatten().dictionary_encode()
            found = [get(i, UNK) for i in numbers.dictionary.to_pylist()]
            yield _rebuilt(batch, pa.array(found, pa.string()).take(numbers.indices).fill_null(UNK))

    return words_of(F.coalesce(ids, F.array().cast("array<int>")))


def _rebuilt(batch: pa.Array, values: pa.Array) -> pa.Array:
    """Other values in the lists of a batch that has no null list."""
    bounds = np.asarray(batch.offsets)
    return pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), values)


def _in_order(found: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """Arrays of ``value`` per key, ordered by ``_pos``; keys without tokens stay."""
    item = F.when(F.col("_pos").isNotNull(), F.struct("_pos", value.alias("_v")))
    return (
        found.select(key, item.alias("_t"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
        .select(key, F.col("_ts._v").alias(out))
    )


def _chunks(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``chunk, keys, sizes, codes, words``: rows of about ``CHUNK`` tokens as one row; stored.

    ``words`` holds each word of a chunk once, ``codes`` its place for every token (32 bits,
    -1 for a null, compressed), ``sizes`` the tokens of every row.
    """
    given = rows.select(F.col(key).alias("key"), F.coalesce(tokens, F.array().cast("array<string>")).alias("_t"))
    kind = given.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("keys", T.ArrayType(kind)),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("codes", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            keys, lists = (pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
            words = lists.flatten().dictionary_encode()
            codes = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("<i4")

            def one(values: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    one(keys),
                    one(pa.array(np.diff(np.asarray(lists.offsets)), pa.int32())),
                    pa.array([pa.Codec("zstd").compress(codes.tobytes(), asbytes=True)], pa.binary()),
                    one(words.dictionary.cast(pa.string())),
                ],
                schema.names,
            )

        for batch in batches:
            ends = np.asarray(batch.column(1).offsets)
            at = 0
            while at < batch.num_rows:
                # up to the row that fills the chunk, which may be a long one
                stop = int(np.searchsorted(ends, ends[at] + CHUNK - n))
                stop = min(max(stop, at + 1), batch.num_rows)
                held.append(batch.slice(at, stop - at))
                n += int(ends[stop] - ends[at])
                at = stop
                if n >= CHUNK or sum(b.num_rows for b in held) >= CHUNK:
                    yield packed()
                    number, held, n = number + 1, [], 0
        if held:
            yield packed()

    return materialise(given.mapInArrow(run, schema), codec="zstd")


def encode_words(
    rows: DataFrame,
    key: str,
    tokens: Column | str,
    vocab: DataFrame,
    max_bytes: int = MAX_LOOKUP_BYTES,
    unknown: int | None = 1,
) -> DataFrame:
    """``key, ids``: ids of each row's tokens in order, ``unknown`` for words without one.

    ``vocab`` is a stored table. Up to ``max_bytes`` it travels to the tasks that read the
    texts. With a larger one the rows are packed into chunks, the distinct words of a chunk
    meet the vocabulary in a join, and their ids return to the chunk: the shuffles carry a
    word once per chunk and four bytes per token, not a row per token.
    """
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    if lookup_bytes(vocab) <= max_bytes:
        return rows.select(key, word_ids(col, vocab, unknown).alias("ids"))
    chunks = _chunks(rows, key, col)
    words = chunks.select("chunk", F.posexplode_outer("words").alias("_place", "_token"))
    lookup = vocab.select(F.col("token").alias("_token"), F.col("id").cast("long").alias("_id"))
    found = (
        words.join(lookup, "_token")
        .groupBy("chunk")
        .agg(F.collect_list(F.shiftleft(F.col("_place").cast("long"), 32) + F.col("_id")).alias("found"))
    )
    kind = rows.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, sizes, codes, pairs = (batch.column(c).slice(i, 1) for c in range(4))
                tokens = sizes.flatten().to_numpy().astype(np.int64)
                where = np.frombuffer(pa.Codec("zstd").decompress(codes[0].as_buffer(), 4 * int(tokens.sum())), "<i4")
                pair = pairs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                table = np.zeros(int(where.max(initial=-1)) + 2, np.int32)  # the last one is for nulls
                known = np.zeros(len(table), bool)
                place = pair >> 32
                table[place], known[place] = pair & 0xFFFFFFFF, True
                ids = pa.array(table[where], mask=~known[where])
                bounds = np.concatenate(([0], np.cumsum(tokens)))
                lists = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), ids if unknown is None else ids.fill_null(unknown)
                )
                yield pa.RecordBatch.from_arrays([keys.flatten(), lists], [key, "ids"])

    met = chunks.select("chunk", "keys", "sizes", "codes").join(found, "chunk", "left")
    return met.select("keys", "sizes", "codes", "found").mapInArrow(run, out)


def decode_words(
    rows: DataFrame, key: str, ids: str, vocab: DataFrame, max_bytes: int = MAX_LOOKUP_BYTES
) -> DataFrame:
    """``key, tokens``: the inverse lookup of ``encode_words``."""
    if lookup_bytes(vocab) <= max_bytes:
        return rows.select(key, id_words(F.col(ids), vocab).alias("tokens"))
    numbers = rows.select(key, F.posexplode_outer(ids).alias("_pos", "_id"))
    lookup = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    return _in_order(numbers.join(lookup, "_id", "left"), key, F.coalesce("_token", F.lit(UNK)), "tokens")


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, without the upper planes that are all zero."""
    width = max((int(values.max()).bit_length() + 7) // 8, 1)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, size: int) -> np.ndarray:
    """The inverse of ``_planes``."""
    found = np.zeros((size, 8), np.uint8)
    found[:, : len(planes) // size] = np.frombuffer(planes, np.uint8).reshape(-1, size).T
    return found.view("<u8").reshape(-1).astype(np.int64)


def _split(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counted pairs of sorted ``keys`` as a row per bucket of their first ids.

    A row holds each first id once, as steps, with its number of pairs, then the steps of the
    second ids and the counts; planes of bytes, compressed, as upper planes are mostly zero.
    Pairs of one first id with distant second ids are in several buckets.
    """
    first, second = keys >> 32, keys & 0xFFFFFFFF
    mixed = (first << 24 ^ second >> 20).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(52)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    found, firsts = np.unique(bucket[order], return_index=True)
    codec, rows = pa.Codec("zstd"), []
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(keys)], strict=True):
        own = order[a:b]
        left, right = first[own], second[own]
        heads = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
        steps = np.diff(right, prepend=0)
        steps[heads] = right[heads] - left[heads]
        runs = np.diff(np.append(heads, b - a))
        parts = [_planes(x) for x in (np.diff(left[heads], prepend=0), runs, steps, n[own])]
        widths = bytes(len(p) // size for p, size in zip(parts, _sizes(len(heads), b - a), strict=True))
        rows.append((b - a, len(heads), widths + codec.compress(b"".join(parts), asbytes=True)))
    sizes, heads, packed = zip(*rows, strict=True)
    columns = [pa.array(found.astype(np.int32)), pa.array(sizes, pa.int32()), pa.array(heads, pa.int32()), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "size", "heads", "packed"])


def _sizes(heads: int, size: int) -> tuple[int, int, int, int]:
    """Numbers in each part of a packed row: first ids, runs, steps, counts."""
    return heads, heads, size, size


def _unpacked(size: int, heads: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``_split`` for a row: keys and counts."""
    sizes, widths = _sizes(heads, size), packed[:4]
    cuts = np.cumsum([0, *(w * k for w, k in zip(widths, sizes, strict=True))]).tolist()
    planes = pa.Codec("zstd").decompress(packed[4:], cuts[-1], asbytes=True)
    parts = [_numbers(planes[a:b], k) for a, b, k in zip(cuts, cuts[1:], sizes, strict=False)]
    left, runs, steps, n = np.cumsum(parts[0]), *parts[1:]
    starts = np.cumsum(runs) - runs
    steps[starts] += left
    right = np.cumsum(steps)
    right -= np.repeat(right[starts] - steps[starts], runs)
    return np.repeat(left << 32, runs) | right, n


def _merged(held: list[tuple]) -> pa.RecordBatch:
    """The pairs of a bucket, each once."""
    keys, n = map(np.concatenate, zip(*(_unpacked(*row) for row in held), strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys, n = keys[firsts], np.add.reduceat(n[order], firsts)
    columns = [pa.array(x) for x in ((keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), n)]
    return pa.RecordBatch.from_arrays(columns, ["_a", "_b", "_n"])


def _pair_counts(rows: DataFrame, ids: Column, window: int) -> DataFrame:
    """``_a, _b, _n``: pairs of ids within ``window`` positions, the smaller one first.

    A task counts the pairs of about ``PAIR_TOKENS`` tokens at once and writes them as a row
    per bucket of the smaller id, ids and counts as packed numbers; a bucket's rows meet in one
    task, which adds the counts. So a pair is one or two bytes per such part of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def near(lists: pa.ListArray) -> None:
            word = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(sizes)), sizes)
            for d in range(1, window + 1):
                a, b = word[:-d], word[d:]
                kept = (row[:-d] == row[d:]) & (a >= 0) & (b >= 0)
                a, b = a[kept], b[kept]
                held.append((np.minimum(a, b) << 32) | np.maximum(a, b))

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return _split(keys, n)

        for batch in batches:
            lists = batch.column(0).drop_null()
            ends, at = np.asarray(lists.offsets), 0
            while at < len(lists):
                stop = int(np.searchsorted(ends, ends[at] + PAIR_TOKENS, "right")) - 1
                stop = min(max(stop, at + 1), len(lists))
                near(lists.slice(at, stop - at))
                at = stop
                if sum(map(len, held)) >= PAIR_TOKENS * window:
                    yield counted()
        if any(map(len, held)):
            yield counted()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and held:
                    yield _merged(held)
                    held = []
                at = bucket
                held.append(packed)
        if held:
            yield _merged(held)

    parts = rows.select(ids.alias("_w")).mapInArrow(run, "bucket int, size int, heads int, packed binary")
    return (
        parts.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(merge, "_a int, _b int, _n long")
    )


def context_pairs(rows: DataFrame, tokens: Column | str, window: int = 7) -> DataFrame:
    """``center, context, n``: how often two words lie within ``window`` positions.

    ``tokens`` holds words, or their numbers; a null is no word, but takes a position. Words
    are numbered first, so that pairs are counted and shuffled as numbers. Pairs are counted
    without regard to their order, which halves the rows to aggregate, and both directions
    are written from the finished counts.
    """
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    element = rows.select(col).schema[0].dataType.elementType
    if isinstance(element, T.StringType):
        tokened = rows.select(col.alias("_w"))
        vocab = materialise(
            dense_ids(word_counts(tokened, "_w"), F.col("n").desc(), F.col("word")).select(
                F.col("word").alias("token"), "id"
            )
        )
        numbers = context_pairs(word_numbers(tokened, F.col("_w"), vocab), "ids", window)
        center = vocab.select(F.col("id").alias("_c"), F.col("token").alias("center"))
        context = vocab.select(F.col("id").alias("_d"), F.col("token").alias("context"))
        named = numbers.select(F.col("center").alias("_c"), F.col("context").alias("_d"), "n")
        return named.join(center, "_c").join(context, "_d").select("center", "context", "n")
    unordered = _pair_counts(rows, col, window)

    def directed(center: str, context: str, n: Column) -> Column:
        return F.struct(F.col(center).alias("center"), F.col(context).alias("context"), n.alias("n"))

    both = F.when(
        F.col("_a") == F.col("_b"), F.array(directed("_a", "_b", F.col("_n") * 2))
    ).otherwise(F.array(directed("_a", "_b", F.col("_n")), directed("_b", "_a", F.col("_n"))))
    return unordered.select(F.explode(both).alias("p")).select("p.*")


def word_numbers(rows: DataFrame, tokens: Column, vocab: DataFrame) -> DataFrame:
    """``ids``: the numbers of each row's words, null for words outside ``vocab``."""
    return encode_words(rows.select(F.lit(0).alias("_row"), tokens.alias("_w")), "_row", "_w", vocab, unknown=None).select("ids")


def longest(rows: DataFrame, tokens: Column, cap: int) -> DataFrame:
    """One row: the longest sequence, at most ``cap``."""
    return rows.agg(F.least(F.max(F.size(tokens)), F.lit(cap)).alias("max_length"))

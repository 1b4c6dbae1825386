"""Subword vocabularies: build from a corpus, encode and decode."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.sequences import pad, shifted_targets, with_bounds
from glossmill.operators.vocabulary import dense_ids, word_counts
from glossmill.session import checked_broadcast, materialise

TARGET_SIZE = 1000
#: Longest piece of the first counting pass; each pass doubles it.
FIRST_PASS = 4
#: Pieces that may reach every task: all code points and as many longer pieces again.
MAX_PIECES = 2 * 0x110000
#: Characters of a word that one row of a pass starts pieces from.
CHUNK = 4096
#: Runs (encoding) or ids (decoding) that a Python task unfolds at once.
UNFOLDED = 200_000
STRETCH = r"(?s)(?=(.{{{},{}}}))"
#: Words and the stretches between them; joined they give the text again.
RUNS = r"([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+)"


def runs(text: Column) -> Column:
    """Runs of word and of other characters."""
    return F.regexp_extract_all(text, F.lit(RUNS), F.lit(1))


def _chunked(words: DataFrame, low: int, high: int) -> DataFrame:
    """``n, starts``: for parts of every word, the stretches of up to ``high`` characters.

    A part has ``CHUNK`` starts and the characters that stretches reach beyond them, so
    a row stays small however long a word is.
    """
    step = max(CHUNK // high, 1) * 64 if high > 64 else CHUNK
    parts = F.sequence(F.lit(0), F.floor((F.length("word") - low) / step).cast("int"))
    length = F.lit(step + high - 1)
    part = F.when(F.length("word") <= step, F.col("word")).otherwise(
        F.substring("word", F.col("_part") * step + 1, length)
    )
    found = F.regexp_extract_all(part, F.lit(STRETCH.format(low, high)), F.lit(1))
    return (
        words.filter(F.length("word") >= low)
        .select("n", "word", F.explode_outer(parts).alias("_part"))  # never empty
        .select("n", F.slice(found, 1, step).alias("starts"))
    )


def piece_counts(
    words: DataFrame, low: int, high: int, inner: DataFrame | None = None, ends: DataFrame | None = None
) -> DataFrame:
    """``piece, n``: occurrences of the substrings of ``low`` to ``high`` characters.

    With ``inner`` and ``ends``, pieces of ``low - 1`` characters, only substrings that
    start with one of the first and end with one of the second are counted. The start
    is tested before the lengths are unfolded.
    """
    found = _chunked(words, low, high).select("n", F.explode_outer("starts").alias("_t"))
    if inner is not None:
        known = checked_broadcast(inner.select(F.col("piece").alias("_known")))
        found = found.join(known, F.left("_t", F.lit(low - 1)) == F.col("_known"), "left_semi")
    found = found.select(
        "n", "_t", F.explode(F.sequence(F.lit(low), F.length("_t"))).alias("_l")
    ).select("n", F.left("_t", F.col("_l")).alias("piece"))
    if ends is not None:
        known = checked_broadcast(ends.select(F.col("piece").alias("_known")))
        found = found.join(known, F.right("piece", F.lit(low - 1)) == F.col("_known"), "left_semi")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def build_subwords(
    rows: DataFrame, text: Column | str, target_size: int = TARGET_SIZE, max_piece: int | None = None
) -> DataFrame:
    """``piece, id, n``: all single characters plus the most frequent longer pieces.

    The number of longer pieces fills the vocabulary up to ``target_size``. Ids
    start at 1, by falling frequency; 0 is left for padding. Pieces may be as long as
    the longest word; ``max_piece`` is a limit for callers who want one.

    The text is read once for word counts. Pieces are then counted over distinct
    words in passes of doubling length. A piece is never more frequent than the
    pieces inside it, and comes after each piece it starts with, so a pass only counts
    extensions of pieces that could still enter the vocabulary, ties included. The
    passes end where no piece of their greatest length is frequent enough. That is
    exact, and the shuffles carry few of the corpus' long substrings.
    """
    col = F.col(text) if isinstance(text, str) else text
    words = materialise(word_counts(rows, runs(col)))
    single = materialise(piece_counts(words, 1, 1))
    room = max(target_size - single.count(), 0)
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    widest = longest if max_piece is None else min(max_piece, longest)
    best: list[tuple[str, int]] = []  # at most ``room`` pieces
    inner = ends = None
    low, high = 2, FIRST_PASS
    while room and low <= widest:
        high = min(high, widest)
        counted = piece_counts(words, low, high, inner, ends)
        if len(best) >= room:
            counted = counted.filter(F.col("n") >= best[-1][1])
        counted = materialise(counted)
        top = counted.orderBy(F.col("n").desc(), "piece").limit(room).collect()
        best = sorted(best + [(r.piece, r.n) for r in top], key=lambda p: (-p[1], p[0]))[:room]
        inner = ends = counted.filter(F.length("piece") == high)
        if len(best) >= room:
            last, least = best[-1]
            ends = ends.filter(F.col("n") >= least)
            inner = ends.filter((F.col("n") > least) | (F.col("piece") < last))
        if not inner.take(1):
            break
        low, high = high + 1, 2 * high
    longer = rows.sparkSession.createDataFrame(best, "piece string, n long")
    return dense_ids(single.unionByName(longer), F.col("n").desc(), F.col("piece"), first=1).select(
        "piece", "id", "n"
    )


def _pieces(vocab: DataFrame, bound: int) -> dict[str, int]:
    """The vocabulary as a dict; refuses more than ``bound`` pieces."""
    found = vocab.select("piece", "id").limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"subword vocabulary exceeds {bound} pieces")
    return {r.piece: r.id for r in found}


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    """A batch of lists in parts of about ``UNFOLDED`` elements, whatever its rows hold."""
    ends, at = np.asarray(batch.offsets), 0
    while at < len(batch):
        stop = int(np.searchsorted(ends, ends[at] + UNFOLDED, "right")) - 1
        stop = min(max(stop, at + 1), len(batch))
        yield batch.slice(at, stop - at)
        at = stop


def encode_subwords(vocab: DataFrame, text: Column, bound: int = MAX_PIECES) -> Column:
    """Ids of the longest matching pieces, from left to right, within each run.

    Characters outside the vocabulary fall back to their bytes, numbered after the
    last piece. The vocabulary is bounded by its target size and the alphabet, so
    it travels with the function; a batch encodes each distinct run once and
    gathers the ids as arrays. Nothing is shuffled.
    """
    ids = _pieces(vocab, bound)
    last = max(ids.values(), default=0)
    lengths: dict[str, list[int]] = {}  # of the pieces by their first character, longest first
    for n, first in sorted({(len(p), p[0]) for p in ids}, reverse=True):
        lengths.setdefault(first, []).append(n)

    def encode_run(run: str) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(run):
            for n in lengths.get(run[at], ()):
                found = ids.get(run[at : at + n])
                if found is not None and n <= len(run) - at:
                    out.append(found)
                    at += n
                    break
            else:
                out.extend(last + 1 + b for b in run[at].encode())
                at += 1
        return out

    def encode_slice(batch: pa.Array) -> pa.Array:
        bounds = np.asarray(batch.offsets)
        flat = batch.flatten().dictionary_encode()
        encoded = [encode_run(run) for run in flat.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        pool = np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum()))
        which = np.asarray(flat.indices)
        size = sizes[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        shift = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], size)
        return pa.ListArray.from_arrays(
            pa.array(ends[bounds - bounds[0]], pa.int32()), pa.array(pool[shift + np.arange(ends[-1])])
        )

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        empty = pa.array([], pa.list_(pa.int32()))
        for batch in batches:
            yield pa.concat_arrays([empty, *map(encode_slice, _slices(batch))])

    return encode(runs(text))


def decode_subwords(vocab: DataFrame, ids: Column, bound: int = MAX_PIECES) -> Column:
    """Text of subword ids: the inverse of ``encode_subwords``."""
    pieces = {i: p.encode() for p, i in _pieces(vocab, bound).items()}
    last = max(pieces, default=0)
    table = [pieces.get(i, b"") for i in range(last + 1)] + [bytes([b]) for b in range(256)]

    def decode_slice(batch: pa.Array, spelled: pa.Array) -> pa.Array:
        flat = batch.flatten().fill_null(0).to_numpy(zero_copy_only=False)
        flat = np.where((flat >= 0) & (flat < len(table)), flat, 0)
        bounds = pa.array(np.asarray(batch.offsets) - batch.offsets[0].as_py(), pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(bounds, spelled.take(pa.array(flat))), b"")
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelled = pa.array(table, pa.binary())
        for batch in batches:
            parts = [decode_slice(part, spelled) for part in _slices(batch)]
            yield pa.concat_arrays([pa.array([], pa.string()), *parts])

    return decode(ids)


def first_free_id(vocab: DataFrame) -> int:
    """The id behind the pieces and the 256 bytes that stand for unknown characters."""
    return (vocab.agg(F.max("id")).first()[0] or 0) + 257


def training_sequences(
    rows: DataFrame, ids: str, vocab_size: int, limit: int, prefix: str = ""
) -> DataFrame:
    """Add the fixed-length ``inputs`` and ``targets`` of a trainer to ``rows``.

    ``vocab_size`` is the first free id (``first_free_id``). Start and end ids follow the vocabulary; inputs are padded with the end id,
    targets run one step ahead.
    """
    start, end = vocab_size, vocab_size + 1
    bounded = with_bounds(F.col(ids), start, end)
    return rows.withColumns(
        {
            f"{prefix}inputs": pad(bounded, limit, end),
            f"{prefix}targets": shifted_targets(bounded, limit, end),
        }
    )

"""Importance resampling towards a target: hashed n-gram features from a library's word split.

1. The ``tokenizers`` library's ``Split`` pre-tokeniser, an untrained pattern, cuts the
   text (A-Z in lower case) into words with their offsets.
2. Windows of one to ``width`` neighbouring offset pairs are the features: the words of a
   window joined by one space. A window's CRC-32 goes on from the one a word shorter, so
   no feature is ever written out. The checksum modulo ``buckets`` is its bucket.
3. Bucket histograms of the corpus and of the target are summed per task, then over all
   tasks; a bucket's gain is the floored log ratio of the smoothed shares, times 1000.
4. A document's weight is the floored mean of its features' gains. The weight plus a
   Gumbel value derived from its key is its score; the highest scores are drawn.

Texts are split once: buckets are written as small unsigned numbers next to the key and
read for the histogram and for the sums. Ranks come from a range-sorted table of narrow
rows and counts per partition. Only the histograms (``buckets`` numbers each) reach the
driver and the tasks, whatever the corpus.

Null and empty texts have no features and weight 0. A row whose key is null has no score
and is never drawn. Repeated rows of one key are drawn each; rows that tie in score and
key are numbered by their features and words. An empty target or corpus has an
all-zero histogram. Long texts are split piece by piece, cut behind whole words. Columns
besides the key and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import map_batches, texts
from glossmill.operators.vocabulary import dense_ids
from glossmill.session import materialise

#: A word: anything but ASCII characters that are neither digits nor small letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Code points the library splits at once; a piece goes on to the end of its last word.
PIECE = 1 << 15
BUCKETS = 10_000
WIDTH = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7


@lru_cache(maxsize=1)
def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def pieces(text: str) -> Iterator[str]:
    """Parts of a text that no word goes across."""
    start = 0
    while len(text) - start > PIECE:
        gap = _GAP.search(text, start + PIECE)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:]


def windows(text: str, width: int = WIDTH) -> tuple[int, list[int]]:
    """The number of words, and the CRC-32 of every run of 1 to ``width`` words."""
    lowered = text.encode().lower().decode()
    crc, split = zlib.crc32, splitter().pre_tokenize_str
    n, sums = 0, []
    open_runs: list[int] = []  # runs up to the last word and the space behind it
    for piece in pieces(lowered):
        octets = piece.encode() if piece.isascii() else None
        for _, (start, end) in split(piece):
            word = octets[start:end] if octets is not None else piece[start:end].encode()
            ending = [crc(word), *[crc(word, run) for run in open_runs]]
            open_runs = [crc(b" ", run) for run in ending[: width - 1]]
            sums += ending
            n += 1
    return n, sums


def featured(docs: DataFrame, key: str | None, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """Stored rows: the key, n_words, and the buckets of all features as packed numbers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    source = texts(docs, key) if key else docs.select(F.coalesce("text", F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, packed = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            n, sums = windows(text, width)
            words.append(n)
            packed.append((np.array(sums, dtype=np.uint32) % buckets).astype(kind).tobytes())
        made = [pa.array(words, pa.int64()), pa.array(packed, pa.binary())]
        names = ["n_words", "buckets"]
        if key:
            made, names = [batch.column(0), *made], [key, *names]
        return pa.RecordBatch.from_arrays(made, names)

    first = f"{key} {source.schema[key].dataType.simpleString()}, " if key else ""
    return materialise(map_batches(source, run, f"{first}n_words long, buckets binary"))


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds; summed per task before the shuffle."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored gain of each bucket, in thousandths."""
    n, s, t = float(len(corpus)), corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(rows: DataFrame, key: str, gain: np.ndarray) -> DataFrame:
    """The key, n_words, n_features and weight of every stored row."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, means = [], []
        for packed in batch.column(2):
            found = np.frombuffer(packed.as_buffer(), kind)
            sizes.append(len(found))
            means.append(int(gain[found].sum()) // len(found) if len(found) else 0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(means, pa.int64())],
            [key, "n_words", "n_features", "weight"],
        )

    kind_of_key = rows.schema[key].dataType.simpleString()
    return map_batches(
        rows.select(key, "n_words", "buckets"),
        run,
        f"{key} {kind_of_key}, n_words long, n_features long, weight long",
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    width: int = WIDTH,
) -> DataFrame:
    """Every document's features, weight, score and rank among those drawn.

    Of the N documents with ``least_words`` words and a key, ``percent`` in a hundred are
    drawn, by falling score; the others' rank is null.
    """
    rows = featured(docs, key, buckets, width)
    gain = gains(
        histogram(rows, buckets), histogram(featured(target, None, buckets, width), buckets)
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = materialise(
        weighted(rows, key, gain).withColumn("score", F.col("weight") + gumbel)
    )
    eligible = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    asked = scored.where(eligible)
    drawn = percent * asked.count() // 100
    order = (F.col("score").desc(), F.col(key), F.col("n_features"), F.col("n_words"))
    ranked = dense_ids(asked, *order, first=1, out="rank", kind="long")
    place = F.when(F.col("rank") <= drawn, F.col("rank"))
    others = scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", place).unionByName(others)

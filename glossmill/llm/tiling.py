"""Benchmark decontamination by greedy string tiling.

Benchmark items go to the tasks in blocks of at most ``BLOCK_WORDS`` words, a pass over
the documents for each block, so nothing that grows with the benchmark is broadcast at
once. In a pass every document's windows of ``SEED`` words are joined to the block's
windows by a rolling hash; windows with a word the block does not know are skipped.
A document and an item that share a seed are tiled: the longest match that touches no
marked word is marked in both, and again, down to ``SEED`` words. Matches come from
running Karp-Rabin: windows of the search length are hashed over the unmarked words of
the item and met by those of the document, then compared word by word and extended.

Tiles may stand anywhere, so passages in another order are found. An item leaks into a
document if tiles cover at least ``COVERAGE`` of the item's words. Items shorter than
``SEED`` words must be there whole. Words are runs of letters and digits, lower-cased.

Null or empty texts and items share nothing. Repeated rows are reported each; an empty
benchmark reports nothing. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import filter_rows, map_batches, texts
from glossmill.session import materialise

#: Words of the shortest tile.
SEED = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: Words of the items that one pass over the documents takes along, about.
BLOCK_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` ids, by a polynomial over all of them at once."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _FACTOR + ids[k : k + n].astype(np.uint64)
    return out


def longest_matches(item: list[int], doc: list[int], used: list[bool], taken: list[bool], size: int):
    """All maximal matches of at least ``size`` unmarked words: (length, item, doc)."""

    def starts(words: list[int], marked: list[bool]):
        """Windows without a marked word with their rolling hashes."""
        modulus, base = (1 << 61) - 1, 1_000_003
        top, value, run = pow(base, size - 1, modulus), 0, 0
        for i, word in enumerate(words):
            if marked[i]:
                value, run = 0, 0
                continue
            if run == size:
                value, run = (value - words[i - size] * top) % modulus, run - 1
            value, run = (value * base + word) % modulus, run + 1
            if run == size:
                yield i - size + 1, value

    places = defaultdict(list)
    for start, value in starts(item, used):
        places[value].append(start)
    found = []
    for j, value in starts(doc, taken):
        for i in places.get(value, ()):
            if item[i : i + size] != doc[j : j + size]:
                continue
            if i and j and item[i - 1] == doc[j - 1] and not (used[i - 1] or taken[j - 1]):
                continue  # inside a match that starts earlier
            n = size
            while (
                i + n < len(item)
                and j + n < len(doc)
                and item[i + n] == doc[j + n]
                and not (used[i + n] or taken[j + n])
            ):
                n += 1
            found.append((n, i, j))
    return found


def tiles(item: list[int], doc: list[int], size: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the item, place in the document), longest first."""
    used, taken, out = [False] * len(item), [False] * len(doc), []
    while found := longest_matches(item, doc, used, taken, size):
        longest = max(n for n, _, _ in found)
        # matches of this length in order; overlapped ones are found anew, shortened
        for n, i, j in sorted((-n, i, j) for n, i, j in found if n == longest):
            if any(used[i : i - n]) or any(taken[j : j - n]):
                continue
            used[i : i - n] = taken[j : j - n] = [True] * -n
            out.append((-n, i, j))
    return out


class Block:
    """Items of one pass: word ids, seeds, and the items of each seed."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items, seeds, owners = [], [], []
        self.short: dict[int, list[int]] = defaultdict(list)
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            number = len(self.items)
            self.items.append((key, ids))
            if len(ids) < SEED:
                self.short[ids[0]].append(number)
                continue
            hashes = window_hashes(np.array(ids, np.int64), SEED)
            seeds.append(hashes)
            owners.append(np.full(len(hashes), number))
        empty = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        pairs = np.concatenate(seeds or empty[0]), np.concatenate(owners or empty[1])
        order = np.argsort(pairs[0], kind="stable")
        self.seeds, self.owners = pairs[0][order], pairs[1][order]

    def leaks(self, text: str) -> list[tuple[int, int, int]]:
        """(item, words of the item, words covered) of the items a text holds."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        known = ids > 0
        if not known.any():
            return []
        near = defaultdict(list)
        if len(ids) >= SEED and len(self.seeds):
            runs = np.convolve(known, np.ones(SEED, int), "valid") == SEED
            at = np.flatnonzero(runs)
            hashes = window_hashes(ids, SEED)[at]
            lo = np.searchsorted(self.seeds, hashes, "left")
            hi = np.searchsorted(self.seeds, hashes, "right")
            for k in np.flatnonzero(hi > lo):
                for number in self.owners[lo[k] : hi[k]]:
                    near[int(number)].append(int(at[k]))
        out = []
        for number, starts in sorted(near.items()):
            key, item = self.items[number]
            # only stretches around seeds can hold tiles; gaps are parted by a foreign word
            part, until = [], -1
            for start in starts:
                if start > until:
                    part.append(0)
                part += ids[max(start, until) : start + SEED].tolist()
                until = start + SEED
            covered = sum(n for n, _, _ in tiles(item, part))
            if covered >= COVERAGE * len(item):
                out.append((key, len(item), covered))
        if self.short:
            out += self._short(ids)
        return out

    def _short(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        out = []
        for first in np.unique(ids).tolist():
            for number in self.short.get(first, ()):
                key, item = self.items[number]
                n = len(item)
                places = np.flatnonzero(ids[: len(ids) - n + 1] == first) if len(ids) >= n else []
                if any(ids[p : p + n].tolist() == item for p in places):
                    out.append((key, n, n))
        return out


def item_blocks(
    benchmark: DataFrame, item_key: str = "item_id", block_words: int = BLOCK_WORDS
) -> Iterator[Block]:
    """The items in blocks of about ``block_words`` words, one at a time on the driver."""
    items = texts(benchmark, item_key).where("text <> ''")
    # the bound is on words, so one long item makes a block of its own
    cost = (F.size(F.split("text", r"\s+")) + 1).cast("long")
    parts = materialise(
        items.select(item_key, "text", cost.alias("cost"))
        .repartition(F.xxhash64("text"))
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.partitionBy("part").orderBy(F.xxhash64("text"), F.col(item_key))
    blocks = materialise(
        parts.withColumn("seen", F.sum("cost").over(before) - F.col("cost")).withColumn(
            "block", F.concat_ws(":", "part", F.floor(F.col("seen") / block_words))
        )
    )
    sums = blocks.groupBy("block").agg(F.sum("cost").alias("cost")).orderBy("block").collect()
    group, held = [], 0
    for k, row in enumerate(sums):
        group.append(row["block"])
        held += row["cost"]
        if k + 1 == len(sums) or held + sums[k + 1]["cost"] > block_words:
            some = blocks.where(F.col("block").isin(group)).select(item_key, "text").collect()
            yield Block([tuple(x) for x in some])
            group, held = [], 0


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    item_key: str = "item_id",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents with the items that leak into them: key, item key, item_words, covered, coverage."""
    spark, source = docs.sparkSession, texts(docs, key)
    kinds = [source.schema[key].dataType, benchmark.schema[item_key].dataType]
    schema = (
        f"{key} {kinds[0].simpleString()}, {item_key} {kinds[1].simpleString()}, "
        "item_words long, covered long, coverage double"
    )

    def found_in(block) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [
                (doc, item, n, covered, covered / n)
                for doc, text in zip(*(x.to_pylist() for x in batch.columns), strict=True)
                for item, n, covered in block.value.leaks(text)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
                [key, item_key, "item_words", "covered", "coverage"],
            )

        return map_batches(source, run, schema)

    out = None
    for block in item_blocks(benchmark, item_key, block_words):
        found = found_in(spark.sparkContext.broadcast(block))
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, item_key: str = "item_id", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows, with all their columns, that no item leaks into."""

    def clean_of(rows: DataFrame, block) -> DataFrame:
        return filter_rows(rows, lambda text: not block.value.leaks(text or ""))

    for block in item_blocks(benchmark, item_key, block_words):
        docs = clean_of(docs, docs.sparkSession.sparkContext.broadcast(block))
    return docs

"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of bytes. Every neighbouring pair that is in the
vocabulary waits in the bucket of its merge rank; a bitmap with one bit per bucket,
and one bit per 64 bits of the level below, finds the next rank by find-first-set.
Entries whose pair has changed meanwhile are skipped. A pre-token of n bytes takes
O(n log n), however long it is.

Null texts count as empty; an empty text has no ids. Repeated rows give repeated
results. Only the key and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossmill.llm.common import map_batches, texts
from glossmill.llm.pretokens import UnitCache, pattern, units


class RankQueue:
    """Positions by rank; the smallest rank first, and its smallest position first.

    ``bits`` has a word of 256 bits for as many ranks, ``top`` a bit a word.
    A bucket of one position is that position, a larger one a heap.
    """

    def __init__(self, ranks: int):
        self.bits = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = position
            word = rank >> 8
            self.bits[word] |= 1 << (rank & 255)
            self.top |= 1 << word
        elif bucket.__class__ is int:
            self.buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """The next entry, or None when the queue is empty."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.bits[word]
        least = bits & -bits
        rank = (word << 8) + least.bit_length() - 1
        bucket = self.buckets[rank]
        if bucket.__class__ is not int:
            position = heappop(bucket)
            if bucket:
                return rank, position
        else:
            position = bucket
        del self.buckets[rank]
        self.bits[word] = bits = bits ^ least
        if not bits:
            self.top = top & (top - 1)
        return rank, position


class Codec:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        # pre-tokens repeat more than units do, and cost more
        self.pretokens = UnitCache(self._pretoken, 1_000_000)
        self.cache = UnitCache(self._unit, 400_000)

    def encode_pretoken(self, piece: bytes) -> list[int]:
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n, push, pop = len(piece), self.queue.push, self.queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                push(rank, i)
        while (entry := pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            after[i] = end = after[gone]
            pair[gone] = None
            if end < n:
                before[end] = i
                pair[i] = rank = rank_of(piece[i : after[end]])
                if rank is not None:
                    push(rank, i)
            else:
                pair[i] = None
            left = before[i]
            if left >= 0:
                pair[left] = rank = rank_of(piece[left:end])
                if rank is not None:
                    push(rank, left)
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(rank_of(piece[i:end]))
            i = end
        return out

    def _pretoken(self, pretoken: str) -> bytes:
        ids = self.encode_pretoken(pretoken.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, pattern().findall(unit)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, units(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a rank file, once per Python worker."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return Codec({base64.b64decode(piece): int(rank) for piece, rank in pairs})


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Ids of every text: key, ids (binary, little-endian unsigned 32-bit integers)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = codec(path).encode
        ids = [encode(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    source = texts(docs, key)
    kind = source.schema[key].dataType.simpleString()
    return map_batches(source, run, f"{key} {kind}, ids binary", tables=codec)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Encode every text, decode its ids, and return the digests of both."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, counts, ids_sha, decoded_sha = codec(path), [], [], []
        for text in batch.column(1).to_pylist():
            ids = own.encode(text)
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
            [key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    source = texts(docs, key)
    kind = source.schema[key].dataType.simpleString()
    return map_batches(
        source,
        run,
        f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
        tables=codec,
    )

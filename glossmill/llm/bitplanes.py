"""Token ids in files: blocks of ids transposed into planes, zstandard, a chunk index.

File format (all numbers little-endian):

    8 bytes   magic
    planes    per block of ``BLOCK`` ids: 4 byte planes or 32 bit planes, each zstandard
    table     zstandard of the documents: key int64, key-is-null uint8, tokens int64
    index     zstandard of int64: for every block its ids, its offset, its planes' lengths
    footer    JSON: kind of planes, lengths, numbers of ids, documents and blocks
    8 bytes   length of the footer

A plane holds one byte (or bit) of every id of its block, so the high planes of
small ids are runs of zeros. Blocks do not end with documents: a reader finds the
block of an id by division and only inflates blocks it needs.

Documents are written in ascending key order over all files (null keys first, hashes
of the texts and texts decide between equal keys). Null texts count as empty and hold the end id alone; an
empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import codecs
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import filesystem, fresh_name, map_batches, shared_uri, texts
from glossmill.llm.pretokens import blank_runs, pattern
from glossmill.llm.token_counts import specials, tokenizer
from glossmill.session import materialise

MAGIC = b"IDPLANES"
#: Ids per block.
BLOCK = 1 << 16
#: Bytes of text that are encoded at once.
SLICE = 4 << 20


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Transpose a block of ids into 4 byte planes or 32 bit planes."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The inverse of ``to_planes``."""
    octets = np.zeros((n, 4), dtype=np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class Writer:
    """Writes one file; holds one block of ids and the document table."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.sink, self.kind, self.block = sink, kind, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.offset, self.index, self.waiting, self.held = 0, [], [], 0
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.offset += len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block:
            values = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(values) - len(values) % self.block
            for start in range(0, whole, self.block):
                self._block(values[start : start + self.block])
            self.waiting, self.held = [values[whole:].tobytes()], len(values) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(x) for x in to_planes(ids, self.kind)]
        self.index.append([len(ids), self.offset, *map(len, planes)])
        for plane in planes:
            self._put(plane)

    def close(self) -> dict:
        if self.held:
            self._block(np.frombuffer(b"".join(self.waiting), "<u4"))
        missing = np.array([x is None for x in self.keys], dtype=np.uint8)
        keys = np.array([x or 0 for x in self.keys], dtype="<i8")
        table = self.zstd.compress(
            keys.tobytes() + missing.tobytes() + np.array(self.counts, dtype="<i8").tobytes()
        )
        index = self.zstd.compress(np.array(self.index, dtype="<i8").tobytes())
        footer = {
            "planes": self.kind,
            "block": self.block,
            "table": len(table),
            "index": len(index),
            "ids": sum(self.counts),
            "documents": len(self.counts),
            "blocks": len(self.index),
        }
        tail = json.dumps(footer).encode()
        for data in (table, index, tail, len(tail).to_bytes(8, "little")):
            self._put(data)
        return footer


class Reader:
    """Reads one file block by block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        length = int.from_bytes(self._at(size - 8, 8), "little")
        self.footer = json.loads(self._at(size - 8 - length, length))
        if self._at(0, 8) != MAGIC:
            raise ValueError("not a file of id planes")
        place = size - 8 - length - self.footer["index"]
        unzip = zstandard.ZstdDecompressor().decompress
        width = 2 + (4 if self.footer["planes"] == "byte" else 32)
        self.index = np.frombuffer(unzip(self._at(place, self.footer["index"])), "<i8").reshape(-1, width)
        n = self.footer["documents"]
        rows = unzip(self._at(place - self.footer["table"], self.footer["table"]))
        self.keys = np.frombuffer(rows, "<i8", n)
        self.missing = np.frombuffer(rows, np.uint8, n, 8 * n)
        self.counts = np.frombuffer(rows, "<i8", n, 9 * n)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def block(self, number: int) -> np.ndarray:
        n, offset, *lengths = self.index[number].tolist()
        data, planes, unzip = self._at(offset, sum(lengths)), [], zstandard.ZstdDecompressor()
        for length in lengths:
            planes.append(unzip.decompress(data[:length]))
            data = data[length:]
        return from_planes(planes, n, self.footer["planes"])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, first id's place in the file, ids; one block is held at a time."""
        held, number, start = np.zeros(0, "<u4"), 0, 0
        for key, missing, count in zip(
            self.keys.tolist(), self.missing.tolist(), self.counts.tolist(), strict=True
        ):
            got = [held[:count]]
            have, held = len(got[0]), held[count:]
            while have < count:
                held, number = self.block(number), number + 1
                got.append(held[: count - have])
                held, have = held[count - have :], have + len(got[-1])
            yield None if missing else key, start, np.concatenate(got)
            start += count


def byte_letters() -> str:
    """The letters that byte-level vocabularies write for the bytes, in their order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return "".join(letters[b] for b in range(256))


#: Latin words with marks behind them: two pre-tokens at most, found without the pattern.
WORD = (
    r"^ ?[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+"
    r"(?P<marks>[!-/:-@\[-`{-~]*)$"
)


def spans(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    ends = np.cumsum(sizes)
    places = np.repeat(starts - ends + sizes, sizes)
    places += np.arange(len(places))
    return pool[places]


def strings(found: pa.Array) -> list[str | None]:
    """The values of an array, faster than one by one."""
    return found.to_numpy(zero_copy_only=False).tolist()


class Numbers(dict):
    """Numbers strings in the order they are asked for; ``new`` ones wait to be learned."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number


class LibraryCodec:
    """Ids by the tokenizers library; a worker has every pre-token encoded once.

    A batch is cut into units and made a dictionary by Arrow. Units of the dictionary
    get numbers; new ones are parted into pre-tokens, new ones of these go through the
    library's model. The ids of all units lie in one array, from which those of the
    texts are gathered by number. The table is bounded: once it is full, units that
    most batches had stay, half of the table at most.
    """

    #: Units, and ids of theirs, that the table holds before a batch.
    KNOWN, IDS = 1_200_000, 16_000_000

    def __init__(self, path: str):
        self.tokenizer, self.marks = tokenizer(path), specials(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        before = config["pre_tokenizer"] or {}
        plain = config["normalizer"] is None and before.get("type") == "ByteLevel"
        self.direct = plain and not before["add_prefix_space"] and before.get("use_regex", True)
        self.letters = byte_letters()[:255] + "\n"  # UTF-8 has no byte 255: it parts pre-tokens
        self.known = Numbers({"": 0})
        self.pool = np.zeros(0, "<u4")
        # by number: place and number of the ids, batches with the unit
        self.starts, self.sizes, self.seen = (np.zeros(1, np.int64) for _ in range(3))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model(self, tokens: list[str]) -> list[list[int]]:
        """The ids of pre-tokens, by the model itself where nothing stands before it."""
        if not self.direct:
            return list(map(self._whole, tokens))
        tokenize = self.tokenizer.model.tokenize
        spelt, _ = codecs.charmap_decode(b"\xff".join(map(str.encode, tokens)), "strict", self.letters)
        return [[x.id for x in tokenize(y)] for y in spelt.split("\n")]

    def _append(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts[places] = len(self.pool) + np.cumsum(sizes) - sizes
        self.sizes[places] = sizes
        self.pool = np.concatenate((self.pool, ids))

    def _learn(self) -> None:
        """Encode the units that are new."""
        known, new = self.known, self.known.new
        if not new:
            return
        base, get = len(self.sizes), known.__getitem__
        marks = pc.extract_regex(pa.array(new, pa.large_string()), WORD).flatten()[0]
        parted: dict[int, list[int]] = {}  # units of several pre-tokens
        for place, end in enumerate(strings(marks)):
            if end:
                parted[place] = [get(new[place][: -len(end)]), get(end)]
            elif end is None and len(tokens := pattern().findall(new[place])) > 1:
                parted[place] = list(map(get, tokens))
        # pre-tokens of parted units have joined the new ones
        several = np.fromiter(parted, np.int64, len(parted))
        single = np.ones(len(new), dtype=bool)
        single[several] = False
        places = np.flatnonzero(single)
        grown = np.zeros(len(new), np.int64)
        self.starts, self.sizes, self.seen = (
            np.concatenate((x, grown)) for x in (self.starts, self.sizes, self.seen)
        )
        ids = self._model([new[k] for k in places.tolist()])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))
        self._append(base + places, flat, sizes)
        if parted:
            bounds = np.cumsum([0, *map(len, parted.values())])
            members = np.fromiter(chain.from_iterable(parted.values()), np.int64, bounds[-1])
            flat = spans(self.pool, self.starts[members], self.sizes[members])
            sizes = np.add.reduceat(self.sizes[members], bounds[:-1])
            self._append(base + several, flat, sizes)
        known.new = []

    def _shrink(self) -> None:
        """Make room in the table once it is full."""
        if len(self.sizes) <= self.KNOWN and len(self.pool) <= self.IDS:
            return
        often = np.argsort(-self.seen, kind="stable")[: self.KNOWN // 2]
        often = often[(self.seen[often] > 1) & (np.cumsum(self.sizes[often]) <= self.IDS // 2)]
        kept, names = np.union1d([0], often), list(self.known)
        self.known = Numbers()  # the table of before goes first
        self.known.update((names[old], k) for k, old in enumerate(kept.tolist()))
        self.pool = spans(self.pool, self.starts[kept], self.sizes[kept])
        self.sizes, self.seen = self.sizes[kept], self.seen[kept] >> 1
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _numbers(self, found: pa.Array) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, strings(found)), np.int64, len(found))

    def _numbered(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units that begin at the blanks, and where texts begin and end."""
        pieces = pc.split_pattern(batch, " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.flatten().dictionary_encode()
        nothing, blank = (pa.scalar(x, batch.type) for x in ("", " "))
        named = pc.binary_join_element_wise(nothing, flat.dictionary, blank)
        numbers = self._numbers(named)[flat.indices.to_numpy()]
        # the first piece of a text has no blank before it
        numbers[bounds[:-1]] = self._numbers(pieces.flatten().take(pa.array(bounds[:-1])))
        return numbers, bounds

    def encode(self, batch: pa.Array) -> list[bytes]:
        """Ids of whole texts, without special tokens but those the texts spell out."""
        self._shrink()
        whole = np.zeros(len(batch), dtype=bool)
        for mark in self.marks:
            whole |= pc.match_substring(batch, mark).to_numpy(zero_copy_only=False)
        runs = blank_runs(batch) & ~whole
        plain = ~(whole | runs)
        out: list[bytes] = [b""] * len(batch)
        for i in np.flatnonzero(whole).tolist():  # the library itself parts such texts
            out[i] = np.array(self._whole(batch[i].as_py()), "<u4").tobytes()
        numbers, bounds = self._numbered(batch.filter(pa.array(plain)))
        cut = [pattern().findall(x) for x in strings(batch.filter(pa.array(runs)))]
        rest = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        self._learn()
        bounds = np.concatenate((bounds, bounds[-1] + np.cumsum([*map(len, cut)], dtype=np.int64)))
        numbers = np.concatenate((numbers, rest))
        self.seen[numbers] += 1  # once a batch, however often it has the unit
        sizes = self.sizes[numbers]
        ids = spans(self.pool, self.starts[numbers], sizes)
        places = np.concatenate(([0], np.cumsum(sizes)))[bounds].tolist()
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(runs))).tolist()
        for i, start, stop in zip(order, places, places[1:], strict=False):
            out[i] = ids[start:stop].tobytes()
        return out


@lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


def light_slices(batch: pa.RecordBatch, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices with at most ``limit`` bytes of text in the second column, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def write_ids(
    docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", kind: str = "byte", block: int = BLOCK
) -> DataFrame:
    """Write every text's ids and the end id; the manifest: uri, part, n_ids, n_documents.

    Files hold ascending ranges of the key in ascending order of ``part``.
    """
    uri = shared_uri(docs.sparkSession, "ids")
    # rows of one key, or of none, may be many: the hash of the text parts them
    ordered = (
        texts(docs, key)
        .withColumn("_h", F.xxhash64("text"))
        .repartitionByRange(F.col(key), F.col("_h"))
        .sortWithinPartitions(key, "_h", "text")
        .drop("_h")
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        part = TaskContext.get().partitionId()
        files, folder = filesystem(uri)
        files.create_dir(folder, recursive=True)
        name = fresh_name(part, ".ids")
        with files.open_output_stream(f"{folder}/{name}") as sink:
            writer = Writer(sink, kind, block)
            while batch is not None:
                for some in light_slices(batch):
                    encoded = library_codec(path).encode(some.column(1))
                    for k, ids in zip(some.column(0).to_pylist(), encoded, strict=True):
                        writer.add(k, ids + end)
                batch = next(batches, None)
            done = writer.close()
        row = [[f"{uri}/{name}"], [part], [done["ids"]], [done["documents"]]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in row], ["uri", "part", "n_ids", "n_documents"]
        )

    return materialise(
        ordered.mapInArrow(run, "uri string, part long, n_ids long, n_documents long")
    )


def read_ids(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document of the files: key, start, n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select(  # one row a file
        "uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                store, place = filesystem(uri)
                with store.open_input_file(place) as source:
                    keys, starts, counts, crcs = [], [], [], []
                    for k, start, ids in Reader(source).documents():
                        keys.append(k)
                        starts.append(base + start)
                        counts.append(len(ids))
                        crcs.append(zlib.crc32(ids.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (keys, starts, counts, crcs)],
                    [key, "start", "n_tokens", "ids_crc32"],
                )

    # a file per task; a stated number is kept as it is
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")

"""WARC archives: write, normalise into one gzip member per record, index, read.

``write_archives`` lets every task write its rows as one monolithic gzip stream, the
form many crawlers leave behind. ``normalise`` inflates each such stream once, writes
every record as its own gzip member, and next to the archive a sidecar index of offset,
length and record. ``read_records`` opens the members by that index.

Tasks write files of their own into the shared folder and return their names; tables
of names are written by Spark, so only committed attempts count and a lost executor
costs a repeated task at most.

Of records with equal payloads of at least ``MIN_SHARED`` bytes the one with the
smallest key is a response (all of them, if that key has repeated rows or no row has a
key); the others revisit it. Null payloads are empty, a null url is left out. Rows
without a key never become a revisit's target while another has one. An empty table
gives no archive. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import filesystem, fresh_name, shared_uri
from glossmill.session import materialise

#: Payloads shorter than this are never stored as revisits.
MIN_SHARED = 100
#: Bytes inflated or read at a time.
CHUNK = 1 << 20
LEVEL = 4
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n", re.I)


def with_targets(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """key, url, html, payload_digest, refers_to (the response's key for revisits)."""
    rows = pages.select(
        F.col(key), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("payload_digest", F.sha2("html", 256))
    shared = materialise(
        rows.where(F.octet_length("html") >= MIN_SHARED)
        .groupBy("payload_digest")
        .agg(F.min(key).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", "first")
    )
    # written first, so its size decides between a broadcast and a split shuffle join
    return rows.join(shared, "payload_digest", "left").select(
        key,
        "url",
        "html",
        "payload_digest",
        F.when(~F.col("first").eqNullSafe(F.col(key)), F.col("first")).alias("refers_to"),
    )


def record(key, url, payload: bytes, digest: str, target) -> bytes:
    """One WARC/1.1 record with its closing blank lines."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if target is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}",
    ]
    if url is not None:
        clean = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if target is None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head.append(f"WARC-Refers-To: <urn:page:{target}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        block = http + b"\r\n"
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """One monolithic gzip WARC per task; returns its manifest: uri, part."""
    uri = shared_uri(rows.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        part = TaskContext.get().partitionId()
        files, folder = filesystem(uri)
        files.create_dir(folder, recursive=True)
        name = fresh_name(part, ".warc.gz")
        with files.open_output_stream(f"{folder}/{name}", compression=None) as sink:
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            while batch is not None:
                for k, url, html, digest, target in zip(
                    *(x.to_pylist() for x in batch.columns), strict=True
                ):
                    sink.write(packer.compress(record(k, url, html, digest, target)))
                batch = next(batches, None)
            sink.write(packer.flush())
        yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}"]), pa.array([part])], ["uri", "part"])

    payload = rows.select(
        key, "url", F.col("html").cast("binary").alias("html"), "payload_digest", "refers_to"
    )
    return materialise(payload.mapInArrow(run, "uri string, part long"))


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip stream, whether it has one member or many."""
    unpacker = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            yield unpacker.decompress(data)
            data = unpacker.unused_data
            if unpacker.eof:
                unpacker = zlib.decompressobj(31)
    if not unpacker.eof and (rest := unpacker.flush()):
        yield rest


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive; one is held at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        start = 0
        while (end := held.find(b"\r\n\r\n", start)) >= 0:
            length = _LENGTH.search(held, start, end + 2)
            if length is None:
                raise ValueError("record without a length")
            stop = end + 4 + int(length[1]) + 4
            if stop > len(held):
                break
            yield bytes(held[start:stop])
            start = stop
        del held[:start]
    if held.strip():
        raise ValueError("archive ends inside a record")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines if x)}


def normalise(manifest: DataFrame) -> DataFrame:
    """Rewrite archives record by record; returns the manifest: uri, index_uri, records."""
    uri = shared_uri(manifest.sparkSession, "warc-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                files, folder = filesystem(uri)
                files.create_dir(folder, recursive=True)
                name, offset, n = fresh_name(part, ".warc.gz"), 0, 0
                store, place = filesystem(archive)
                with (
                    store.open_input_stream(place, compression=None) as source,
                    files.open_output_stream(f"{folder}/{name}", compression=None) as sink,
                    files.open_output_stream(f"{folder}/{name}.idx") as index,
                ):
                    for whole in split_records(inflate(source)):
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = packer.compress(whole) + packer.flush()
                        found = headers(whole[: whole.index(b"\r\n\r\n")])
                        line = {
                            "offset": offset,
                            "length": len(member),
                            "id": found["warc-record-id"],
                            "type": found["warc-type"],
                        }
                        index.write(json.dumps(line).encode() + b"\n")
                        sink.write(member)
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{uri}/{name}"]), pa.array([f"{uri}/{name}.idx"]), pa.array([n], pa.int64())],
                    ["uri", "index_uri", "records"],
                )

    # an archive per task; a stated number is kept as it is
    spread = manifest.repartition(max(1, manifest.count()))
    return materialise(spread.mapInArrow(run, "uri string, index_uri string, records long"))


def read_records(manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """Read the members named by the sidecar indexes; digests are recomputed.

    key, url, payload_bytes, payload_digest, record_type, refers_to. A response whose
    payload differs from its header's digest or length ends the job.
    """

    def page(value: str | None) -> int | None:
        inner = (value or "")[len("<urn:page:") : -1]
        return int(inner) if inner else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, index_uri in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                out = []
                store, place = filesystem(uri)
                with store.open_input_file(place) as source, store.open_input_stream(
                    filesystem(index_uri)[1]
                ) as index:
                    for line in index.read().splitlines():
                        at = json.loads(line)
                        source.seek(at["offset"])
                        whole = zlib.decompress(source.read(at["length"]), 31)
                        end = whole.index(b"\r\n\r\n")
                        found = headers(whole[:end])
                        digest = found["warc-payload-digest"].removeprefix("sha256:")
                        size = int(found["payload-length"])
                        if found["warc-type"] == "response":
                            payload = whole[whole.index(b"\r\n\r\n", end + 4) + 4 : -4]
                            if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                                raise ValueError(f"damaged record {at['id']} in {uri}")
                        out.append(
                            (
                                page(found["warc-record-id"]),
                                found.get("warc-target-uri"),
                                size,
                                digest,
                                found["warc-type"],
                                page(found.get("warc-refers-to")),
                            )
                        )
                        if len(out) == 5_000:
                            yield batch_of(out)
                            out = []
                if out:
                    yield batch_of(out)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [key, "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names
        )

    schema = f"{key} long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    spread = manifest.select("uri", "index_uri").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, schema)

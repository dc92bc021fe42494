"""WARC archives with dictionary compression (operator 4).

Every page becomes one record: of the pages with equal payloads that with the largest id is the
`response`, the others are `revisit` records that refer to it and hold no payload.  A task collects
records up to `ARCHIVE_BYTES`, trains a Zstandard dictionary on all of them, and writes one archive:
the dictionary in a leading skippable frame (magic 184D2A5D), then one frame for every record.  A
reader needs nothing but the file, and can start at any record.

Archives go to the shared folder under names of their own for every attempt; the manifest, which
Spark commits, names those that count, so a task that is lost and run again leaves nothing double.
Equal payloads are found by digest: partial maxima before the shuffle, so that a page copied a
million times is one row a task; payloads are not shuffled unless the revisits are too many to broadcast.

Defined results: a null html is an empty payload; all rows with the largest id among equal payloads
are responses (repeated rows); a null id is smaller than any; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard as zs
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh_dir, settle

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 48 << 10
BROADCAST_REVISITS = 200_000
SKIPPABLE = 0x184D2A5D
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(text: str) -> int | None:
    found = text.strip("<>").rsplit(":", 1)[1]
    return None if found == "none" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, which names the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; raises ValueError where it is not sound."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] not in ("WARC/1.1", "WARC/1.0"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload of another digest than its record says")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(refers) if refers else None, "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained on the records; too few to train on serve themselves."""
    try:
        return zs.train_dictionary(min(size, max(1024, sum(map(len, records)) // 10)), records, k=256, d=8, accel=4, f=18).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(records)[-size:]


def archive(records: list[bytes]) -> bytes:
    """A whole .warc.zst: the dictionary, itself compressed, in a skippable frame, then a frame a record."""
    found = dictionary(records)
    packed = zs.ZstdCompressor(level=12).compress(found)
    held = zs.ZstdCompressionDict(found)
    held.precompute_compress(level=LEVEL)
    compress = zs.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True).compress
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(compress, records)])


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after another."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    found = zs.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=16 << 20)
    reader = zs.ZstdDecompressor(dict_data=zs.ZstdCompressionDict(found))
    view = memoryview(data)[8 + size :]
    while view:
        frame = reader.decompressobj()
        yield frame.decompress(view)
        left = len(frame.unused_data)
        if left >= len(view):
            raise ValueError("a frame that holds nothing")
        view = view[len(view) - left :]


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def decisions(pages: DataFrame, least: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with refers_to and revisit; payloads of fewer than `least` bytes never become revisits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.xxhash64(F.lit("a"), html).alias("h1"), F.xxhash64(html).alias("h2"))
    groups = keyed.filter(F.octet_length("html") >= least).groupBy("h1", "h2").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = keyed.select("page_id", "h1", "h2").join(groups, ["h1", "h2"]).filter(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))).filter(F.col("refers_to").isNotNull())
    again = settle(again.select(F.col("page_id").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "refers_to").distinct(), "warc-revisits")
    held = F.broadcast(again) if again.count() <= BROADCAST_REVISITS else again
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    return keyed.join(held, same, "left").select("page_id", "url", "html", "refers_to", F.col("g1").isNotNull().alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives below `folder` (a URI all executors share; None: a new one) and return the committed manifest: path, records, bytes."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located(folder)
        files.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data, name = archive(held), f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{base}/{name}.part") as f:
                f.write(data)
            files.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c for c in batch.columns)):
                one = record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "replace"), refers_to.as_py(), revisit.as_py())
                held.append(one)
                size += len(one)
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return settle(decisions(pages, least).mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives that the manifest names, verified; with the payloads if asked for."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = located(path)
                with files.open_input_file(at) as f:
                    data = f.read()
                rows: list[dict] = []
                for one in records_of(data):
                    rows.append(parse(one))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names)

    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path").repartition(n).mapInArrow(run, schema)

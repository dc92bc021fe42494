"""Media columns in Ogg (operator 2).

Writing: a payload becomes the unsigned 8-bit samples of a PCM logical stream, `FRAME` samples a
packet, multiplexed with a second logical stream that carries, for every second of samples, their
number and sum.  Packets are cut into lacing values and pages of up to 255 of them; a packet may
run over pages.  Every page has its checksum, sequence number and granule position.

Reading: pages are found by their capture pattern, their checksums verified, packets put together
from the lacing values page after page and stream by stream, and each packet gets a time from its
stream's granule position.  Nothing is assumed about the writer: any multiplexed Ogg stream reads,
and what is damaged is counted, not raised: a PCM stream without a whole header has no samples, an index packet of another
size disagrees.

Defined results: a null text is the empty text; an empty payload is padded to one frame of spaces;
equal texts give equal bytes, as serial numbers are fixed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ALIGN = 192
FRAME = 960
RATE = 8000
PCM, INDEX = 0x50434D38, 0x494E4458
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = 0xFFFFFFFFFFFFFFFF
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 04C11DB7, most significant bit first, starting at 0, nothing inverted.

    zlib has the same polynomial the other way round, so the bits of every byte and of the result are turned.
    """
    crc = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIII B", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + struct.pack("<I", page_checksum(whole)) + whole[26:]


def lace(size: int) -> bytes:
    """Lacing values of one packet: 255 for each full part, then the rest, which is 0 after an even multiple."""
    return b"\xff" * (size // 255) + bytes([size % 255])


@dataclass
class Writer:
    """Pages of one logical stream."""

    serial: int
    out: list[bytes]
    number: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: list[bytes] = field(default_factory=list)
    granule: int = NO_GRANULE
    continued: int = 0

    def packet(self, data: bytes, granule: int) -> None:
        values, at = lace(len(data)), 0
        while values:
            room = 255 - len(self.lacing)
            if not room:
                self.flush()
                self.continued = CONTINUED if at else 0
                room = 255
            part, values = values[:room], values[room:]
            self.lacing += part
            size = sum(part)
            self.body.append(data[at : at + size])
            at += size
        self.granule = granule

    def flush(self, more: int = 0) -> None:
        if not self.lacing and not more & LAST:
            return
        flags = self.continued | (FIRST if self.number == 0 else 0) | more
        self.out.append(page(self.serial, self.number, flags, self.granule, bytes(self.lacing), b"".join(self.body)))
        self.number += 1
        self.lacing, self.body, self.granule, self.continued = bytearray(), [], NO_GRANULE, 0


def write(payload: bytes) -> bytes:
    """An Ogg file of the payload's samples and of its index stream."""
    out: list[bytes] = []
    pcm, index = Writer(PCM, out), Writer(INDEX, out)
    # OggPCM's header: format 1 is unsigned 8 bits.
    pcm.packet(struct.pack(">8sHHIIBBHI", b"PCM     ", 0, 0, 1, RATE, 8, 1, FRAME, 0), 0)
    pcm.flush()
    index.packet(b"gloomidx" + struct.pack("<I", RATE), 0)
    index.flush()
    samples = np.frombuffer(payload, np.uint8)
    for second in range(0, len(payload), RATE):
        end = min(second + RATE, len(payload))
        for at in range(second, end, FRAME):
            pcm.packet(payload[at : min(at + FRAME, end)], min(at + FRAME, end))
        pcm.flush()
        index.packet(struct.pack("<QQ", end - second, int(samples[second:end].sum(dtype=np.uint64))), end)
        index.flush()
    pcm.flush(LAST)
    index.flush(LAST)
    return b"".join(out)


@dataclass
class Packet:
    serial: int
    data: bytes
    granule: int | None
    page: int


@dataclass
class Reading:
    """What a physical stream holds."""

    packets: dict[int, list[Packet]] = field(default_factory=dict)
    pages: int = 0
    bad_checksums: int = 0
    lost_pages: int = 0
    torn_packets: int = 0
    skipped_bytes: int = 0


def read(data: bytes) -> Reading:
    """Verify, reassemble and demultiplex."""
    got = Reading()
    parts: dict[int, list[bytes]] = {}
    following: dict[int, int] = {}
    at = 0
    while (start := data.find(b"OggS", at)) >= 0:
        got.skipped_bytes += start - at
        head = data[start : start + 27]
        if len(head) < 27 or head[4] != 0:
            at, got.skipped_bytes = start + 4, got.skipped_bytes + 4
            continue
        _, _, flags, granule, serial, number, checksum, count = struct.unpack("<4sBBQIIIB", head)
        lacing = data[start + 27 : start + 27 + count]
        end = start + 27 + count + sum(lacing)
        whole = data[start:end]
        if len(lacing) < count or len(whole) < end - start or page_checksum(whole[:22] + bytes(4) + whole[26:]) != checksum:
            got.bad_checksums += 1
            at, got.skipped_bytes = start + 4, got.skipped_bytes + 4
            continue
        got.pages += 1
        if number != following.get(serial, number):
            got.lost_pages += 1
            if parts.pop(serial, None):
                got.torn_packets += 1
        following[serial] = number + 1
        stream = got.packets.setdefault(serial, [])
        held = parts.pop(serial, [])
        skip = bool(flags & CONTINUED) and not held
        if held and not flags & CONTINUED:
            got.torn_packets += 1
            held = []
        body, done = start + 27 + count, []
        # Runs of lacing values up to one under 255 make a packet.
        first = 0
        for i, value in enumerate(lacing):
            if value < 255:
                size = 255 * (i - first) + value
                held.append(data[body : body + size])
                body += size
                first = i + 1
                if skip:
                    got.torn_packets += 1
                    skip = False
                else:
                    done.append(Packet(serial, b"".join(held), None, got.pages - 1))
                held = []
        if first < len(lacing) and not skip:
            held.append(data[body:end])
            parts[serial] = held
        if done and granule != NO_GRANULE:
            done[-1].granule = granule
        stream += done
        at = end
    got.skipped_bytes += len(data) - at
    got.torn_packets += sum(bool(x) for x in parts.values())
    return got


def samples(got: Reading) -> tuple[bytes, int, list[tuple[float, int]]]:
    """The PCM payload, its rate, and (end time in seconds, samples) of every packet, from the granule positions; nothing without a whole header."""
    stream = got.packets.get(PCM, [])
    header = stream[0].data if stream else b""
    rate = int.from_bytes(header[16:20], "big")
    if not header.startswith(b"PCM     ") or len(header) < 20 or not rate:
        return b"", 0, []
    data = [p for p in stream[1:]]
    # A page's granule position holds for the last packet that ends on it; those before it end earlier by its samples.
    ends, after = [0] * len(data), None
    for i in range(len(data) - 1, -1, -1):
        ends[i] = data[i].granule if data[i].granule is not None else (after - len(data[i + 1].data) if after is not None else 0)
        after = ends[i]
    return b"".join(p.data for p in data), rate, [(e / rate, len(p.data)) for e, p in zip(ends, data)]


def index_agrees(got: Reading, payload: bytes) -> bool:
    """Whether the second stream's numbers and sums are those of the payload."""
    at, values = 0, np.frombuffer(payload, np.uint8)
    for p in got.packets.get(INDEX, [])[1:]:
        if len(p.data) != 16:
            return False
        n, total = struct.unpack("<QQ", p.data)
        if int(values[at : at + n].sum(dtype=np.uint64)) != total or p.granule != at + n:
            return False
        at += n
    return at == len(payload)


def features(media: bytes) -> tuple[bytes, str, bool]:
    """Payload, feature text and whether everything that was read is sound."""
    got = read(media)
    payload, rate, times = samples(got)
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    sound = not (got.bad_checksums or got.lost_pages or got.torn_packets or got.skipped_bytes) and index_agrees(got, payload) and (rate > 0 or PCM not in got.packets)
    total, squares = int(x.sum()), int((x * x).sum())
    steps = int(np.abs(np.diff(x)).sum()) if len(x) > 1 else 0
    crossings = int(np.count_nonzero(np.diff(x >= 128))) if len(x) > 1 else 0
    end_ms = round(times[-1][0] * 1000) if times else 0
    text = f"streams={len(got.packets)};pages={got.pages};packets={len(times)};rate={rate};end_ms={end_ms};sum={total};squares={squares};steps={steps};crossings={crossings};peak={int(x.max()) if len(x) else 0};sound={int(sound)}"
    return payload, text, sound


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and those with spaces up to a positive multiple of ALIGN."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b" " * ((-len(raw)) % ALIGN if raw else ALIGN)


def store(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """`df` with the binary column `out`: each text's payload as an Ogg file, and n_bytes, its length before padding."""
    kept = [c for c in df.columns if c not in (out, "n_bytes")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema) + f", n_bytes bigint, `{out}` binary"
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # a batch of texts may make far larger media
                rows = batch.slice(start, 512)
                made = [padded(t.as_py()) for t in rows.column(at)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())], [*kept, "n_bytes", out])

    return df.select(*kept).mapInArrow(run, schema)


def packets(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row for every packet of every media value: id, serial, packet_no, granule (null inside a page; its 64 bits read as signed, as Ogg's are), data."""
    schema = f"key {df.schema[id_col].dataType.simpleString()}, serial bigint, packet_no bigint, granule bigint, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, media in zip(batch.column(0), batch.column(1)):
                rows = [(key.as_py(), s, i, None if p.granule is None else p.granule - (p.granule >> 63 << 64), p.data) for s, ps in sorted(read(media.as_py() or b"").packets.items()) for i, p in enumerate(ps)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.binary())], ["key", "serial", "packet_no", "granule", "data"])

    return df.select(id_col, media_col).mapInArrow(run, schema).toDF(id_col, "serial", "packet_no", "granule", "data")


def load(df: DataFrame, media_col: str = "media") -> DataFrame:
    """`df` with payload (the samples read back), feature and sound, which replace columns of those names."""
    kept = [c for c in df.columns if c not in ("payload", "feature", "sound")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema) + ", payload binary, feature string, sound boolean"
    at = kept.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(item.as_py() or b"") for item in batch.column(at)]
            more = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*kept, "payload", "feature", "sound"])

    return df.select(*kept).mapInArrow(run, schema)

"""Ogg and WARC: round trips, damage, edge cases."""

import hashlib
import os
import zlib

import pytest

from gridloom.llm import ogg, warc
from gridloom.llm.queries import ORACLE_SQL, QUERIES


def bitwise_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else (crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"OggS", os.urandom(1000)):
        assert ogg.page_checksum(data) == bitwise_crc(data)


@pytest.mark.parametrize("size", [192, 960, 8000 // 192 * 192, 65280, 300 * 192, 192 * 5000])
def test_ogg_round_trip(size):
    payload = os.urandom(size)
    media = ogg.write(payload)
    got = ogg.read(media)
    data, rate, times = ogg.samples(got)
    assert data == payload and rate == ogg.RATE
    assert (got.bad_checksums, got.lost_pages, got.torn_packets, got.skipped_bytes) == (0, 0, 0, 0)
    assert abs(times[-1][0] - size / rate) < 1e-9 and [t for t, _ in times] == sorted(t for t, _ in times)
    assert sum(n for _, n in times) == size and ogg.index_agrees(got, payload)


def test_packets_over_pages():
    out = []
    w = ogg.Writer(7, out)
    parts = [os.urandom(n) for n in (0, 254, 255, 256, 510, 200_000, 1)]
    for i, p in enumerate(parts):
        w.packet(p, i)
    w.flush(ogg.LAST)
    got = ogg.read(b"".join(out))
    assert [p.data for p in got.packets[7]] == parts and got.torn_packets == 0 and got.pages > 2


def test_damage_is_counted():
    media = bytearray(ogg.write(os.urandom(192 * 300)))
    media[len(media) // 2] ^= 1
    got = ogg.read(bytes(media))
    assert got.bad_checksums == 1 and got.lost_pages >= 1
    assert ogg.features(bytes(media))[2] is False
    assert ogg.read(b"noise" + ogg.write(b" " * 192)).skipped_bytes == 5


def test_ogg_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_ogg"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, payload = ogg.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.sound and len(payload) % 192 == 0


def test_ogg_edges(spark):
    df = spark.createDataFrame([(1, None, b"x"), (2, "", b"x"), (None, "é" * 100_000, b"x"), (4, "a" * 192, b"x"), (4, "a" * 192, b"x")], "doc_id bigint, text string, media binary")
    stored = ogg.store(df)
    rows = ogg.load(stored).collect()
    assert [len(r.payload) for r in rows] == [192, 192, 200_064, 192, 192] and all(r.sound for r in rows)
    assert rows[0].media == rows[1].media and rows[3].media == rows[4].media
    assert ogg.packets(stored, "doc_id").filter(f"serial = {ogg.PCM}").count() > 200
    assert ogg.load(ogg.store(df.limit(0))).count() == 0


def test_warc_archive_is_seekable():
    records = [warc.record(i, f"http://x/{i}\r\nX: y", f"<html>{i}</html>".encode() * 50, None, False) for i in range(200)]
    data = warc.archive(records)
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18]) and list(warc.records_of(data)) == records
    assert warc.parse(records[3])["page_id"] == 3 and warc.parse(records[3])["url"] == "http://x/3%0D%0AX:%20y"
    assert list(warc.records_of(warc.archive([b"one"]))) == [b"one"]
    with pytest.raises(ValueError):
        warc.parse(records[0].replace(b"<html>0", b"<html>1", 1))


def test_warc_edges(spark, tmp_path):
    rows = [(1, "u", "same"), (5, "u", "same"), (5, "u", "same"), (3, "v", "same"), (7, None, None), (8, "w", ""), (None, "x", "same"), (9, "y", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/a", archive_bytes=1000)
    got = sorted(((r.page_id is not None, r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(manifest).collect()), key=str)
    assert got == sorted([(True, 1, "revisit", 5, 4), (True, 5, "response", None, 4), (True, 5, "response", None, 4), (True, 3, "revisit", 5, 4), (True, 7, "revisit", 8, 0), (True, 8, "response", None, 0), (False, None, "revisit", 5, 4), (True, 9, "response", None, 200_000)], key=str)
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    least = warc.read(warc.write(pages, least=5)).collect()
    assert {r.record_type for r in least} == {"response"}


def test_warc_query_has_sql():
    assert "op4_warc" in QUERIES and "op4_warc" in ORACLE_SQL

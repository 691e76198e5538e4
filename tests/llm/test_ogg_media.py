from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest

from calltide.llm import ogg_media
from pyspark.sql import functions as F


def plain_checksum(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def test_checksum_against_plain_bits():
    rng = random.Random(1)
    for n in (0, 1, 2, 27, 300):
        data = rng.randbytes(n)
        assert ogg_media.checksum(data) == plain_checksum(data)


@pytest.mark.parametrize("segments", [1, 2, 7, 17, 255])
def test_packets_of_all_sizes_come_back(segments):
    rng = random.Random(segments)
    sizes = [0, 1, 254, 255, 256, 509, 510, 511, 765, 3000, 66_000, 0, 255]
    packets = [rng.randbytes(n) for n in sizes]
    pages = [ogg_media.stream_pages(serial, [b"head", b"x" * 255], packets, list(range(10, 10 + len(packets))), segments) for serial in (5, 0xFFFFFFFF)]
    other = ogg_media.stream_pages(9, [b"alone"], [], [])
    mixed = [p for k in range(len(pages[0])) for s in pages for p in s[k : k + 1]]
    streams, bad = ogg_media.read(b"".join([mixed[0], other[0], *mixed[1:]]))
    assert bad == 0 and [s.serial for s in streams] == [5, 9, 0xFFFFFFFF]
    for s in (streams[0], streams[2]):
        assert [p for p, _ in s.packets] == [b"head", b"x" * 255, *packets] and s.ended and not s.gaps
        assert s.packets[-1][1] == 9 + len(packets)
    assert [p for p, _ in streams[1].packets] == [b"alone"] and streams[1].ended


def test_damage_costs_only_what_it_hits():
    payload = random.Random(3).randbytes(40 * ogg_media.SAMPLES)
    media = ogg_media.encode_pcm(payload)
    streams, bad = ogg_media.read(media)
    assert bad == 0 and ogg_media.decode_pcm(streams) == payload
    whole = [p for p, _ in streams[0].packets]
    # one flipped byte, rubbish before and between, a cut end
    starts = [k for k in range(len(media)) if media.startswith(b"OggS", k)]
    hit = bytearray(media)
    hit[starts[6] + 100] ^= 1
    for broken in (bytes(hit), b"junkOggS" + bytes(hit), bytes(hit[: starts[7]]) + b"OggSrubbish" + bytes(hit[starts[7] :])):
        streams, bad = ogg_media.read(broken)
        assert bad >= 1 and [s.gaps for s in streams] == [1, 0] and {p for p, _ in streams[0].packets} < set(whole)
        assert len(streams[0].packets) >= len(whole) - 6
    streams, bad = ogg_media.read(media[:-10])
    assert bad == 1 and not all(s.ended for s in streams)
    assert ogg_media.read(b"") == ([], 0) and ogg_media.read(b"OggS") == ([], 1)


def test_a_serial_number_used_again_is_another_stream():
    one = ogg_media.encode_pcm(b"a" * 192)
    streams, _ = ogg_media.read(one + ogg_media.encode_pcm(b"b" * 192))
    assert [s.serial for s in streams] == [1, 2, 1, 2]
    assert [[p for p, *_ in s.timed()] for s in streams] == [[b"a" * 192], [], [b"b" * 192], []]


def test_times_of_codecs():
    def times(head, headers, packets, ends):
        (s,), _ = ogg_media.read(b"".join(ogg_media.stream_pages(1, [head, *[b"h"] * (headers - 1)], packets, ends, 1)))
        return s.codec()[:3], [(b, e) for _, b, e in s.timed()]

    vorbis = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44_100) + bytes(14)
    assert times(vorbis, 3, [b"a", b"b"], [441, 882]) == (("vorbis", 44_100, 2), [(0, 10), (10, 20)])
    opus = b"OpusHead" + struct.pack("<BBHIHB", 1, 1, 480, 16_000, 0, 0)
    assert times(opus, 2, [b"a", b"b"], [960, 1440]) == (("opus", 48_000, 1), [(0, 10), (10, 20)])
    flac = b"\x7fFLAC\x01\x00\x00\x01fLaC" + bytes(14) + (16_000 << 4 | 1 << 1).to_bytes(3, "big") + bytes(21)
    assert times(flac, 2, [b"a"], [1600]) == (("flac", 16_000, 2), [(0, 100)])
    speex = b"Speex   " + bytes(28) + struct.pack("<I", 8000) + bytes(8) + struct.pack("<I", 1) + bytes(28)
    assert times(speex, 2, [b"a"], [8]) == (("speex", 8000, 1), [(0, 1)])
    assert times(b"other", 1, [b"a"], [8]) == (("unknown", None, None), [(None, None), (None, None)])
    # PCM: packets before the page's last are timed backwards
    streams, _ = ogg_media.read(ogg_media.encode_pcm(bytes(9 * ogg_media.SAMPLES)))
    assert [(b, e) for _, b, e in streams[0].timed()] == [(120 * k, 120 * (k + 1)) for k in range(5)]


TEXTS = ["", None, " ", "x", "é" * 95 + "zz", "ß" * 96, "a" * 192, "a" * 193, "b" * 960, "c" * 1920, "漢字 " * 30_000, "OggS\x00 in a text", "x", "\U0001f600" * 50]


def test_query_round_trip(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "x", "y")]
    got = ogg_media.digest(spark.createDataFrame(rows, "doc_id long, text string, media string"))
    assert got.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = got.collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        raw = (TEXTS[r.doc_id] if r.doc_id is not None else "x") or ""
        payload = raw.encode()
        payload += b" " * (-len(payload) % 192 or (0 if payload else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw.encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.bad_pages == 0 and r.media_bytes > r.payload_bytes
        assert by_text.setdefault(raw, r[5:8]) == r[5:8]
        assert f"total_ms={round(len(payload) / 8)} " in r.feature
    assert len({v[1] for v in by_text.values()}) == len({(t or "").ljust(192) for t in TEXTS})


def test_stored_files_are_probed_and_cut_into_packets(spark):
    df = spark.createDataFrame([("a", "k" * 5000), ("b", None)], "name string, text string")
    files = ogg_media.encode(df, "name").withColumnRenamed("doc_id", "name").union(spark.createDataFrame([("c", 0, None), ("d", 0, bytearray(b"no such file"))], "name string, n_bytes long, media binary"))
    streams = sorted(ogg_media.probe(files, "name").collect())
    assert [(r.file_id, r.stream, r.codec, r.rate, r.packets, r.bytes, r.ended) for r in streams] == [("a", 0, "pcm", 8000, 3, 2880, True), ("a", 1, "pcm", 8000, 3, 2304, True), ("b", 0, "pcm", 8000, 1, 192, True), ("b", 1, "pcm", 8000, 0, 0, True)]
    cut = ogg_media.packets(files, "name").orderBy("file_id", "packet", "stream").collect()
    assert b"".join(bytes(r.data) for r in cut if r.file_id == "a").rstrip() == b"k" * 5000
    assert [(r.begin_ms, r.end_ms) for r in cut if r.file_id == "a" and r.stream == 1] == [(0, 120), (120, 240), (240, 288)]
    told = {r.file_id: r for r in ogg_media.features(files, "name").collect()}
    assert told["c"].feature.startswith("streams=0 ") and told["d"].payload == b""
    assert ogg_media.digest(df.where(F.lit(False)), "name").count() == 0

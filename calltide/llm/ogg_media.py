"""Media columns in Ogg: binary columns whose files are checked page by page, taken apart into streams and packets, and timed.

Reading: a page counts only if its checksum holds; after a bad one the next capture pattern is looked for. Packets are put
together from lacing values, over as many pages as they span, separately for each logical stream (serial number; a stream
that begins anew under an old number is another one). A gap in the page numbers costs the packets that it cuts. Times follow
from granule positions: a page's position is the end of the last packet that ends on it, and where a codec's packets tell
their own length (PCM does), the packets before it are timed from there backwards.

Writing: payloads are stored losslessly as unsigned 8-bit PCM in two logical streams that take packets in turn, on pages
short enough that packets span them. Ogg's checksum has the polynomial of zlib's with its bits in the other order, so zlib
computes it on bytes that are turned round.

Files are rows of a binary column, each read whole by one task and independent of all others.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltide.llm.common import bound_batches

# Fixed values of the container (RFC 3533) and of the codecs' mappings.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
PCM, VORBIS, OPUS, SPEEX, FLAC = b"PCM     ", b"\x01vorbis", b"OpusHead", b"Speex   ", b"\x7fFLAC"
PCM_HEADER = struct.Struct(">8sHHIIBBHI")
PCM_UNSIGNED_8 = 1

#: What the writer does: streams, samples a packet and a second, lacing values a page, bytes of which payloads are multiples.
STREAMS = 2
SAMPLES = 960
RATE = 8000
PAGE_SEGMENTS = 17
UNIT = 192

_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 of a page whose checksum field is zero: polynomial 0x04C11DB7, most significant bit first, from zero."""
    turned = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(turned.to_bytes(4, "little").translate(_TURNED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    made = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return made[:22] + checksum(made).to_bytes(4, "little") + made[26:]


def stream_pages(serial: int, headers: list[bytes], packets: list[bytes], ends: list[int], segments: int = PAGE_SEGMENTS) -> list[bytes]:
    """The pages of one logical stream: one for each header packet, then the packets with their end positions, run on."""
    parts = [(FIRST if k == 0 else 0, 0, bytes([255] * (len(h) // 255) + [len(h) % 255]), h) for k, h in enumerate(headers)]
    lacing, end_at = bytearray(), {}
    for packet, end in zip(packets, ends, strict=True):
        lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        end_at[len(lacing) - 1] = end
    body, at, open_ = b"".join(packets), 0, False
    for k in range(0, len(lacing), segments):
        own = bytes(lacing[k : k + segments])
        size = sum(own)
        ended = [end_at[i] for i in range(k, k + len(own)) if i in end_at]
        parts.append((CONTINUED if open_ else 0, ended[-1] if ended else NO_GRANULE, own, body[at : at + size]))
        at, open_ = at + size, own[-1] == 255
    flags, *rest = parts[-1]
    parts[-1] = (flags | LAST, *rest)
    return [page(flags, granule, serial, number, own, data) for number, (flags, granule, own, data) in enumerate(parts)]


def encode_pcm(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit samples: packets of SAMPLES dealt to STREAMS logical streams in turn; first pages first."""
    main = PCM_HEADER.pack(PCM, 0, 0, PCM_UNSIGNED_8, RATE, 8, 1, SAMPLES, 0)
    comment = struct.pack("<I8sI", 8, b"calltide", 0)
    cut = [payload[k : k + SAMPLES] for k in range(0, len(payload), SAMPLES)]
    streams = []
    for serial in range(STREAMS):
        own = cut[serial::STREAMS]
        streams.append(stream_pages(serial + 1, [main, comment], own, np.cumsum([len(p) for p in own]).tolist()))
    longest = max(map(len, streams))
    return b"".join(s[k] for k in range(longest) for s in streams if k < len(s))


@dataclass
class Stream:
    """A logical stream as it was read; ``packets`` are (bytes, end position or None)."""

    serial: int
    next_page: int | None = None
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    partial: list[bytes] | None = None
    packets: list[tuple[bytes, int | None]] = field(default_factory=list)

    def take(self, flags: int, granule: int, number: int, lacing: bytes, body: memoryview) -> None:
        """One more page: what it continues, then the packets that begin on it."""
        if self.next_page is not None and number != self.next_page:
            self.gaps += 1
            self.partial = None
        self.next_page, self.pages = (number + 1) & 0xFFFFFFFF, self.pages + 1
        self.ended |= bool(flags & LAST)
        skip = bool(flags & CONTINUED) and self.partial is None  # the packet's beginning is lost
        if not flags & CONTINUED:
            self.partial = None
        begin = at = 0
        last = None
        for size in lacing:
            at += size
            if size < 255:
                if skip:
                    skip = False
                else:
                    self.packets.append((b"".join([*(self.partial or ()), body[begin:at]]), None))
                    last = len(self.packets) - 1
                self.partial, begin = None, at
        if lacing and lacing[-1] == 255 and not skip:
            self.partial = [*(self.partial or ()), bytes(body[begin:at])]
        if last is not None and granule != NO_GRANULE:
            self.packets[last] = (self.packets[last][0], granule)

    def codec(self) -> tuple[str, int | None, int | None, int]:
        """(name, positions a second, channels, header packets) by the first packet; other codecs have no times."""
        head = self.packets[0][0] if self.packets else b""
        if head.startswith(PCM) and len(head) >= PCM_HEADER.size:
            *_, rate, _, channels, _, extra = PCM_HEADER.unpack_from(head)
            return "pcm", rate, channels, 2 + extra
        if head.startswith(VORBIS) and len(head) >= 16:
            return "vorbis", int.from_bytes(head[12:16], "little"), head[11], 3
        if head.startswith(OPUS) and len(head) >= 19:
            return "opus", 48_000, head[9], 2
        if head.startswith(SPEEX) and len(head) >= 72:
            return "speex", int.from_bytes(head[36:40], "little"), int.from_bytes(head[48:52], "little"), 2 + int.from_bytes(head[68:72], "little")
        if head.startswith(FLAC) and len(head) >= 34:
            return "flac", int.from_bytes(head[27:30], "big") >> 4, (head[29] >> 1 & 7) + 1, 1 + int.from_bytes(head[7:9], "big")
        return "unknown", None, None, 0

    def timed(self) -> Iterator[tuple[bytes, float | None, float | None]]:
        """(packet, begin, end) of the data packets, in milliseconds where granule positions tell them."""
        name, rate, channels, headers = self.codec()
        data = self.packets[headers:]
        ends = [end for _, end in data]
        skip = int.from_bytes(self.packets[0][0][10:12], "little") if name == "opus" else 0
        if name == "pcm" and channels:
            wide = {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 4, 7: 4}.get(PCM_HEADER.unpack_from(self.packets[0][0])[3])
            frames = [len(p) // (wide * channels) for p, _ in data] if wide else []
            for k in range(len(frames) - 2, -1, -1):
                if ends[k] is None and ends[k + 1] is not None:
                    ends[k] = ends[k + 1] - frames[k + 1]
            begins = [None if e is None else e - f for e, f in zip(ends, frames, strict=True)] if frames else [None] * len(ends)
        else:
            begins = [0, *ends[:-1]] if ends else []
        at = lambda g: None if g is None or not rate else max(0, g - skip) * 1000 / rate
        for (packet, _), begin, end in zip(data, begins, ends, strict=True):
            yield packet, at(begin), at(end)


def read(media: bytes) -> tuple[list[Stream], int]:
    """(logical streams in order of their first pages, number of bad pages) of a file; bytes that belong to no page are skipped."""
    streams: list[Stream] = []
    current: dict[int, Stream] = {}
    view, at, bad = memoryview(media), media.find(CAPTURE), 0
    while at >= 0:
        end = 0
        if at + HEADER.size <= len(media):
            _, version, flags, granule, serial, number, found, n = HEADER.unpack_from(media, at)
            start = at + HEADER.size + n
            lacing = media[at + HEADER.size : start]
            end = start + sum(lacing)
            if version or len(lacing) < n or end > len(media) or checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != found:
                end = 0
        if end:
            if serial not in current or flags & FIRST and current[serial].pages:
                current[serial] = Stream(serial)
                streams.append(current[serial])
            current[serial].take(flags, granule, number, lacing, view[start:end])
        else:
            bad += 1
        at = media.find(CAPTURE, end or at + 1)
    return streams, bad


def decode_pcm(streams: list[Stream]) -> bytes:
    """The payload that ``encode_pcm`` stored: the streams' data packets in turn."""
    data = [[p for p, _ in s.packets[s.codec()[3] :]] for s in streams]
    return b"".join(d[k] for k in range(max(map(len, data), default=0)) for d in data if k < len(d))


def _mapped(rows: DataFrame, fields: list[tuple[str, T.DataType, pa.DataType]], each) -> DataFrame:
    """Rows (id, *fields) from (id, media): each(media or b"") yields the tuples of fields."""
    schema = T.StructType([rows.schema[0], *(T.StructField(name, kind) for name, kind, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for k, value in enumerate(batch.column(1)):
                for made in each(value.as_py() or b""):
                    at.append(k)
                    values.append(made)
            columns = zip(*values, strict=True) if values else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, fields, strict=True))], schema.names)

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


_LONG, _TEXT, _DOUBLE, _BYTES = (T.LongType(), pa.int64()), (T.StringType(), pa.string()), (T.DoubleType(), pa.float64()), (T.BinaryType(), pa.binary())


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as an Ogg file; its UTF-8 bytes, blanks appended up to a positive multiple of UNIT.

    A null text counts as empty. Equal texts give equal files. Ids may be null or of any type; other columns are not looked at.
    """
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")

    def each(payload: bytes) -> Iterator[tuple]:
        yield len(payload), encode_pcm(payload + b" " * (max(1, -(-len(payload) // UNIT)) * UNIT - len(payload)))

    return _mapped(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), raw.alias("raw")), [("n_bytes", *_LONG), ("media", *_BYTES)], each)


def probe(files: DataFrame, file_id: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per logical stream of every file: id, stream (from 0), serial, codec, rate, channels, pages, packets, bytes, gaps, ended, end_ms.

    Files that are null, empty or hold no page with a right checksum give no row.
    """

    def each(data: bytes) -> Iterator[tuple]:
        for k, s in enumerate(read(data)[0]):
            name, rate, channels, _ = s.codec()
            timed = list(s.timed())
            yield k, s.serial, name, rate, channels, s.pages, len(timed), sum(len(p) for p, _, _ in timed), s.gaps, s.ended, max((e for _, _, e in timed if e is not None), default=None)

    fields = [("stream", *_LONG), ("serial", *_LONG), ("codec", *_TEXT), ("rate", *_LONG), ("channels", *_LONG), ("pages", *_LONG), ("packets", *_LONG), ("bytes", *_LONG), ("gaps", *_LONG), ("ended", T.BooleanType(), pa.bool_()), ("end_ms", *_DOUBLE)]
    return _mapped(files.select(F.col(f"`{file_id}`").alias("file_id"), F.col(f"`{media}`")), fields, each)


def packets(files: DataFrame, file_id: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per data packet of every logical stream: id, stream, packet (both from 0), begin_ms, end_ms, data."""

    def each(data: bytes) -> Iterator[tuple]:
        for k, s in enumerate(read(data)[0]):
            for n, (packet, begin, end) in enumerate(s.timed()):
                yield k, n, begin, end, packet

    return _mapped(files.select(F.col(f"`{file_id}`").alias("file_id"), F.col(f"`{media}`")), [("stream", *_LONG), ("packet", *_LONG), ("begin_ms", *_DOUBLE), ("end_ms", *_DOUBLE), ("data", *_BYTES)], each)


def features(files: DataFrame, file_id: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per file written by ``encode``: id, payload (as read back), media_bytes, media_sha256, bad_pages and ``feature``.

    ``feature`` tells streams, pages, packets, the longest stream's end and the sum of all in milliseconds, as granule
    positions give them, and the samples' mean, deviation and changes of side about the mean. A null file counts as empty:
    no streams and an empty payload.
    """

    def each(data: bytes) -> Iterator[tuple]:
        streams, bad = read(data)
        payload = decode_pcm(streams)
        ends = [max((e for _, _, e in s.timed() if e is not None), default=0) for s in streams]
        samples = np.frombuffer(payload, np.uint8)
        mean, deviation = (samples.mean(), samples.std()) if len(samples) else (0, 0)
        side = samples > mean
        told = {"streams": len(streams), "pages": sum(s.pages for s in streams), "packets": sum(len(s.packets) for s in streams), "end_ms": round(max(ends, default=0)), "total_ms": round(sum(ends)), "mean": f"{mean:.3f}", "deviation": f"{deviation:.3f}", "changes": int((side[1:] != side[:-1]).sum())}
        yield payload, len(data), hashlib.sha256(data).hexdigest(), bad, " ".join(f"{k}={v}" for k, v in told.items())

    fields = [("payload", *_BYTES), ("media_bytes", *_LONG), ("media_sha256", *_TEXT), ("bad_pages", *_LONG), ("feature", *_TEXT)]
    return _mapped(files.select(F.col(f"`{file_id}`").alias("file_id"), F.col(f"`{media}`")), fields, each)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: it is stored, the stored file is read back, and both are told in numbers and hashes."""
    stored = encode(docs, doc_id, text)
    back = features(stored.select(F.struct("doc_id", "n_bytes").alias("of"), "media"), "of")
    return back.select(
        "file_id.doc_id", "file_id.n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "bad_pages",
    )

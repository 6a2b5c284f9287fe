"""Media columns: Ogg files of 8-bit samples.

``write`` muxes a payload into two logical streams (packets alternate between them), ``pages`` verifies every page's
checksum, ``demultiplex`` reassembles packets from lacing values per logical stream and derives times from granule
positions, ``payload`` puts the samples back in order. ``encode_texts`` and ``decode_media`` apply these to columns.

Defined results: a null text is an empty one; an empty text has a payload of 64 zero bytes; a null media value decodes
to nulls; a page whose checksum or version is wrong is counted in ``bad_pages`` and skipped up to the next capture
pattern, and packets that lose a part are dropped and counted in ``lost_packets``. Repeated rows give repeated rows.
Columns other than doc_id and the content are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from starlode.llm import common

RATE = 8000
PACKET = 4096
STREAMS = 2
HEAD = struct.Struct("<4sBBqIIIB")
#: Identification packet: magic, version, number of this stream, streams, bytes of a packet, rate, samples of the stream.
IDENT = struct.Struct("<8sBBBIIQ")
MAGIC = b"\x80s8pcm\0\0"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, most significant bit first, from 0: zlib's reflected one over reversed bits."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (0 if data else 64))


class _Stream:
    """Collects packets of one logical stream into pages."""

    def __init__(self, serial: int):
        self.serial, self.number, self.granule = serial, 0, 0
        self.lacing: list[int] = []
        self.body: list[bytes] = []
        self.done = -1  # granule position of the last packet that ends in the open page
        self.continued = False
        self.out: list[bytes] = []

    def flush(self, last: bool = False) -> None:
        flags = CONTINUED * self.continued | FIRST * (self.number == 0) | LAST * last
        body = b"".join(self.body)
        head = HEAD.pack(b"OggS", 0, flags, self.done, self.serial, self.number, 0, len(self.lacing)) + bytes(self.lacing)
        crc = checksum(head + body)
        self.out.append(head[:22] + crc.to_bytes(4, "little") + head[26:] + body)
        self.continued = bool(self.lacing) and self.lacing[-1] == 255
        self.number, self.lacing, self.body, self.done = self.number + 1, [], [], -1

    def add(self, packet: bytes, samples: int) -> None:
        self.granule += samples
        at = 0
        while True:
            if len(self.lacing) == 255:
                self.flush()
            room = 255 - len(self.lacing)
            whole = min((len(packet) - at) // 255, room)
            self.lacing += [255] * whole
            self.body.append(packet[at : at + 255 * whole])
            at += 255 * whole
            if len(self.lacing) < 255 and len(packet) - at < 255:
                self.lacing.append(len(packet) - at)
                self.body.append(packet[at:])
                self.done = self.granule
                return


def write(samples: bytes, packet: int = PACKET, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """An Ogg file of 8-bit samples; packet i belongs to logical stream i mod streams."""
    parts = [samples[a : a + packet] for a in range(0, len(samples), packet)]
    tracks = []
    for k in range(streams):
        own = parts[k::streams]
        track = _Stream(0x51A20000 + k)
        track.add(IDENT.pack(MAGIC, 1, k, streams, packet, rate, sum(map(len, own))), 0)
        track.flush(last=not own)
        for i, part in enumerate(own):
            track.add(part, len(part))
        if own:
            track.flush(last=True)
        tracks.append(track.out)
    return b"".join(t[0] for t in tracks) + b"".join(t[i] for i in range(1, max(map(len, tracks))) for t in tracks if i < len(t))


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


@dataclass
class Packet:
    data: bytes
    granule: int | None = None  # position after the packet, if its page or the packets behind it tell


@dataclass
class Logical:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    first: bool = False
    last: bool = False
    lost: int = 0


def pages(data: bytes) -> tuple[list[Page], int]:
    """The pages with right checksums, and the number of damaged ones."""
    found, bad, at = [], 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + HEAD.size > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, segments = HEAD.unpack_from(data, at)
        body = at + HEAD.size + segments
        lacing = data[at + HEAD.size : body]
        end = body + sum(lacing)
        if version or len(lacing) < segments or end > len(data) or checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 4
            continue
        found.append(Page(flags, granule, serial, number, lacing, data[body:end]))
        at = end
    return found, bad


def demultiplex(found: list[Page]) -> dict[int, Logical]:
    """Packets of each logical stream, in order of first appearance."""
    out: dict[int, Logical] = {}
    open_parts: dict[int, list[bytes] | None] = {}
    numbers: dict[int, int] = {}
    for page in found:
        stream = out.setdefault(page.serial, Logical(page.serial))
        parts = open_parts.get(page.serial)
        if page.number != numbers.get(page.serial, page.number if page.flags & FIRST else -1):
            stream.lost += 1
            parts = None
        if page.flags & CONTINUED and parts is None:
            skip = True  # the begin of this packet is missing
        else:
            skip = False
            if not page.flags & CONTINUED:
                parts = None
        numbers[page.serial] = page.number + 1
        stream.pages += 1
        stream.first |= bool(page.flags & FIRST)
        stream.last |= bool(page.flags & LAST)
        at, ended = 0, []
        run = 0
        for value in page.lacing:
            run += value
            if value < 255:
                piece = page.body[at : at + run]
                at, run = at + run, 0
                if skip:
                    skip = False
                    continue
                ended.append(Packet(b"".join([*(parts or []), piece])))
                parts = None
        if run and not skip:
            parts = [*(parts or []), page.body[at : at + run]]
        open_parts[page.serial] = parts
        granule = page.granule
        if granule >= 0:
            for packet in reversed(ended):
                packet.granule = granule
                granule -= len(packet.data)
        stream.packets += ended
    return out


@dataclass
class Media:
    samples: bytes
    rate: int
    streams: int
    packets: int
    pages: int
    bad_pages: int
    lost_packets: int
    seconds: list[float]  # end of each data packet in its own stream, in order of the samples


def read(data: bytes) -> Media:
    """Verifies, demultiplexes and reassembles; raises ValueError if there is no identification packet."""
    found, bad = pages(data)
    tracks: dict[int, Logical] = {}
    rate = streams = size = 0
    for stream in demultiplex(found).values():
        if stream.packets and stream.packets[0].data.startswith(MAGIC) and len(stream.packets[0].data) == IDENT.size:
            _, _, k, streams, size, rate, _ = IDENT.unpack(stream.packets[0].data)
            tracks[k] = stream
    if not tracks:
        raise ValueError("no stream of 8-bit samples")
    # A packet's place follows from where it begins in its stream, so that lost ones do not move those behind them.
    begins = [(p.granule - len(p.data), k, i) for k, t in tracks.items() for i, p in enumerate(t.packets) if i and p.granule is not None]
    chosen = [tracks[k].packets[i] for _, k, i in sorted((at // max(size, 1), k, i) for at, k, i in begins)]
    return Media(
        b"".join(p.data for p in chosen), rate, streams, len(chosen) + len(tracks), len(found), bad,
        sum(t.lost for t in tracks.values()), [p.granule / rate for p in chosen],
    )


def feature(media: Media) -> str:
    """Counts, times and simple statistics of the samples that were read, as text."""
    x = np.frombuffer(media.samples, np.uint8)
    centred = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.signbit(centred[1:]) != np.signbit(centred[:-1])))
    energy = int(np.dot(centred.astype(np.int64), centred.astype(np.int64)))
    total = int(x.sum(dtype=np.int64))
    return (
        f"streams={media.streams};pages={media.pages};packets={media.packets};bad={media.bad_pages};lost={media.lost_packets};"
        f"seconds={len(x) / media.rate:.6f};last={max(media.seconds, default=0.0):.6f};mean={total / max(len(x), 1):.6f};"
        f"rms={(energy / max(len(x), 1)) ** 0.5:.6f};peak={int(np.abs(centred).max(initial=0))};crossings={crossings}"
    )


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the Ogg file of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        return common.batch_of(
            doc_id=batch.column("doc_id"), n_bytes=pa.array([len(t) for t in texts], pa.int64()),
            media=pa.array([write(pad(t)) for t in texts], pa.binary()),
        )

    return common.map_slices(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


DECODED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bad_pages long"


def decode_media(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back: doc_id, n_bytes and what DECODED lists, from doc_id, n_bytes and media."""

    def of(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        got = read(data)
        return (
            len(got.samples), hashlib.sha256(got.samples).hexdigest(), zlib.crc32(got.samples[-64:]),
            len(data), hashlib.sha256(data).hexdigest(), feature(got), got.bad_pages,
        )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [of(x) for x in batch.column("media").to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in DECODED.split(", ")]
        return common.batch_of(doc_id=batch.column("doc_id"), n_bytes=batch.column("n_bytes"), **{n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return common.map_slices(media.select("doc_id", "n_bytes", "media"), run, f"doc_id long, n_bytes long, {DECODED}", column="media")


def roundtrip(docs: DataFrame) -> DataFrame:
    """Stores every text and reads it back; the stored bytes pass between the two Python stages as a column."""
    return decode_media(encode_texts(docs))

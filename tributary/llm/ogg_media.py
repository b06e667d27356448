"""Media columns: Ogg bitstreams written to and read from binary columns.

The writer stores a payload as 8-bit mono samples in one logical stream and a cue
track (one packet a second of samples, holding the sample number it starts at) in
a second logical stream; pages of both are interleaved. The reader verifies every
page checksum, reassembles packets from lacing values across pages, demultiplexes
the logical streams by serial number, checks page sequence numbers, and derives
timestamps from granule positions (here: sample counts).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the container format (RFC 3533).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
MAX_SEGMENTS = 255
HEADER = struct.Struct("<4sBBqIIIB")

#: Header packets of the two logical streams the writer makes.
SAMPLES_HEAD = b"PCM8"
CUES_HEAD = b"CUES"
SAMPLE_RATE = 8000
SAMPLES_SERIAL, CUES_SERIAL = 1, 2

#: Samples in one packet, and the payload's granularity.
PACKET_SAMPLES = 3072
FRAME = 192

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 (polynomial 0x04C11DB7, not reflected, zero start) of a page whose checksum field is zero.

    Reflecting the bits of every byte turns it into the reflected CRC that zlib
    computes; starting from ~0 cancels zlib's own initial and final inversion.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class StreamWriter:
    """Pages of one logical stream."""

    serial: int
    sequence: int = 0

    def pages(self, packets: list[bytes], granules: list[int], flags: int = 0) -> Iterator[bytes]:
        """Pages that hold `packets`; granules[i] is the position after packet i."""
        lacing: list[int] = []
        ends: list[int | None] = []
        for packet, granule in zip(packets, granules, strict=True):
            full, rest = divmod(len(packet), 255)
            lacing += [255] * full + [rest]
            ends += [None] * full + [granule]
        body = b"".join(packets)
        at = 0
        for start in range(0, len(lacing), MAX_SEGMENTS):
            laced = lacing[start : start + MAX_SEGMENTS]
            done = [x for x in ends[start : start + MAX_SEGMENTS] if x is not None]
            kind = flags & FIRST if start == 0 else 0
            kind |= CONTINUED if start and ends[start - 1] is None else 0
            kind |= flags & LAST if start + MAX_SEGMENTS >= len(lacing) else 0
            size = sum(laced)
            yield self._page(kind, done[-1] if done else NO_GRANULE, laced, body[at : at + size])
            at += size

    def _page(self, kind: int, granule: int, laced: list[int], body: bytes) -> bytes:
        head = HEADER.pack(CAPTURE, 0, kind, granule, self.serial, self.sequence, 0, len(laced)) + bytes(laced)
        page = head + body
        self.sequence += 1
        return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def write_ogg(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """An Ogg bitstream with `payload` as 8-bit samples and a cue track."""
    samples, cues = StreamWriter(SAMPLES_SERIAL), StreamWriter(CUES_SERIAL)
    out = [
        *samples.pages([SAMPLES_HEAD + struct.pack("<II", rate, 1)], [0], FIRST),
        *cues.pages([CUES_HEAD + struct.pack("<I", rate)], [0], FIRST),
    ]
    total = len(payload)
    step = PACKET_SAMPLES * 21  # packets of one page: at most 21 * 13 lacing values of 255
    sound: list[tuple[int, list[bytes]]] = []
    for start in range(0, total, step):
        run = [
            page
            for page in samples.pages(
                [payload[p : p + PACKET_SAMPLES] for p in range(start, min(start + step, total), PACKET_SAMPLES)],
                [min(p + PACKET_SAMPLES, total) for p in range(start, min(start + step, total), PACKET_SAMPLES)],
                LAST if start + step >= total else 0,
            )
        ]
        sound.append((start, run))
    starts = list(range(0, total, rate)) or [0]
    for start, run in sound:
        mine = [s for s in starts if start <= s < start + step]
        if mine:
            out += cues.pages([struct.pack("<Q", s) for s in mine], mine, LAST if mine[-1] == starts[-1] else 0)
        out += run
    return b"".join(out)


@dataclass
class LogicalStream:
    """What one serial number carries after demultiplexing."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: (packet number, granule position) of packets that end a page
    positions: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)
    _next: int = 0


class OggError(ValueError):
    """The bytes are not a whole, intact Ogg bitstream."""


def read_ogg(media: bytes) -> dict[int, LogicalStream]:
    """Logical streams by serial number, in order of first appearance.

    Raises OggError on a bad capture pattern, a cut page or a wrong checksum. A
    missing page is counted in `gaps` and the packet it cut is dropped.
    """
    streams: dict[int, LogicalStream] = {}
    at = 0
    while at < len(media):
        if at + HEADER.size > len(media):
            raise OggError("cut page header")
        capture, version, kind, granule, serial, sequence, check, count = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version != 0:
            raise OggError("no capture pattern")
        laced = media[at + HEADER.size : at + HEADER.size + count]
        body_at = at + HEADER.size + count
        end = body_at + sum(laced)
        if len(laced) < count or end > len(media):
            raise OggError("cut page")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != check:
            raise OggError("page checksum")
        stream = streams.setdefault(serial, LogicalStream(serial))
        lost = sequence != stream._next
        stream.gaps += lost
        if lost or not kind & CONTINUED:
            stream._open.clear()
        skip = bool(kind & CONTINUED) and not stream._open  # the start of this packet is lost
        stream._next = sequence + 1
        stream.pages += 1
        stream.ended |= bool(kind & LAST)
        finished = 0
        start = pos = body_at
        for value in laced:
            pos += value
            if value < 255:
                if not skip:
                    stream.packets.append(b"".join([*stream._open, media[start:pos]]))
                    finished += 1
                skip = False
                stream._open.clear()
                start = pos
        if start < pos and not skip:
            stream._open.append(media[start:pos])
        if finished and granule != NO_GRANULE:
            stream.positions.append((len(stream.packets) - 1, granule))
        at = end
    return streams


def decode_samples(media: bytes) -> tuple[bytes, dict]:
    """The payload of the sample stream and what the container says of it."""
    streams = read_ogg(media)
    sound = next((s for s in streams.values() if s.packets and s.packets[0].startswith(SAMPLES_HEAD)), None)
    if sound is None:
        raise OggError("no sample stream")
    rate = struct.unpack_from("<I", sound.packets[0], len(SAMPLES_HEAD))[0]
    cues = next((s for s in streams.values() if s.packets and s.packets[0].startswith(CUES_HEAD)), None)
    payload = b"".join(sound.packets[1:])
    return payload, {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()),
        "packets": len(sound.packets) - 1,
        "cues": len(cues.packets) - 1 if cues else 0,
        "gaps": sum(s.gaps for s in streams.values()),
        "duration_ms": (sound.positions[-1][1] if sound.positions else 0) * 1000 // rate,
        "page_ms": [g * 1000 // rate for _, g in sound.positions],
    }


def payload_of(text: str | None, frame: int = FRAME) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of `frame`, and the unpadded length."""
    raw = (text or "").encode("utf-8")
    return raw + b" " * (max(1, -(-len(raw) // frame)) * frame - len(raw)), len(raw)


def feature_string(payload: bytes, info: dict) -> str:
    """Container and signal features of 8-bit samples as one short text."""
    import numpy as np

    x = np.frombuffer(payload, dtype=np.uint8)
    peak, low = (int(x.max()), int(x.min())) if len(x) else (0, 0)
    total = int(x.sum(dtype=np.int64))
    energy = int(np.square(x, dtype=np.int64).sum())
    turns = int(np.count_nonzero(np.diff((x >= 96).view(np.int8))))
    return (
        f"streams={info['streams']};pages={info['pages']};packets={info['packets']};cues={info['cues']};"
        f"ms={info['duration_ms']};min={low};max={peak};sum={total};energy={energy};crossings={turns}"
    )


ENCODED = "{id} {id_type}, n_bytes long, media binary"
DECODED = (
    "{id} {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, error string"
)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text stored as an Ogg bitstream.

    A null text is an empty one (one frame of padding). Nulls and repeats in the id
    pass through; other columns of `docs` are not read. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write_ogg(p) for p, _ in made], pa.binary())],
                    names=[id_col, "n_bytes", "media"],
                )

    return docs.select(id_col, text_col).mapInArrow(encode, ENCODED.format(id=f"`{id_col}`", id_type=kind.simpleString()))


def decode_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Payload digests, features and errors of a (id, n_bytes, media) table.

    Broken or null media give null payload columns and the reason in `error`; rows are never dropped.
    """
    kind = media.schema[id_col].dataType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(2):
                view = stored.as_py()
                try:
                    if view is None:
                        raise OggError("no media")
                    payload, info = decode_samples(view)
                    rows.append((
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(view),
                        hashlib.sha256(view).hexdigest(), feature_string(payload, info), None,
                    ))
                except OggError as reason:
                    rows.append((None, None, None, len(view or b""), view and hashlib.sha256(view).hexdigest(), None, str(reason)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[id_col, "n_bytes", *names])

    picked = media.select(id_col, "n_bytes", "media")
    return picked.mapInArrow(decode, DECODED.format(id=f"`{id_col}`", id_type=kind.simpleString()))


def op9_ogg_media(spark, sf_dir: str) -> DataFrame:
    """Query: every whole document through the container and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode_media(encode_media(docs)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )

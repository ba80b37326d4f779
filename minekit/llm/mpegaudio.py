"""Media columns: MPEG audio (layers I to III, MPEG 1, 2 and 2.5).

The parser skips and reads ID3v2, APE and ID3v1 tags, finds frame headers again after
junk (a header counts only if the next one follows where it says, or the stream ends there),
verifies the frames' 16-bit checksums, reads Xing/Info and VBRI tables, and gives exact
durations (samples / sample rate, encoder delay and padding known) and every frame's offset.

The writer stores any bytes losslessly in the ancillary data of silent layer III frames,
576 bytes a frame, behind an ID3v2 tag and an Info table with seek points.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

# Fixed values of the format: kbit/s by (version class, layer), Hz by version, samples by version and layer.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 25: [11025, 12000, 8000]}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576, (25, 1): 384, (25, 2): 1152, (25, 3): 576}
_CRC_TABLE = [0] * 256
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1) ^ 0x8005 if _c & 0x8000 else _c << 1
    _CRC_TABLE[_i] = _c & 0xFFFF


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The format's checksum (polynomial 0x8005, start 0xFFFF)."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC_TABLE[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mono: bool
    size: int
    samples: int
    side: int


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 2, 3: 1}.get((word[1] >> 3) & 3)
    layer = 4 - ((word[1] >> 1) & 3)
    if version is None or layer == 4 or word[2] >> 4 in (0, 15) or (word[2] >> 2) & 3 == 3 or word[3] & 3 == 2:
        return None
    kbps, rate = BITRATES[(1 if version == 1 else 2, layer)][word[2] >> 4], RATES[version][(word[2] >> 2) & 3]
    padding, mono, samples = (word[2] >> 1) & 1, word[3] >> 6 == 3, SAMPLES[(version, layer)]
    size = (12 * kbps * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, not word[1] & 1, kbps, rate, padding, mono, size, samples, side if layer == 3 else 0)


@dataclass
class Stream:
    """What parse() finds."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    crc_ok: int = 0
    crc_bad: int = 0
    junk_bytes: int = 0
    truncated: int = 0
    samples: int = 0
    end: int = 0

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    @property
    def duration(self) -> float:
        """Seconds, without the encoder's delay and padding where the table names them."""
        cut = self.table.get("delay", 0) + self.table.get("padding", 0)
        return max(0, self.samples - cut) / self.rate if self.rate else 0.0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of the tag, its text frames)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size, tags = 10 + _synchsafe(data[6:10]) + (10 if data[5] & 0x10 else 0), {}
    at, end = 10, min(len(data), 10 + _synchsafe(data[6:10]))
    if data[5] & 0x40 and data[3] >= 3:  # extended header
        at += _synchsafe(data[10:14]) if data[3] == 4 else 4 + int.from_bytes(data[10:14], "big")
    while data[3] >= 3 and at + 10 <= end and data[at : at + 1].strip(b"\0"):
        name, n = data[at : at + 4].decode("latin-1"), _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags[name] = body[1:].decode(code, "replace").strip("\0")
        at += 10 + n
    return size, tags


def _table(frame: bytes, h: Header) -> dict:
    """A Xing/Info or VBRI table in the stream's first frame."""
    at = 4 + 2 * h.protected + h.side
    for at in (at, 4 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, out, p = int.from_bytes(frame[at + 4 : at + 8], "big"), {"kind": frame[at : at + 4].decode()}, at + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
                p += 100
            p += 4 * bool(flags & 8)
            if len(frame) >= p + 24 and frame[p : p + 4].isalnum():  # the encoder's extension
                both = int.from_bytes(frame[p + 21 : p + 24], "big")
                out |= {"delay": both >> 12, "padding": both & 0xFFF}
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, delay, quality, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", frame[40:62])
        raw = frame[62 : 62 + entries * width]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), width)], "frames_per_entry": per}
    return {}


def parse(data: bytes) -> Stream:
    """Everything about a stream; empty and foreign bytes give a stream without frames."""
    out, n = Stream(), len(data)
    at, out.tags = _id3v2(data)
    if n >= 128 and data[n - 128 : n - 125] == b"TAG":
        n -= 128
        for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[n + lo : n + hi].split(b"\0")[0].decode("latin-1").strip():
                out.tags.setdefault(f"v1:{name}", text)
    if n >= 32 and data[n - 32 : n - 24] == b"APETAGEX":
        n -= min(n, int.from_bytes(data[n - 20 : n - 16], "little") + (32 if data[n - 9] & 0x80 else 0))
    first, view, kind = True, memoryview(data), None
    offsets, headers = out.offsets, out.headers
    while at + 4 <= n:
        h = header(data[at : at + 4])
        if h and kind and (h.version, h.layer, h.rate) != kind:
            h = None
        if h and not (offsets and at == out.end):  # not in step: the next header must follow, or the end
            follow = at + h.size
            nxt = header(data[follow : follow + 4]) if follow + 4 <= n else None
            if not (follow == n or (nxt and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate))):
                h = None
        if h and at + h.size > n:
            out.truncated += 1
            break
        if not h:
            nxt = data.find(b"\xff", at + 1, n)
            nxt = n if nxt < 0 else nxt
            out.junk_bytes += nxt - at
            at = nxt
            continue
        kind = (h.version, h.layer, h.rate)
        if h.protected and h.layer == 3:
            good = crc16(bytes(view[at + 2 : at + 4]) + bytes(view[at + 6 : at + 6 + h.side])) == int.from_bytes(view[at + 4 : at + 6], "big")
            out.crc_ok += good
            out.crc_bad += not good
        table = _table(data[at : at + h.size], h) if first and h.layer == 3 else {}
        first = False
        if table:
            out.table = table
        else:
            offsets.append(at)
            headers.append(h)
            out.samples += h.samples
        at += h.size
        out.end = at
        if not offsets:  # the table's frame keeps step too
            nxt = header(data[at : at + 4])
            if not nxt or (nxt.version, nxt.layer, nxt.rate) != kind:
                out.end = -1
    return out


# Storing bytes in ancillary data

UNIT = 576
_WORD = bytes([0xFF, 0xFA, 0xD4, 0x00])  # MPEG 1 layer III with checksum, 256 kbit/s, 48000 Hz, stereo: 768 bytes a frame
_FRAME, _HEAD = 768, 4 + 2 + 32
_TOP = _WORD + crc16(_WORD[2:] + bytes(32)).to_bytes(2, "big") + bytes(32)


def padded(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 of the text with bytes 255 up to a positive multiple of UNIT, bytes before that)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (UNIT * max(1, -(-len(data) // UNIT)) - len(data)), len(data)


def store(payload: bytes) -> bytes:
    """An audio file that holds payload, a multiple of UNIT bytes: one silent frame for each UNIT bytes.

    Every frame has empty granules (part lengths 0), so its main data area is ancillary: the
    payload's bytes, then zeros. The first frame is the Info table; its extension's padding
    field stays 0, as no sample is to be cut.
    """
    frames = len(payload) // UNIT
    body = np.zeros((frames, _FRAME), np.uint8)
    body[:, :_HEAD] = np.frombuffer(_TOP, np.uint8)
    body[:, _HEAD : _HEAD + UNIT] = np.frombuffer(payload, np.uint8).reshape(frames, UNIT)
    total = (frames + 1) * _FRAME
    toc = bytes(min(255, 256 * (_FRAME + (i * frames // 100) * _FRAME) // total) for i in range(100))
    info = (_TOP + b"Info" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + total.to_bytes(4, "big") + toc).ljust(_FRAME, b"\0")
    title = b"\x03" + f"{len(payload)} bytes".encode()
    frame = b"TIT2" + bytes([0, 0, 0, len(title)]) + b"\0\0" + title
    tag = b"ID3\x04\0\0" + bytes([(len(frame) >> s) & 0x7F for s in (21, 14, 7, 0)]) + frame
    return tag + info + body.tobytes()


def read_back(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a stored file, by its frames' offsets."""
    stream = stream or parse(data)
    return b"".join([data[o + _HEAD : o + _HEAD + UNIT] for o in stream.offsets])


def feature(stream: Stream) -> str:
    """Duration, seek points, table, tags and checksums as JSON with sorted keys; all offsets enter through their digest."""
    offsets = np.asarray(stream.offsets, ">i8")
    step = max(1, len(offsets) // 10)
    kbps = {h.kbps for h in set(stream.headers)}
    return json.dumps(
        {
            "crc_bad": stream.crc_bad, "crc_ok": stream.crc_ok, "duration": round(stream.duration, 9), "frames": len(offsets), "junk": stream.junk_bytes, "kbps": sorted(kbps),
            "offsets_sha256": hashlib.sha256(offsets.tobytes()).hexdigest(), "rate": stream.rate, "samples": stream.samples, "seek": [[i, int(offsets[i])] for i in range(0, len(offsets), step)],
            "table": {k: v for k, v in stream.table.items() if k != "toc"}, "tags": stream.tags, "truncated": stream.truncated,
        },
        sort_keys=True, separators=(",", ":"),
    )


def probe(media: DataFrame, media_col: str = "media") -> DataFrame:
    """A column of audio files described: the other columns of media, then duration, samples, rate, frames,
    offsets (every frame's seek offset), tags, crc_ok, crc_bad, junk_bytes and truncated.

    Null and foreign bytes have no frames and duration 0; columns with clashing names are replaced.
    """
    made = ["duration", "samples", "rate", "frames", "offsets", "tags", "crc_ok", "crc_bad", "junk_bytes", "truncated"]
    keep = [c for c in media.columns if c not in (media_col, *made)]
    slim = bounded_batches(media).select(*keep, media_col)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != media_col), "duration double, samples bigint, rate int, frames bigint, offsets array<bigint>, tags map<string,string>, crc_ok bigint, crc_bad bigint, junk_bytes bigint, truncated bigint"])
    kinds = [pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x or b"") for x in batch.column(media_col).to_pylist()]
            values = [[s.duration, s.samples, s.rate, len(s.offsets), s.offsets, list(s.tags.items()), s.crc_ok, s.crc_bad, s.junk_bytes, s.truncated] for s in found]
            columns = [batch.column(c) for c in keep] + [pa.array([v[i] for v in values], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    return slim.mapInArrow(run, fields)


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as audio and read back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text counts as empty and becomes one frame of bytes 255. Equal texts give equal
    values. Rows are independent of each other; nothing is shuffled, and one text at a time is held.
    """
    slim = bounded_batches(docs).select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(text_col):
                payload, n = padded(text.as_py())
                media = store(payload)
                stream = parse(media)
                back = read_back(media, stream)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")

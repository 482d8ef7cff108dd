"""MPEG audio in binary columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

A second part carries any bytes losslessly inside a valid stream: Layer III frames whose
side information is zero decode to silence, and their bodies are ancillary data.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, by (MPEG-1?, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: Version by its two bits, with the divisor of its sample rates.
VERSIONS = {3: ("1", 1), 2: ("2", 2), 0: ("2.5", 4)}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    kbps: int
    rate: int
    length: int
    samples: int
    mono: bool
    checked: bool
    bound: int

    @property
    def side(self) -> int:
        """Bytes of side information after the header and checksum."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == "1" else (9 if self.mono else 17)

    @property
    def body(self) -> int:
        return 4 + 2 * self.checked + self.side


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The header in four bytes, or None. Free-format frames, whose length no header tells, are not taken."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    index, rate_index = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3 or four[3] & 3 == 2:
        return None
    first = version[0] == "1"
    kbps, rate, pad = BITRATES[first, layer][index], RATES[rate_index] // version[1], four[2] >> 1 & 1
    if layer == 1:
        length, samples = (12_000 * kbps // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and not first else 1152
        length = samples // 8 * 1000 * kbps // rate + pad
    mode = four[3] >> 6
    bound = 4 + 4 * (four[3] >> 4 & 3) if mode == 1 else 32
    return Header(version[0], layer, kbps, rate, length, samples, mode == 3, not four[1] & 1, bound)


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        x = byte << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    x = 0xFFFF
    for b in data:
        x = (x << 8 & 0xFFFF) ^ _CRC[x >> 8 ^ b]
    return x


def checksum(frame: bytes, h: Header) -> bool | None:
    """Whether a protected frame's checksum holds; None where there is none, or for Layer II, whose protected part needs its allocation tables."""
    if not h.checked or h.layer == 2:
        return None
    if h.layer == 3:
        part = frame[6 : 6 + h.side]
    else:
        bits = 4 * (32 if h.mono else h.bound + 32)
        part = frame[6 : 6 + bits // 8]
    return crc16(frame[2:4] + part) == int.from_bytes(frame[4:6], "big")


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    if not b:
        return ""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0], "latin-1")
    return b[1:].decode(kind, "replace").rstrip("\0")


def id3v2(data: bytes, at: int = 0) -> tuple[int, dict[str, str]]:
    """Length of the tag at a position (0: none) and its text frames; a TXXX frame is named by its description."""
    head = data[at : at + 10]
    if len(head) < 10 or head[:3] != b"ID3" or max(head[6:10]) > 127:
        return 0, {}
    major, size = head[3], _syncsafe(head[6:10])
    body = data[at + 10 : at + 10 + size]
    if head[5] & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    pos, tags, wide = 0, {}, 4 if major >= 3 else 3
    if head[5] & 0x40 and major >= 3 and len(body) >= 4:
        pos = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    while pos + (10 if wide == 4 else 6) <= len(body) and body[pos]:
        name, raw = body[pos : pos + wide].decode("latin-1"), body[pos + wide : pos + 2 * wide]
        n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        start = pos + (10 if wide == 4 else 6)
        if name.startswith("T"):
            text = _text(body[start : start + n])
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = value
        pos = start + n
    return 10 + size + (10 if head[5] & 0x10 else 0), tags


def id3v1(data: bytes) -> dict[str, str]:
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return {}
    t = data[-128:]
    field_of = {"TIT2": t[3:33], "TPE1": t[33:63], "TALB": t[63:93], "TDRC": t[93:97]}
    return {k: s for k, v in field_of.items() if (s := v.split(b"\0")[0].decode("latin-1").strip())}


def trailer(data: bytes, at: int) -> int:
    """Length of an ID3v1 or APEv2 tag at a place where no frame begins; 0 without one."""
    if data[at : at + 3] == b"TAG" and len(data) - at == 128:
        return 128
    if data[at : at + 8] == b"APETAGEX" and len(data) - at >= 32:
        return min(len(data) - at, int.from_bytes(data[at + 12 : at + 16], "little") + 32 * (data[at + 23] >> 7))
    return 0


def vbr_table(frame: bytes, h: Header) -> tuple[str, int | None, int | None, list[int]] | None:
    """(kind, frames, bytes, seek table) of a Xing, Info or VBRI frame."""
    for at in {4 + h.side, h.body}:
        kind = frame[at : at + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, pos, got = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, []
            for bit in (1, 2):
                got.append(int.from_bytes(frame[pos : pos + 4], "big") if flags & bit else None)
                pos += 4 * bool(flags & bit)
            return kind.decode(), got[0], got[1], list(frame[pos : pos + 100]) if flags & 4 else []
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, wide = struct.unpack(">IIHHH", frame[46:60])
        table = [int.from_bytes(frame[62 + k * wide : 62 + (k + 1) * wide], "big") * scale for k in range(n)]
        return "VBRI", frames, size, table
    return None


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    bodies: list[int] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    samples: int = 0
    kinds: set[tuple[str, int, int, bool]] = field(default_factory=set)
    checked: int = 0
    failed: int = 0
    junk: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: tuple[str, int | None, int | None, list[int]] | None = None


def parse(data: bytes) -> Stream:
    """Frames of a stream. Out of step, a header counts only if its frame ends in a like header or at the end.

    A frame whose checksum fails is kept and counted as failed; bytes between frames and a cut last
    frame are counted as junk. Trailing tags are looked for only where no frame begins, so a frame's
    content is never taken for one. A table frame is no audio: it adds no duration and no offset.
    """
    out, pos, end = Stream(), 0, len(data)
    while (n := (got := id3v2(data, pos))[0]):
        out.tags |= got[1]
        pos += n
    in_step, first, by_rate = False, True, {}
    while pos < end:
        h = header(data[pos : pos + 4])
        good = h is not None and pos + h.length <= end
        if good and not in_step:
            after = pos + h.length
            like = h if after == end or trailer(data, after) else header(data[after : after + 4])
            good = like is not None and (like.version, like.layer, like.rate) == (h.version, h.layer, h.rate)
        if not good and (n := trailer(data, pos)):
            out.tags = id3v1(data[pos : pos + n]) | out.tags
            pos += n
            continue
        if not good:
            found = data.find(b"\xff", pos + 1, end)
            out.junk += (found if found >= 0 else end) - pos
            pos, in_step = found if found >= 0 else end, False
            continue
        frame = data[pos : pos + h.length]
        ok = checksum(frame, h)
        if ok is not None:
            out.checked += 1
            out.failed += not ok
        table = vbr_table(frame, h) if first else None
        if table:
            out.table = table
        else:
            out.offsets.append(pos)
            out.lengths.append(h.length)
            out.bodies.append(h.body)
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
            out.kinds.add((h.version, h.layer, h.rate, h.mono))
        first, in_step = False, True
        pos += h.length
    out.samples = sum(by_rate.values())
    out.duration = sum((Fraction(n, r) for r, n in by_rate.items()), Fraction(0))
    return out


def bodies(data: bytes, s: Stream) -> bytes:
    return b"".join(data[o + b : o + n] for o, n, b in zip(s.offsets, s.lengths, s.bodies))


# --- carrying bytes ------------------------------------------------------------------------

_RATE = 32000


@lru_cache(16)
def _shell(index: int) -> tuple[bytes, int]:
    """Header, checksum and silent side information of a protected mono frame, and what its body holds."""
    four = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))
    h = header(four)
    side = bytes(h.side)
    return four + crc16(four[2:4] + side).to_bytes(2, "big") + side, h.length - h.body


_ROOM = [(_shell(i)[1], i) for i in range(1, 15)]


def _tag(values: dict[str, str]) -> bytes:
    body = b""
    for k, v in values.items():
        text = b"\x03" + k.encode() + b"\0" + v.encode()
        n = len(text)
        body += b"TXXX" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + b"\0\0" + text
    n = len(body)
    return b"ID3\x04\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


def pack(payload: bytes) -> bytes:
    """A variable-bitrate stream that carries the payload: tag, table frame, audio frames."""
    widest, top = _ROOM[-1]
    full, rest = divmod(len(payload), widest)
    shell = _shell(top)[0]
    frames = [shell + payload[k * widest : (k + 1) * widest] for k in range(full)]
    if rest:
        room, index = next(x for x in _ROOM if x[0] >= rest)
        frames.append(_shell(index)[0] + payload[full * widest :].ljust(room, b"\0"))
    total = sum(map(len, frames))
    ends, at = [0], 0
    for f in frames:
        at += len(f)
        ends.append(at)
    seek = bytes(min(255, ends[k * len(frames) // 100] * 256 // max(1, total)) for k in range(100))
    shell, room = _shell(4)
    size = len(shell) + room
    table = shell + (b"Xing" + struct.pack(">III", 7, len(frames), total + size) + seek).ljust(room, b"\0")
    return _tag({"payload_bytes": str(len(payload))}) + table + b"".join(frames)


def unpack(data: bytes) -> tuple[bytes, Stream]:
    s = parse(data)
    return bodies(data, s)[: int(s.tags["payload_bytes"])], s


def padded(text: bytes) -> bytes:
    """The bytes, with zeros appended up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


# --- DataFrames ----------------------------------------------------------------------------

#: Bytes of binary values in a batch that a worker returns.
OUT_BYTES = 8 << 20


def _batches(rows: Iterator[dict], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n >= OUT_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text's UTF-8 bytes, padded, inside an MPEG stream. A null text counts as empty."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, t in zip(b.column(0), b.column(1)):
                    raw = t.as_py() or b""
                    yield {"id": i.as_py(), "n_bytes": len(raw), "media": pack(padded(raw))}

        return _batches(rows(), schema, lambda r: len(r["media"]))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


READ = "id long, n_bytes long, media_bytes long, frames long, samples long, duration_num long, duration_den long, seek_offsets array<long>, crc_checked long, crc_failed long, junk_bytes long, tags map<string,string>, vbr_kind string, vbr_frames long, vbr_bytes long, kinds string"


def read_media(media: DataFrame, keep_payload: bool = False) -> DataFrame:
    """What READ names, for every (id, n_bytes, media) row; with keep_payload also the digests of a carried payload.

    The duration is exact: samples over sample rate as a fraction in lowest terms. A null
    or empty media value, or bytes without a frame, give zero frames and duration 0/1.
    """
    more = ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string" if keep_payload else ""
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("frames", pa.int64()), ("samples", pa.int64()), ("duration_num", pa.int64()), ("duration_den", pa.int64()), ("seek_offsets", pa.list_(pa.int64())), ("crc_checked", pa.int64()), ("crc_failed", pa.int64()), ("junk_bytes", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("vbr_kind", pa.string()), ("vbr_frames", pa.int64()), ("vbr_bytes", pa.int64()), ("kinds", pa.string())]
    if keep_payload:
        fields += [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string())]
    schema = pa.schema(fields)

    def one(i, n, data: bytes) -> dict:
        if keep_payload:
            payload, s = unpack(data)
        else:
            s = parse(data)
        kind, frames, size, _ = s.table or (None, None, None, [])
        kinds = ",".join(f"mpeg{v}-layer{x}-{r}Hz-{'mono' if m else 'stereo'}" for v, x, r, m in sorted(s.kinds))
        row = {"id": i, "n_bytes": n, "media_bytes": len(data), "frames": len(s.offsets), "samples": s.samples, "duration_num": s.duration.numerator, "duration_den": s.duration.denominator, "seek_offsets": s.offsets, "crc_checked": s.checked, "crc_failed": s.failed, "junk_bytes": s.junk, "tags": list(s.tags.items()), "vbr_kind": kind, "vbr_frames": frames, "vbr_bytes": size, "kinds": kinds}
        if keep_payload:
            row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_sha256": hashlib.sha256(data).hexdigest()}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (one(i.as_py(), n.as_py(), m.as_py() or b"") for b in batches for i, n, m in zip(b.column(0), b.column(1), b.column(2)))
        return _batches(rows, schema, lambda r: 64 + 8 * len(r["seek_offsets"]))

    return media.select("id", "n_bytes", "media").mapInArrow(run, READ + more)


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as a stream, read back, with digests, a feature string of the stream, its exact duration and the offsets of its frames."""
    got = read_media(store_texts(docs), keep_payload=True)
    feature = F.concat_ws(";", F.concat(F.lit("kind="), "kinds"), F.concat(F.lit("frames="), F.col("frames")), F.concat(F.lit("duration="), F.col("duration_num"), F.lit("/"), F.col("duration_den")), F.concat(F.lit("crc="), F.col("crc_checked") - F.col("crc_failed"), F.lit("/"), F.col("crc_checked")), F.concat(F.lit("vbr="), "vbr_kind", F.lit(":"), F.col("vbr_frames")), F.concat(F.lit("seek="), F.lower(F.hex(F.xxhash64("seek_offsets")))), F.concat(F.lit("junk="), F.col("junk_bytes")))
    return got.select("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "duration_num", "duration_den", "seek_offsets")

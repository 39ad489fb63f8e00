"""MPEG audio columns: write, resynchronise, parse tags and variable-bitrate tables, check sums, seek.

A payload is stored losslessly as the ancillary data of silent layer III frames: a tag with its length and
checksum, an info frame with the variable-bitrate table, then frames protected by a checksum. The reader takes
any MPEG 1, 2 or 2.5 stream of layers I to III.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from barlens.llm.util import slices

# Fixed values of the format: kbit/s by (MPEG 1?, layer), and samples a second of MPEG 1.
KBPS = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]
VERSIONS = {0: 25, 2: 20, 3: 10}

# Fixed values of the format: bits of a layer II subband's allocation, from the lowest subband on, as (subbands, bits).
ALLOCATION = {
    "a": [(11, 4), (12, 3), (4, 2)],
    "b": [(11, 4), (12, 3), (7, 2)],
    "c": [(2, 4), (6, 3)],
    "d": [(2, 4), (10, 3)],
    "lsf": [(4, 4), (7, 3), (19, 2)],
}

#: Bytes within which the next frame of a free bitrate must begin.
FREE_BYTES = 8192
#: Bytes to which payloads are filled up.
UNIT = 64


@dataclass(frozen=True)
class Header:
    """One frame's header. `side` bytes of side information follow it and its checksum (layer III).

    A stream of free bitrate doesn't say its frames' size: there `size` is the padding alone until the stream tells.
    """

    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    mode: int
    extension: int
    size: int
    samples: int
    side: int
    free: bool

    def like(self, other: Header) -> bool:
        """Whether both can be of one stream."""
        return (self.version, self.layer, self.rate, self.free) == (other.version, other.layer, other.rate, other.free)

    def sized(self, size: int) -> Header:
        """The header of a free frame whose size without padding is known."""
        size += self.size
        return replace(self, size=size, kbps=round(8 * size * self.rate / self.samples / 1000))


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """Parse four bytes; None where they are no header."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
    at, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or at == 15 or rate == 3 or raw[3] & 3 == 2:
        return None
    first = version == 10
    hz = RATES[rate] // {10: 1, 20: 2, 25: 4}[version]
    kbps, pad, mode = KBPS[first, layer][at], raw[2] >> 1 & 1, raw[3] >> 6
    per = 12 if layer == 1 else 72 if layer == 3 and not first else 144
    size = (per * kbps * 1000 // hz + pad) * (4 if layer == 1 else 1)
    samples = {1: 384, 2: 1152, 3: 1152 if first else 576}[layer]
    side = 0 if layer != 3 else (17 if mode == 3 else 32) if first else (9 if mode == 3 else 17)
    return Header(version, layer, not raw[1] & 1, kbps, hz, 1 if mode == 3 else 2, mode, raw[3] >> 4 & 3, size, samples, side, at == 0)


@lru_cache(maxsize=65536)
def crc16(data: bytes, bits: int) -> int:
    """The frame checksum over the first `bits` bits."""
    out = 0xFFFF
    for i in range(bits):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        out = (out << 1 ^ (0x8005 if (out >> 15 ^ bit) & 1 else 0)) & 0xFFFF
    return out


@dataclass
class Stream:
    """What a stream holds. `offsets`: where each frame begins; `spans`: the bytes behind its side information."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    first: Header | None = None
    samples: int = 0
    kbps: tuple[int, int] = (0, 0)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes | list[int] = b""
    checked: int = 0
    wrong: int = 0
    skipped: int = 0
    truncated: int = 0

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        return Fraction(self.samples, self.first.rate) if self.first else Fraction(0)


def _size7(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read a leading tag's text frames, as far as they are there; where the tag ends."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + _size7(data[at + 6 : at + 10])
    pos, head = at + 10, 6 if major == 2 else 10
    if flags & 0x40 and major > 2 and len(data) >= pos + 4:
        pos += _size7(data[pos : pos + 4]) if major == 4 else 4 + int.from_bytes(data[pos : pos + 4], "big")
    while pos + head <= min(end, len(data)) and data[pos]:
        if major == 2:
            name, n = data[pos : pos + 3], int.from_bytes(data[pos + 3 : pos + 6], "big")
        else:
            name, n = data[pos : pos + 4], _size7(data[pos + 4 : pos + 8]) if major == 4 else int.from_bytes(data[pos + 4 : pos + 8], "big")
        body = data[pos + head : pos + head + n]
        if name[:1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0")
            name = name.decode("latin-1")
            tags.update({f"{name}:{key}": value.rstrip("\0")} if name in ("TXXX", "TXX") else {name: key})
        pos += head + n
    return end + (10 if major == 4 and flags & 0x10 else 0)


def _tail(data: bytes, tags: dict[str, str]) -> int:
    """Read trailing tags; where they begin."""
    end = len(data)
    if data[-128:-125] == b"TAG" and end >= 128:
        end -= 128
        for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(f"v1:{name}", value)
    if data[end - 32 : end - 24] == b"APETAGEX" and end >= 32:
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        tags["ape"] = "1"
        tags.update(_ape(data[max(0, end - size) : end - 32], count))
        end = max(0, end - size - (32 if flags >> 31 else 0))
    return end


def _ape(items: bytes, count: int) -> dict[str, str]:
    """The text items of an APE tag, as far as they are there."""
    out, pos = {}, 0
    for _ in range(min(count, len(items) // 10)):
        stop = items.find(b"\0", pos + 8)
        if stop < 0:
            break
        size, flags = struct.unpack("<II", items[pos : pos + 8])
        if flags & 6 == 0:
            out[f"ape:{items[pos + 8 : stop].decode('latin-1')}"] = items[stop + 1 : stop + 1 + size].decode("utf-8", "replace")
        pos = stop + 1 + size
    return out


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame is an info frame; if so its table is read."""
    if h.layer != 3:
        return False
    for pos in (at + 4 + h.side, at + 6 + h.side):
        kind = data[pos : pos + 4]
        if kind in (b"Xing", b"Info"):
            flags, pos = int.from_bytes(data[pos + 4 : pos + 8], "big"), pos + 8
            out.table = kind.decode()
            if flags & 1:
                out.table_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 2:
                out.table_bytes, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 4:
                out.toc = data[pos : pos + 100]
            return True
    pos = at + 36
    if data[pos : pos + 4] == b"VBRI" and len(data) >= pos + 26:
        out.table = "VBRI"
        out.table_bytes, out.table_frames, n, scale, width = struct.unpack(">IIHHH", data[pos + 10 : pos + 24])
        out.toc = [scale * int.from_bytes(data[pos + 26 + i * width : pos + 26 + (i + 1) * width], "big") for i in range(n)]
        return True
    return False


def _allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation in a layer II frame."""
    each = h.kbps // h.channels
    kind = "lsf" if h.version != 10 else ("d" if h.rate == 32000 else "c") if each <= 48 else "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for n, bits in ALLOCATION[kind] for _ in range(n)]


def _checked_bits(h: Header, body: bytes) -> int:
    """Bits behind the header and the checksum, where `body` begins, that the checksum covers."""
    if h.layer == 3:
        return 8 * h.side
    bound = 4 * (h.extension + 1) if h.mode == 1 else 32
    if h.layer == 1:
        return 4 * (bound * h.channels + 32 - bound) if h.channels == 2 else 128
    # Layer II: the allocation, and two bits for each channel of a subband that has bits.
    value, size, at, chosen = int.from_bytes(body[:64], "big"), 8 * len(body[:64]), 0, 0
    for band, bits in enumerate(_allocation(h)):
        own = h.channels if band < bound else 1
        for _ in range(own):
            at += bits
            chosen += (h.channels // own) * bool(value >> max(size - at, 0) & ((1 << bits) - 1))
    return at + 2 * chosen


def _free_size(data: bytes, pos: int, h: Header) -> int:
    """The size without padding of a free frame: the distance to the next header of its kind, if one more follows at that distance."""
    at = pos + 4 + 2 * h.protected + h.side
    while (at := data.find(b"\xff", at, pos + FREE_BYTES)) >= 0:
        near = header(data[at : at + 4])
        if near and near.like(h):
            size = at - pos - h.size
            after = at + size + near.size
            third = header(data[after : after + 4])
            if third and third.like(h) or after == len(data):
                return size
        at += 1
    return 0


def parse(data: bytes) -> Stream:
    """Read a whole stream. Bytes that belong to no frame are skipped up to the next credible header.

    What looks like a trailing tag is one only where no frame covers it. The frames of a free bitrate have the size that
    the first of them shows.
    """
    out, free = Stream(), 0
    end, closing = len(data), {}
    tail = _tail(data, closing)
    pos = _id3v2(data, 0, out.tags)
    while pos + 4 <= end:
        h = header(data[pos : pos + 4])
        if h and h.free:
            size = free or _free_size(data, pos, h)
            h = h.sized(size) if size else None
        after = pos + h.size if h else 0
        near = header(data[after : after + 4]) if h and after + 4 <= end else None
        sound = h is not None and (out.first is None or h.like(out.first)) and (near.like(h) if near else after >= end - 3 or after == tail)
        if not sound and pos == tail:
            out.tags = closing | out.tags
            break
        if not sound:
            # Not where it should be: the next byte that can begin a header.
            limit = tail if pos < tail else end
            to = data.find(b"\xff", pos + 1, limit)
            to = limit if to < 0 else to
            out.skipped += to - pos
            pos = to
            continue
        if after > end:
            out.truncated = end - pos
            break
        if h.free:
            free = free or size
        if not out.offsets and not out.table and _table(data, pos, h, out):
            out.first, pos = h, after
            continue
        body = pos + 4
        if h.protected:
            bits = _checked_bits(h, data[pos + 6 : after])
            out.checked += 1
            covered = data[pos + 2 : pos + 4] + data[pos + 6 : min(after, pos + 6 + (bits + 7) // 8)]
            out.wrong += 8 * len(covered) < 16 + bits or crc16(covered, 16 + bits) != int.from_bytes(data[pos + 4 : pos + 6], "big")
            body += 2
        if not out.offsets:
            out.first, out.kbps = h, (h.kbps, h.kbps)
        out.kbps = (min(out.kbps[0], h.kbps), max(out.kbps[1], h.kbps))
        out.offsets.append(pos)
        out.spans.append((body + h.side, after))
        out.samples += h.samples
        pos = after
    return out


@lru_cache(maxsize=64)
def _lead(kbps: int, protected: bool) -> tuple[bytes, int]:
    """Header, checksum and empty side information of a silent frame (44,100 Hz, one channel), and its room."""
    raw = bytes([0xFF, 0xFA if protected else 0xFB, KBPS[True, 3].index(kbps) << 4, 0xC0])
    h = header(raw)
    side = bytes(h.side)
    lead = raw + (crc16(raw[2:] + side, 16 + 8 * h.side).to_bytes(2, "big") if protected else b"") + side
    return lead, h.size - len(lead)


def store(payload: bytes) -> bytes:
    """A stream whose frames carry the payload: the highest bitrate, and for the rest the lowest that has room."""
    lead, room = _lead(320, True)
    frames = [lead + payload[lo : lo + room] for lo in range(0, len(payload) - room + 1, room)]
    rest = payload[len(frames) * room :]
    if rest:
        lead, room = next(x for k in KBPS[True, 3][1:] if (x := _lead(k, True))[1] >= len(rest))
        frames.append(lead + rest.ljust(room, b"\0"))
    sizes = [len(f) for f in frames]
    info, info_room = _lead(64, False)
    total = len(info) + info_room + sum(sizes)
    starts, at = [], len(info) + info_room
    for n in sizes:
        starts.append(at)
        at += n
    toc = bytes(min(255, 256 * starts[i * len(starts) // 100] // total) if starts else 0 for i in range(100))
    info += (b"Xing" + struct.pack(">III", 7, len(frames), total) + toc).ljust(info_room, b"\0")
    text = b"\0payload\0%d %08x" % (len(payload), zlib.crc32(payload))
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    n = len(tag)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + tag + info + b"".join(frames)


def load(data: bytes) -> tuple[bytes, Stream]:
    """The payload of a stored stream and what the parser found; ValueError where either checksum fails."""
    s = parse(data)
    size, crc = s.tags.get("TXXX:payload", "0 ").split(" ")
    payload = b"".join([data[a:b] for a, b in s.spans])[: int(size)]
    if s.wrong or len(payload) != int(size) or f"{zlib.crc32(payload):08x}" != crc:
        raise ValueError("the stored stream is damaged")
    return payload, s


def feature(s: Stream) -> str:
    """A stream's description in one line."""
    h = s.first
    kind = f"mpeg{h.version / 10:g} layer{h.layer} {h.rate}Hz {h.channels}ch" if h else "none"
    return f"{kind} frames={len(s.offsets)} samples={s.samples} duration={s.duration} kbps={s.kbps[0]}-{s.kbps[1]} table={s.table or 'none'}:{s.table_frames} crc={s.checked - s.wrong}/{s.checked} skipped={s.skipped} truncated={s.truncated}"


def media_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """Store every text as MPEG audio and read it back.

    One row per row of `df`: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_samples, sample_rate, seek_offsets, and with `with_bytes` the stream, media.
    A null or empty text gives 64 bytes 0; repeated rows and null ids give rows of their own; other columns are
    not read. A text is held whole, one slice at a time.
    """

    def row(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = store(raw.ljust(-(-max(len(raw), 1) // UNIT) * UNIT, b"\0"))
        payload, s = load(media)
        return len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha256(media).hexdigest(), feature(s), s.samples, s.first.rate, s.offsets, media

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_samples", "sample_rate", "seek_offsets", "media"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    n = len(kinds) - (not with_bytes)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                cols = list(zip(*map(row, part.column("text").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, t) for c, t in zip(cols[:n], kinds, strict=False))], names[: n + 1])

    sql = ["bigint", "bigint", "string", "bigint", "bigint", "string", "string", "bigint", "int", "array<bigint>", "binary"]
    schema = ", ".join(f"{a} {b}" for a, b in zip(names, [dict(df.dtypes)[id_col], *sql[:n]], strict=False))
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, schema)


def parse_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Parse a column of MPEG audio: (id, feature, n_samples, sample_rate, seek_offsets, tags); null bytes count as empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                found = [parse(x or b"") for x in part.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([feature(s) for s in found], pa.string()),
                        pa.array([s.samples for s in found], pa.int64()),
                        pa.array([s.first.rate if s.first else None for s in found], pa.int32()),
                        pa.array([s.offsets for s in found], pa.list_(pa.int64())),
                        pa.array([list(s.tags.items()) for s in found], pa.map_(pa.string(), pa.string())),
                    ],
                    ["id", "feature", "n_samples", "sample_rate", "seek_offsets", "tags"],
                )

    kind = dict(df.dtypes)[id_col]
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{media_col}` AS binary) AS media").mapInArrow(run, f"id {kind}, feature string, n_samples bigint, sample_rate int, seek_offsets array<bigint>, tags map<string,string>")

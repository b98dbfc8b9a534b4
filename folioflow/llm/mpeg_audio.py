"""Media columns of MPEG audio.

``scan_media`` reads a binary column of MPEG audio streams: it parses tags (ID3v2 ahead, ID3v1 behind), finds
frame headers again after damage, reads the variable-bitrate table of the first frame (Xing, Info or VBRI),
verifies the frames' checksums, and stores the exact duration and each frame's seek offset. ``carry_bytes``
writes any bytes as a silent Layer III stream whose frames hold them as ancillary data, and ``scan_media``
gives them back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by bitrate index, Hz by rate index.
KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Layer II: bits of an allocation by subband, for each table of ISO/IEC 11172-3 (B.2a to B.2d) and of 13818-3 (B.1).
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
SIDE = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}

BLOCK = 64
WRITER_RATE, WRITER_SAMPLES, WRITER_SIDE = 32000, 1152, 17
PAYLOAD_TAG = "folioflow payload bytes"


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The frames' checksum: polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


@lru_cache(maxsize=4096)
def _crc16_of(data: bytes) -> int:
    return crc16(data)


@lru_cache(maxsize=4096)
def header(raw: bytes) -> tuple | None:
    """(frame bytes, samples, Hz, version, layer, mono, has checksum, same stream key, joint bound) of four bytes, or None."""
    word = int.from_bytes(raw, "big")
    if len(raw) < 4 or word >> 21 != 0x7FF:
        return None
    version, layer, kbits, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or kbits in (0, 15) or rate == 3:  # index 0, the free format, has no length
        return None
    generation, hz = 1 if version == 3 else 2, RATES[version][rate]
    bits, pad, mode = KBITS[generation, layer][kbits - 1] * 1000, word >> 9 & 1, word >> 6 & 3
    samples = 384 if layer == 1 else 576 if layer == 3 and generation == 2 else 1152
    size = (12 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
    bound = 4 * ((word >> 4 & 3) + 1) if mode == 1 else 32
    return size, samples, hz, generation, layer, mode == 3, not word >> 16 & 1, (version, layer, hz), bound


def _layer2_bits(frame: bytes, h: tuple) -> str:
    """The bits of a Layer II frame that its checksum covers: the header's last half, allocations and scale factor selectors."""
    _, _, hz, generation, _, mono, _, _, bound = h
    channels = 1 if mono else 2
    each = KBITS[generation, 2][(frame[2] >> 4) - 1] // channels
    if generation == 2:
        widths = ALLOCATION["low"]
    elif each < 56:
        widths = ALLOCATION["d" if hz == 32000 else "c"]
    else:
        widths = ALLOCATION["a" if hz == 48000 or each < 96 else "b"]
    bits, at, used = f"{int.from_bytes(frame[6:], 'big'):0{8 * max(len(frame) - 6, 1)}b}", 0, 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            on = "1" in bits[at : at + width]
            at += width
            used += on * (1 if band < bound else channels)  # above the bound both channels share an allocation
    return f"{int.from_bytes(frame[2:4], 'big'):016b}" + bits[: at + 2 * used]


def _crc16_bits(bits: str) -> int:
    whole = len(bits) // 8 * 8
    crc = crc16(int(bits[:whole], 2).to_bytes(whole // 8, "big"))
    for bit in bits[whole:]:
        top = crc >> 15 ^ int(bit)
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if top else crc << 1 & 0xFFFF
    return crc


def _checked(frame: bytes, h: tuple) -> bool | None:
    """Whether the frame's checksum holds; None without one."""
    _, _, _, generation, layer, mono, has, _, bound = h
    if not has:
        return None
    stored = int.from_bytes(frame[4:6], "big")
    if layer == 2:
        return _crc16_bits(_layer2_bits(frame, h)) == stored
    if layer == 3:
        span = SIDE[generation, mono]
    else:
        span = (32 if mono else bound * 2 + (32 - bound)) * 4 // 8
    return _crc16_of(frame[2:4] + frame[6 : 6 + span]) == stored


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of the tag ahead and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    synchsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, tags = 10 + synchsafe(data[6:10]), 10, {}
    size_of = synchsafe if data[3] >= 4 else lambda b: int.from_bytes(b, "big")
    while at + 10 <= min(end, len(data)) and data[at : at + 4].isalnum():
        size = size_of(data[at + 4 : at + 8])
        body = data[at + 10 : at + 10 + size]
        if data[at : at + 1] == b"T" and body:
            kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            parts = body[1:].decode(kind, "replace").split("\0")
            if data[at : at + 4] == b"TXXX" and len(parts) > 1:
                tags[parts[0]] = parts[1]
            else:
                tags[data[at : at + 4].decode("latin-1")] = parts[0]
        at += 10 + size
    return end + 10 * (data[5] >> 4 & 1), tags


def _vbr_table(frame: bytes, h: tuple) -> dict | None:
    """Kind, frames, bytes and seek table of a Xing, Info or VBRI header."""
    at = 4 + SIDE[h[3], h[5]] + 2 * h[6] if h[4] == 3 else -1
    for base in (at, at - 2 * h[6]):
        if base > 0 and frame[base : base + 4] in (b"Xing", b"Info"):
            flags, pos, out = int.from_bytes(frame[base + 4 : base + 8], "big"), base + 8, {}
            out["kind"] = frame[base : base + 4].decode()
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[pos : pos + 4], "big")
                    pos += 4
            out["toc"] = list(frame[pos : pos + 100]) if flags & 4 else []
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", frame[46:62])
        raw = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), max(width, 1))]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def scan(data: bytes) -> dict:
    """What one stream holds. Bytes that belong to no frame or tag are skipped and counted; no input raises."""
    at, tags = _id3v2(data)
    end, start = len(data), at
    if data[-128:-125] == b"TAG" and len(data) >= 128:
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[len(data) - 128 + a : len(data) - 128 + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, value)
    out = {"n_samples": 0, "sample_rate": 0, "resync_bytes": 0, "crc_good": 0, "crc_bad": 0, "vbr": None}
    offsets, parts, stream = [], [], None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and (stream is None or h[7] == stream):
            follows = at + h[0]
            after = header(data[follows : follows + 4]) if follows + 4 <= end else None
            if follows == end or (after is not None and after[7] == h[7]) or (stream is not None and follows < end):
                frame = data[at:follows]
                first, stream = stream is None, h[7]
                out["sample_rate"] = h[2]
                good = _checked(frame, h)
                if good is not None:
                    out["crc_good" if good else "crc_bad"] += 1
                table = _vbr_table(frame, h) if first else None
                if table:
                    out["vbr"] = table
                else:
                    offsets.append(at)
                    out["n_samples"] += h[1]
                    body = 4 + 2 * h[6] + SIDE[h[3], h[5]] if h[4] == 3 else len(frame)
                    if not any(frame[4 + 2 * h[6] : body]):  # no audio: the rest is ancillary data
                        parts.append(frame[body:])
                at = follows
                continue
        step = data.find(b"\xff", at + 1, end)
        step = end if step < 0 else step
        out["resync_bytes"] += step - at
        at = step
    out["resync_bytes"] += max(0, end - max(at, start)) if at < end else 0
    payload = b"".join(parts)
    length = tags.get(PAYLOAD_TAG, "")
    known = length.isascii() and length.isdigit() and len(length) < 19
    out["payload"] = payload[: int(length)] if known else payload
    return out | {"tags": tags, "offsets": offsets}


def _writer_frames() -> list[tuple[int, bytes]]:
    """(payload bytes, head) of each silent mono frame at 32 kHz, smallest first."""
    out = []
    for i, kbits in enumerate(KBITS[1, 3]):
        head = (0x7FF << 21 | 3 << 19 | 1 << 17 | (i + 1) << 12 | 2 << 10 | 3 << 6).to_bytes(4, "big")
        head += crc16(head[2:4] + bytes(WRITER_SIDE)).to_bytes(2, "big") + bytes(WRITER_SIDE)
        out.append((WRITER_SAMPLES // 8 * kbits * 1000 // WRITER_RATE - len(head), head))
    return out


FRAMES = _writer_frames()


def carry(text: bytes) -> bytes:
    """A stream that carries the bytes, padded with zeros to a positive multiple of 64."""
    payload = text + bytes(-len(text) % BLOCK if text else BLOCK)
    room, head = FRAMES[-1]
    frames = [head + payload[i : i + room] for i in range(0, len(payload), room)]
    left = len(frames[-1]) - len(head)
    room, head = next(x for x in FRAMES if x[0] >= left)
    frames[-1] = head + frames[-1][-left:] + bytes(room - left)
    total, room, head = sum(map(len, frames)), *FRAMES[4]
    places = np.cumsum([0, *map(len, frames[:-1])])
    toc = bytes((places[np.arange(100) * len(frames) // 100] * 256 // total).astype(np.uint8))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total + len(head) + room) + toc
    value = f"\0{PAYLOAD_TAG}\0{len(payload)}".encode()
    tag = b"TXXX" + len(value).to_bytes(4, "big") + bytes(2) + value  # under 128 bytes, so the size is synchsafe
    lead = b"ID3\x04\0\0" + bytes((0, 0, len(tag) >> 7, len(tag) & 127)) + tag
    return b"".join([lead, head, table, bytes(room - len(table)), *frames])


def carry_bytes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): each whole text's UTF-8 bytes as a stream; a null text counts as empty.

    One row per input row, repeated rows and null ids included; equal texts give equal streams. An empty table gives an
    empty result; other columns are not carried. No shuffle, and a task holds one Arrow batch.
    """
    source = docs.select(F.col(id_col), F.encode(text_of(text_col), "utf-8").alias("__raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(carry, raw), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "media"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


SCAN = (
    "n_frames long, n_samples long, sample_rate int, duration_us long, resync_bytes long, crc_good long,"
    " crc_bad long, vbr_kind string, vbr_frames long, vbr_bytes long, tags map<string,string>,"
    " seek_offsets array<long>, payload binary"
)


def scan_media(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(id, media and what ``scan`` finds): one row per row of a column of MPEG audio; null media count as empty.

    ``duration_us`` is samples / rate in whole microseconds, rounded down; ``n_samples`` and ``sample_rate`` have
    it exactly. ``seek_offsets`` has the byte offset of each audio frame, so sample s is in frame s div samples a
    frame. Media without a frame have 0 frames and rate 0. ``payload`` has the ancillary data of silent frames, of a
    stream that ``carry_bytes`` wrote just the bytes it was given. Other columns are not carried. No shuffle.
    """
    source = media.select(F.col(id_col), F.coalesce(F.col(media_col), F.lit(b"")).alias("media"))
    kind = source.schema[id_col].dataType.simpleString()
    names = [id_col, "media", *(x.split()[0] for x in SCAN.split(", "))]
    text_map = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(x) for x in batch.column(1).to_pylist()]
            vbr = [x["vbr"] or {} for x in got]
            long = lambda values: pa.array(values, pa.int64())
            columns = [
                long(len(x["offsets"]) for x in got),
                long(x["n_samples"] for x in got),
                pa.array((x["sample_rate"] for x in got), pa.int32()),
                long(x["n_samples"] * 1_000_000 // max(x["sample_rate"], 1) for x in got),
                *(long(x[k] for x in got) for k in ("resync_bytes", "crc_good", "crc_bad")),
                pa.array((x.get("kind") for x in vbr), pa.string()),
                *(long(x.get(k) for x in vbr) for k in ("frames", "bytes")),
                pa.array([list(x["tags"].items()) for x in got], text_map),
                pa.array([x["offsets"] for x in got], pa.list_(pa.int64())),
                pa.array([x["payload"] for x in got], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    return source.mapInArrow(run, f"`{id_col}` {kind}, media binary, {SCAN}")


def feature() -> Column:
    """One line that sums up a scanned stream."""
    return F.concat_ws(
        ";",
        F.format_string("frames=%d", "n_frames"),
        F.format_string("samples=%d", "n_samples"),
        F.format_string("rate=%d", "sample_rate"),
        F.format_string("us=%d", "duration_us"),
        F.format_string("crc=%d/%d", "crc_good", F.col("crc_good") + F.col("crc_bad")),
        F.format_string("resync=%d", "resync_bytes"),
        F.format_string("vbr=%s,%d,%d", "vbr_kind", "vbr_frames", "vbr_bytes"),
        F.concat(F.lit("seek="), F.md5(F.array_join("seek_offsets", ","))),
    )

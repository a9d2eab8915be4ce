"""MPEG audio as a column: a writer that stores bytes losslessly in frames, and a reader.

The stream is MPEG-2 Layer III, one channel, 16 kHz, with checksums: 576 samples a
frame. An ID3v2 tag comes first, then a variable-bitrate table, then frames at
144 kbit/s that each carry 576 bytes as ancillary data behind empty main data
(a player plays silence). The reader knows every layer and version: it skips
tags, finds frames again after damage, and returns exact durations and each
frame's offset. It verifies the checksums of all three layers. An ID3v1 tag counts
only where a frame ends (or nothing is in step) and just its 128 bytes follow.

Null texts count as empty; the payload is padded to one frame at least, so each
row gives a file. Repeated rows give repeated results, an empty table none.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import together

SAMPLES = 576
UNIT = 576
#: Fixed values of the format, in kbit/s by index 1 to 14: MPEG-1 layers I, II, III, then MPEG-2 and 2.5 layer I, and layers II and III.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Fixed values of the format: Hz by version and index.
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


#: Fixed values of the format, for layer II: subbands, and (first subband, bits of its allocation), by table.
ALLOCATION = {
    "a": (27, ((0, 4), (11, 3), (23, 2))),
    "b": (30, ((0, 4), (11, 3), (23, 2))),
    "c": (8, ((0, 4), (2, 3))),
    "d": (12, ((0, 4), (2, 3))),
    "2": (30, ((0, 4), (4, 3), (11, 2))),
}


class Header(NamedTuple):
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    length: int
    samples: int
    channels: int
    #: Subbands below this are coded by channel; above, joint stereo shares them.
    bound: int = 32


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ 0x8005 if value & 0x8000 else value << 1
        out.append(value & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial x16+x15+x2+1, all ones at first."""
    value = 0xFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ _CRC[(value >> 8) ^ byte]
    return value


def crc16_bits(value: int, data: bytes, bits: int) -> int:
    """The checksum so far, carried on over the first bits of some bytes."""
    for byte in data[: bits // 8]:
        value = ((value << 8) & 0xFFFF) ^ _CRC[(value >> 8) ^ byte]
    for i in range(bits & ~7, bits):
        top = (value >> 15) ^ ((data[i // 8] >> (7 - i % 8)) & 1)
        value = ((value << 1) & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def read_header(word: int) -> Header | None:
    """The frame that 32 bits announce, or None if they are no frame header (or of a free bitrate)."""
    if word >> 21 != 0x7FF:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get((word >> 19) & 3)
    layer = 4 - ((word >> 17) & 3)
    index, rate_index = (word >> 12) & 15, (word >> 10) & 3
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3 or word & 3 == 2:
        return None
    kbits = BITRATES[1 if version == 1 else 2, layer][index - 1]
    rate, padding = RATES[version][rate_index], (word >> 9) & 1
    if layer == 1:
        length, samples = (12_000 * kbits // rate + padding) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 1 else 576
        length = samples // 8 * 1000 * kbits // rate + padding
    return Header(version, layer, not (word >> 16) & 1, kbits, rate, length, samples, 1 if (word >> 6) & 3 == 3 else 2, 4 * ((word >> 4) & 3) + 4 if (word >> 6) & 3 == 1 else 32)


def side_length(h: Header) -> int:
    """Bytes of layer III side information."""
    return (17 if h.channels == 1 else 32) if h.version == 1 else (9 if h.channels == 1 else 17)


def covered_bits(h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers: layer III's side information, layer I's allocation, layer II's allocation and scale factor selection."""
    if h.layer == 3:
        return 8 * side_length(h)
    shared = h.channels == 2
    if h.layer == 1:
        return 4 * (32 * h.channels - (32 - h.bound) * shared)
    each = h.kbits // h.channels
    if h.version != 1:
        name = "2"
    elif 56 <= each and (h.rate == 48000 or each <= 80):
        name = "a"
    elif each >= 96:
        name = "b"
    else:
        name = "d" if h.rate == 32000 else "c"
    subbands, widths = ALLOCATION[name]
    value, size, at, selections = int.from_bytes(body[:64], "big"), 8 * len(body[:64]), 0, 0
    for band in range(subbands):
        width = next(w for first, w in reversed(widths) if band >= first)
        coded = 2 if shared and band < h.bound else 1
        for _ in range(coded):
            at += width
            if at <= size and (value >> (size - at)) & ((1 << width) - 1):
                selections += 2 * (h.channels if coded == 1 else 1)
    return at + selections


def _header_bytes(index: int) -> bytes:
    """MPEG-2 layer III with a checksum, 16 kHz, one channel, at the bitrate with this index."""
    return struct.pack(">I", 0x7FF << 21 | 2 << 19 | 1 << 17 | 0 << 16 | index << 12 | 2 << 10 | 3 << 6)


_DATA = _header_bytes(13)
_DATA_LENGTH = read_header(struct.unpack(">I", _DATA)[0]).length
_TABLE = _header_bytes(7)
_TABLE_LENGTH = read_header(struct.unpack(">I", _TABLE)[0]).length
_HEAD = _DATA + struct.pack(">H", crc16(_DATA[2:] + bytes(9))) + bytes(9)
_TAIL = bytes(_DATA_LENGTH - len(_HEAD) - UNIT)


def _id3(fields: dict[str, str]) -> bytes:
    body = b"".join(b"TXXX" + struct.pack(">IH", len(v), 0) + v for k, x in fields.items() for v in [b"\x00" + k.encode("latin-1") + b"\x00" + x.encode("latin-1")])
    n = len(body)
    return b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 255 up to a positive multiple of the unit, and the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\xff"), len(raw)


def write_media(payload: bytes, n_bytes: int) -> bytes:
    frames = len(payload) // UNIT
    total = _TABLE_LENGTH + frames * _DATA_LENGTH
    seek = bytes(min(255, 256 * (_TABLE_LENGTH + i * frames // 100 * _DATA_LENGTH) // total) for i in range(100))
    table = _TABLE + struct.pack(">H", crc16(_TABLE[2:] + bytes(9))) + bytes(9) + b"Xing" + struct.pack(">III", 7, frames, total) + seek
    return b"".join((_id3({"bytes": str(n_bytes)}), table.ljust(_TABLE_LENGTH, b"\0"), *(x for i in range(frames) for x in (_HEAD, payload[i * UNIT : (i + 1) * UNIT], _TAIL))))


class Media(NamedTuple):
    """What a file holds: tags, the table's frame and byte counts (None without a table), the offset of each audio frame and those whose checksum is wrong, bytes skipped, exact duration as samples at a rate, and ancillary payload."""

    tags: dict
    table: tuple[int, int] | None
    offsets: list[int]
    damaged: list[int]
    skipped: int
    samples: int
    rate: int
    kbits: tuple[int, ...]
    payload: bytes


def _tags(data: bytes) -> tuple[dict, int]:
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    tags, at, end = {}, 10, min(len(data), 10 + size)
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        kind, n = data[at : at + 4].decode("latin-1"), struct.unpack(">I", data[at + 4 : at + 8])[0]
        value = data[at + 10 : min(end, at + 10 + n)]
        if kind == "TXXX" and value[:1] == b"\0":
            name, _, text = value[1:].partition(b"\0")
            tags[name.decode("latin-1")] = text.decode("latin-1")
        elif kind[0] == "T":
            tags[kind] = value[1:].decode("latin-1" if value[:1] == b"\0" else "utf-16", "replace")
        at += 10 + n
    return tags, 10 + size


def read_media(data: bytes, unit: int = UNIT) -> Media:
    """Every frame of a file. A header counts if it goes on as the frame before began, or if another of its kind, the end or a tag follows its frame."""
    tags, at = _tags(data)
    end = len(data)
    tag = end - 128 if data[-128:-125] == b"TAG" else -1
    start, table, offsets, damaged, parts, kinds = at, None, [], [], [], set()
    skipped = samples = rate = 0
    seen: dict[bytes, Header | None] = {}
    checked: dict[bytes, bool] = {}

    def header(i: int) -> Header | None:
        key = data[i : i + 4]
        if key not in seen:
            seen[key] = read_header(int.from_bytes(key, "big")) if len(key) == 4 else None
        return seen[key]

    synced, kind = False, 0
    while at + 4 <= end:
        if at == tag:
            end = tag
            break
        h = header(at)
        after = at + h.length if h else 0
        # Sync, version, layer, protection, rate and channels stay the same in a stream.
        own = int.from_bytes(data[at : at + 4], "big") & 0xFFFF0CC0
        if h and after <= end and not (synced and own == kind):
            follows = header(after) if after < end else None
            if after not in (end, tag) and not (follows and (follows.version, follows.layer, follows.rate) == (h.version, h.layer, h.rate)):
                h = None
        if not h or after > end:
            synced = False
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            following = tag if at < tag < following else following
            skipped += following - at
            at = following
            continue
        synced, kind, rate = True, own, h.rate
        body = at + 4 + 2 * h.protected
        side = body + (side_length(h) if h.layer == 3 else 0)
        if h.layer == 3 and not offsets and table is None and data[side : side + 4] in (b"Xing", b"Info"):
            flags = struct.unpack(">I", data[side + 4 : side + 8])[0]
            counts = struct.unpack(">II", data[side + 8 : side + 16]) if flags & 3 == 3 else (0, 0)
            table = counts
            at = after
            continue
        if h.protected:
            bits = covered_bits(h, data[body:after])
            covered = data[at + 2 : body] + data[body : body + (bits + 7) // 8]
            if covered not in checked:
                checked[covered] = body + bits / 8 <= after and crc16_bits(crc16(covered[:2]), covered[4:], bits) == int.from_bytes(covered[2:4], "big")
            if not checked[covered]:
                damaged.append(len(offsets))
        offsets.append(at)
        samples += h.samples
        kinds.add(h.kbits)
        parts.append(data[side : side + unit])
        at = after
    skipped += max(0, end - at) if start <= end else 0
    return Media(tags, table, offsets, damaged, skipped, samples, rate, tuple(sorted(kinds)), b"".join(parts))


OUTPUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA = "media binary, n_bytes long, samples long, rate int, seek_offsets array<long>, damaged array<long>, skipped long"


def encode_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (doc_id, text) to (doc_id, media): the files themselves, those of about a megabyte of text at a time."""
    for batch in batches:
        for s in together(batch["text"]):
            part = batch.slice(s.start, s.stop - s.start)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([write_media(*payload_of(t.as_py())) for t in part["text"]], pa.binary())], names=["doc_id", "media"])


def digest_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (doc_id, media) to the rows of ``OUTPUT``, from the stored bytes alone."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, media in zip(batch["doc_id"].to_pylist(), batch["media"], strict=True):
            data = media.as_py()
            m = read_media(data)
            feature = {
                "duration": f"{m.samples}/{m.rate}",
                "frames": len(m.offsets),
                "first": m.offsets[0] if m.offsets else None,
                "seek": zlib.crc32(struct.pack(f"<{len(m.offsets)}q", *m.offsets)),
                "kbits": m.kbits,
                "table": m.table,
                "damaged": len(m.damaged),
                "skipped": m.skipped,
                "zero": m.payload.count(0),
                "mean": round(sum(m.payload) / max(1, len(m.payload)), 6),
            }
            rows.append((doc_id, int(m.tags["bytes"]), len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), json.dumps(feature)))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def inspect_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (id, media) to durations, seek offsets, damage: any MPEG audio files."""
    for batch in batches:
        found = [read_media(m.as_py() or b"") for m in batch["media"]]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.array([m.samples for m in found], pa.int64()), pa.array([m.rate for m in found], pa.int32()), pa.array([m.offsets for m in found], pa.list_(pa.int64())), pa.array([m.damaged for m in found], pa.list_(pa.int64())), pa.array([m.skipped for m in found], pa.int64())],
            names=["id", "samples", "rate", "seek_offsets", "damaged", "skipped"],
        )


def media_files(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode_media, "doc_id long, media binary")


def media_index(files: DataFrame, key: str, media: str) -> DataFrame:
    """Duration, seek offsets and damage of a column of files."""
    return files.select(F.col(key).cast("long").alias("id"), F.col(media).alias("media")).mapInArrow(inspect_media, "id long, samples long, rate int, seek_offsets array<long>, damaged array<long>, skipped long")


def media_digests(docs: DataFrame) -> DataFrame:
    """Writes each text as a file, reads it back and describes it. Memory holds a few files at a time.

    Both steps run in one Python task, so that no file goes through the JVM.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: digest_media(encode_media(batches)), OUTPUT)

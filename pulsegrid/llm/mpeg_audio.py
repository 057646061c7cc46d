"""Media columns: MPEG audio (layer III) streams written, read back and indexed.

``encode`` stores bytes losslessly in a variable-bitrate stream: an ID3v2 tag, a frame with the table of a variable
bitrate (Xing), and frames of silence (all side information zero) whose ancillary bytes, which decoders skip, hold the
payload. Every frame has a checksum. ``parse`` reads any layer I, II or III stream: it skips ID3v2 tags, finds frame
headers again after damage (a header counts if the next one or the end follows at its distance, or its checksum is right), reads Xing,
Info and VBRI tables, verifies the CRC-16 (layer III: header and side information; layer I: header and bit allocation;
layer II: the scale factor selection, too), and gives the exact duration (samples over
sampling rate, as integers) and the byte offset of every frame for seeking. It reads on from left to right only.

Defined results: a null or empty text is one block of blanks; equal texts give equal values; repeated rows are stored
each; an empty table gives an empty result; other columns of the input are left behind. Bytes that are no stream give
no frames.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.common import map_arrow

BLOCK = 192
#: Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1?, layer) and header index; Hz by version.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def crc16(data: bytes, crc: int = 0xFFFF, bits: int | None = None) -> int:
    """CRC-16 with polynomial 0x8005, most significant bit first, over all or the first ``bits`` bits."""
    for i in range(8 * len(data) if bits is None else bits):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ bit) & 1 else 0)) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    protected: bool
    kbits: int
    hertz: int
    size: int
    samples: int
    side: int  # bytes of side information (layer III)
    channels: int = 2
    bound: int = 32  # first subband whose allocation the channels share (layers I and II, joint stereo)


_headers: dict[bytes, Header | None] = {}


def read_header(raw: bytes) -> Header | None:
    """The header in four bytes, or None. Kept by value: streams have few different ones."""
    if raw not in _headers:
        if len(_headers) > 10_000:
            _headers.clear()
        _headers[raw] = _read_header(raw)
    return _headers[raw]


def _read_header(raw: bytes) -> Header | None:
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or raw[3] & 3 == 2:
        return None
    kbits, hertz, padding = KBITS[version == 3, layer][rate], HERTZ[version][hz], raw[2] >> 1 & 1
    if layer == 1:
        size, samples = (12000 * kbits // hertz + padding) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        size = samples // 8 * 1000 * kbits // hertz + padding
    mono = raw[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    bound = (raw[3] >> 4 & 3) * 4 + 4 if raw[3] >> 6 == 1 else 32
    return Header(version, layer, not raw[1] & 1, kbits, hertz, size, samples, side, 1 if mono else 2, bound)


@dataclass
class Stream:
    frames: list[int] = field(default_factory=list)  # byte offsets
    samples: int = 0
    hertz: int = 0
    bad_checksums: int = 0
    skipped: int = 0  # bytes between frames
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None  # the variable-bitrate table
    kbits: dict[int, int] = field(default_factory=dict)  # frames by bitrate
    bodies: list[memoryview] = field(default_factory=list)  # what follows header, checksum and side information

    @property
    def milliseconds(self) -> int:
        return self.samples * 1000 // self.hertz if self.hertz else 0


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_tag(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """Bytes of an ID3v2 tag at this place (0: none) and its text fields (2.3 and 2.4)."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return 0, {}
    major, end, p, fields = data[at + 3], at + 10 + _syncsafe(data[at + 6 : at + 10]), at + 10, {}
    while major in (3, 4) and p + 10 <= min(end, len(data)) and data[p]:
        name, raw = data[p : p + 4], data[p + 4 : p + 8]
        n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[p + 10 : min(p + 10 + n, end)]
        if name[:1] == b"T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            fields[name.decode("latin-1")] = body[1:].decode(coding, "replace").rstrip("\0")
        p += 10 + n
    return end - at, fields


def read_table(frame: bytes, h: Header) -> dict | None:
    """The Xing, Info or VBRI table in a frame: kind, frames, bytes and seek points."""
    p = 4 + 2 * h.protected + h.side
    for at in {p, 4 + h.side}:
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            out: dict = {"kind": frame[at : at + 4].decode()}
            flags, q = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[q : q + 4], "big")
                    q += 4
            if flags & 4:
                out["toc"] = list(frame[q : q + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n_bytes, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        points = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "toc": points}
    return None


def allocation_bits(h: Header) -> list[int]:
    """Fixed values of ISO/IEC 11172-3 (tables B.2a to B.2d) and 13818-3 (B.1): bits of the allocation of each subband."""
    if h.layer == 1:
        return [4] * 32
    if h.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    rate = h.kbits // h.channels
    if rate <= 48:
        return [4] * 2 + [3] * (10 if h.hertz == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if h.hertz == 48000 or rate <= 80 else 7)


def covered_bits(data: bytes, h: Header) -> int:
    """Bits behind the checksum that it covers in a layer I or II frame: bit allocation, and scale factor selection in II."""
    p = selected = 0
    word = int.from_bytes(data, "big") if h.layer == 2 else 0
    for band, width in enumerate(allocation_bits(h)):
        for _ in range(h.channels if band < h.bound else 1):
            if h.layer == 2 and word >> max(8 * len(data) - p - width, 0) & (1 << width) - 1:
                selected += 1 if band < h.bound else h.channels
            p += width
    return p + 2 * selected


_checks: dict[bytes, int] = {}


def _checked(data: bytes, at: int, h: Header) -> bool:
    if h.layer == 3:
        body, bits = data[at + 6 : at + 6 + h.side], 8 * h.side
    else:
        body = data[at + 6 : at + min(h.size, 6 + 48)]  # 32 subbands of 2 channels: 4 + 2 bits each at most
        bits = min(covered_bits(body, h), 8 * len(body))
    covered = data[at + 2 : at + 4] + body
    key = covered + bits.to_bytes(2, "big")
    if key not in _checks:
        if len(_checks) > 10_000:
            _checks.clear()
        _checks[key] = crc16(covered, bits=16 + bits)
    return _checks[key] == int.from_bytes(data[at + 4 : at + 6], "big")


#: What a frame header or a tag can begin with.
_MARK = re.compile(rb"\xff[\xe2-\xff]|ID3|TAG")


def parse(data: bytes) -> Stream:
    out, p, n, view = Stream(), 0, len(data), memoryview(data)
    while p < n:
        h = read_header(data[p : p + 4])
        after = p + h.size if h else 0
        follows = h and after <= n and (after == n or data[after : after + 3] in (b"TAG", b"ID3") or read_header(data[after : after + 4]))
        if follows or h and after <= n and h.protected and _checked(data, p, h):
            if not out.frames and out.table is None and (found := read_table(data[p:after], h)):
                out.table = found
            else:
                if h.protected and not _checked(data, p, h):
                    out.bad_checksums += 1
                out.frames.append(p)
                out.samples += h.samples
                out.hertz = out.hertz or h.hertz
                out.kbits[h.kbits] = out.kbits.get(h.kbits, 0) + 1
                out.bodies.append(view[p + 4 + 2 * h.protected + h.side : after])
            p = after
            continue
        if data[p : p + 3] == b"ID3" and (size := read_tag(data, p))[0]:
            out.tags |= size[1]
            p += size[0]
            continue
        if data[p : p + 3] == b"TAG" and n - p == 128:
            out.tags.setdefault("TIT2", data[p + 3 : p + 33].rstrip(b"\0 ").decode("latin-1"))
            p = n
            continue
        far = _MARK.search(data, p + 1)
        q = far.start() if far else n
        out.skipped += q - p
        p = q
    return out


def _frame_kinds() -> dict[int, tuple[bytes, int]]:
    """By blocks of payload: what a frame begins with (48 kHz, mono, protected, silent) and its size."""
    kinds = {}
    for blocks, kbits in ((1, 80), (2, 160), (4, 320)):
        header = bytes((0xFF, 0xFA, KBITS[True, 3].index(kbits) << 4 | 1 << 2, 0xC0))
        side = bytes(17)
        kinds[blocks] = header + crc16(header[2:] + side).to_bytes(2, "big") + side, 144 * kbits * 1000 // 48000
    return kinds


_KINDS = _frame_kinds()


def pad(text: str | None, block: int = BLOCK) -> bytes:
    """UTF-8, filled with blanks to a positive multiple of the block."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % block or (0 if raw else block))


def encode(payload: bytes, title: str = "payload") -> bytes:
    """A stream with this payload (a multiple of 192 bytes): four blocks to a frame, then two, then one."""
    if len(payload) % BLOCK or not payload:
        raise ValueError("the payload must be a positive multiple of the block")
    frames, p = [], 0
    for blocks in (4, 2, 1):
        head, size = _KINDS[blocks]
        n, tail = blocks * BLOCK, bytes(size - len(head) - blocks * BLOCK)
        while len(payload) - p >= n:
            frames.append(b"".join((head, payload[p : p + n], tail)))
            p += n
    ends = np.cumsum([0, *map(len, frames)])
    total = int(ends[-1]) + _KINDS[4][1]
    points = [min(255, int(ends[len(frames) * i // 100] + _KINDS[4][1]) * 256 // total) for i in range(100)]
    head, size = _KINDS[4]
    xing = head + b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(points)
    text = b"\3" + title.encode()
    syncsafe = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    tag = b"TIT2" + syncsafe(len(text)) + b"\0\0" + text
    id3 = b"ID3\4\0\0" + syncsafe(len(tag)) + tag
    return b"".join((id3, xing, bytes(size - len(xing)), *frames))


def payload_of(stream: Stream) -> bytes:
    """The payload of a stream that ``encode`` wrote."""
    blocks = {kinds[1] - len(kinds[0]): n for n, kinds in _KINDS.items()}
    return b"".join(x[: blocks[len(x)] * BLOCK] for x in stream.bodies if len(x) in blocks)


def features(stream: Stream) -> str:
    """Exact duration, frames by bitrate, checks and a digest of the seek offsets, as JSON."""
    offsets = np.array(stream.frames, "<u8").tobytes()
    return json.dumps(
        {
            "ms": stream.milliseconds, "samples": stream.samples, "hertz": stream.hertz, "frames": len(stream.frames),
            "kbits": {str(k): v for k, v in sorted(stream.kbits.items())}, "bad_checksums": stream.bad_checksums, "skipped": stream.skipped,
            "table": (stream.table or {}).get("kind"), "table_frames": (stream.table or {}).get("frames"), "seek_first": stream.frames[0] if stream.frames else None, "seek_crc32": zlib.crc32(offsets),
        },
        separators=(",", ":"),
    )


def media(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = True, with_offsets: bool = True) -> DataFrame:
    """One row a document: sizes and digests of payload and stream, features and, if wanted, the stream and its seek offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = []
                for text in part.column(1).to_pylist():
                    stored = encode(pad(text))
                    stream = parse(stored)
                    back = payload_of(stream)
                    row = [len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(stream)]
                    rows.append(row + [stored] * with_media + [stream.frames] * with_offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["key", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media + ["seek_offsets"] * with_offsets
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_media + [pa.list_(pa.int64())] * with_offsets
    kind = docs.schema[key].dataType.simpleString()
    sql = ["bigint", "bigint", "string", "bigint", "bigint", "string", "string"] + ["binary"] * with_media + ["array<bigint>"] * with_offsets
    out = map_arrow(docs.select(key, text), run, f"key {kind}, " + ", ".join(f"{a} {b}" for a, b in zip(names, sql, strict=True)))
    return out.withColumnRenamed("key", key)

"""Media columns: find what a binary value holds, whatever its declared type says.

An Aho-Corasick automaton over the known magic bytes finds every place a file may begin; a validator for that
format then walks its structure (chunks, pages, boxes, checksums) and gives the length, or refuses. What starts at
byte 0 corrects the declared type; whatever else is confirmed is embedded media that carve() cuts out.

Nulls and empty values hold no media: type null. A value whose bytes fit no format keeps its declared type.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm.common import arrow_map, documents, texts

# Magic bytes of the formats, with their distance from the beginning of the file.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"II*\x00", 0, "image/tiff"),
    (b"MM\x00*", 0, "image/tiff"),
    (b"RIFF", 0, "riff"),
    (b"OggS", 0, "audio/ogg"),
    (b"fLaC", 0, "audio/flac"),
    (b"ID3", 0, "audio/mpeg"),
    (b"ftyp", 4, "video/mp4"),
    (b"\x1aE\xdf\xa3", 0, "video/webm"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]
RIFF_KINDS = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    length: int


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, p)
        name, end = b[p + 4 : p + 8], p + 12 + n
        if end > len(b) or (first and (name != b"IHDR" or n != 13)) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        if name == b"IEND":
            return end - at
        p, first = end, False
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags, p = b[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while p < len(b):
        tag = b[p]
        if tag == 0x3B:
            return p + 1 - at
        if tag == 0x21:
            p += 2
        elif tag == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            p += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        mark = b[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        if mark == 0xD9:
            return p + 2 - at
        if mark < 0xC0 or 0xD0 <= mark <= 0xD8:
            return 0
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if mark == 0xDA:  # entropy-coded data: up to a marker that is neither stuffed nor a restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, zero, pixels, head = struct.unpack_from("<IIII", b, at + 2)
    return size if not zero and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= pixels <= size <= len(b) - at else 0


def _tiff(b: bytes, at: int) -> int:
    end = "<" if b[at : at + 1] == b"I" else ">"
    if at + 8 > len(b):
        return 0
    (p,), last, seen = struct.unpack_from(end + "I", b, at + 4), 8, set()
    while p:
        if p in seen or p < 8 or at + p + 2 > len(b):
            return 0
        seen.add(p)
        (n,) = struct.unpack_from(end + "H", b, at + p)
        if not n or at + p + 6 + 12 * n > len(b):
            return 0
        for i in range(n):
            _, kind, count, where = struct.unpack_from(end + "HHII", b, at + p + 2 + 12 * i)
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}.get(kind, 0) * count
            if size > 4:
                if at + where + size > len(b):
                    return 0
                last = max(last, where + size)
        last = max(last, p + 6 + 12 * n)
        (p,) = struct.unpack_from(end + "I", b, at + p + 2 + 12 * n)
    return last


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in RIFF_KINDS:
        return 0
    (size,) = struct.unpack_from("<I", b, at + 4)
    end, p = at + 8 + size, at + 12
    if end > len(b) or size < 4:
        return 0
    while p + 8 <= end:
        (n,) = struct.unpack_from("<I", b, p + 4)
        p += 8 + n + (n & 1)
    return end - at if p in (end, end + 1) else 0


def _ogg(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b):
            return 0
        last, p = b[p + 5] & 4, end
        if last:
            break
    return p - at


def _flac(b: bytes, at: int) -> int:
    p, first = at + 4, True
    while p + 4 <= len(b):
        kind, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind & 0x7F or n != 34) or p + 4 + n > len(b):
            return 0
        p, first = p + 4 + n, False
        if kind & 0x80:  # the frames go to the end of the value
            return len(b) - at if p == len(b) or b[p] == 0xFF else 0
    return 0


def _id3(b: bytes, at: int) -> int:
    if at + 10 > len(b) or b[at + 3] not in (2, 3, 4) or any(x & 0x80 for x in b[at + 6 : at + 10]):
        return 0
    n = 10 + (b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9])
    return len(b) - at if at + n + 2 <= len(b) and b[at + n] == 0xFF and b[at + n + 1] & 0xE0 == 0xE0 else 0


def _mp4(b: bytes, at: int) -> int:
    p = at
    while p + 8 <= len(b):
        (n,) = struct.unpack_from(">I", b, p)
        name = b[p + 4 : p + 8]
        if n == 1 and p + 16 <= len(b):
            (n,) = struct.unpack_from(">Q", b, p + 8)
        if n < 8 or p + n > len(b) or not re.fullmatch(rb"[A-Za-z0-9 \xa9]{4}", name):
            break
        p += n
    return p - at


def _webm(b: bytes, at: int) -> int:
    p = at
    for name in (b"\x1aE\xdf\xa3", b"\x18S\x80g"):
        if b[p : p + 4] != name or p + 5 > len(b) or not b[p + 4]:
            return 0
        width = 9 - b[p + 4].bit_length()
        n = int.from_bytes(b[p + 4 : p + 4 + width], "big") ^ 1 << 7 * width
        if n == (1 << 7 * width) - 1:
            return len(b) - at
        p += 4 + width + n
        if p > len(b):
            return 0
    return p - at


def _pdf(b: bytes, at: int) -> int:
    if not re.match(rb"%PDF-\d\.\d", b[at : at + 8]):
        return 0
    again = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, again if again > 0 else len(b))
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


def _zip(b: bytes, at: int) -> int:
    p = at
    while (p := b.find(b"PK\x05\x06", p + 1)) > 0 and p + 22 <= len(b):
        size, where, note = struct.unpack_from("<IIH", b, p + 12)
        if at + where + size == p and p + 22 + note <= len(b):
            return p + 22 + note - at
    return 0


def _gzip(b: bytes, at: int) -> int:
    d, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not d.eof:  # in steps: what it unpacks to is not kept
            d.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(d.unused_data) - at if d.eof else 0


VALIDATORS: dict[str, Callable[[bytes, int], int]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "image/tiff": _tiff, "riff": _riff, "audio/ogg": _ogg, "audio/flac": _flac,
    "audio/mpeg": _id3, "video/mp4": _mp4, "video/webm": _webm, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, back, kind in MAGIC:
        out.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
    out.make_automaton()
    return out


def sniff(blob: bytes | None, machine: ahocorasick.Automaton) -> list[Found]:
    """Every confirmed file in blob, by start; one that runs on from a page of the last one is not told again."""
    found: list[Found] = []
    ends: dict[str, int] = {}
    for last, (back, kind) in machine.iter((blob or b"").decode("latin-1")):
        at = last - back
        if at < 0 or kind == "audio/ogg" and at < ends.get(kind, 0):
            continue
        if n := VALIDATORS[kind](blob, at):
            ends[kind] = at + n
            found.append(Found(RIFF_KINDS[blob[at + 8 : at + 12]] if kind == "riff" else kind, at, n))
    return sorted(found, key=lambda f: (f.start, -f.length, f.kind))


def carve(blob: bytes, found: Found) -> bytes:
    return blob[found.start : found.start + found.length]


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """payload as unsigned 8-bit mono samples; its length must be even."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def wav_samples(wav: bytes) -> bytes:
    """The bytes of the data chunk, found by walking the chunks."""
    p = 12
    while p + 8 <= len(wav):
        (n,) = struct.unpack_from("<I", wav, p + 4)
        if wav[p : p + 4] == b"data":
            return wav[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


SNIFFED = "declared string, kind string, corrected boolean, n_media int, media array<struct<kind:string,start:bigint,length:bigint>>"


def sniff_column(df: DataFrame, blob: str, declared: str, key: str) -> DataFrame:
    """(key, declared, kind, corrected, n_media, media) for each row; kind null where the value is null or empty."""

    def make():
        machine = automaton()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for k, b, d in zip(*(c.to_pylist() for c in batch.columns)):
                found = sniff(b, machine)
                kind = None if not b else found[0].kind if found and not found[0].start else d
                rows.append({"key": k, "declared": d, "kind": kind, "corrected": kind != d, "n_media": len(found), "media": [vars(f) for f in found]})
            names = ["key", "declared", "kind", "corrected", "n_media", "media"]
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

        return each

    src = df.selectExpr(f"`{key}` AS key", f"CAST(`{blob}` AS BINARY) AS blob", f"CAST(`{declared}` AS STRING) AS declared")
    return arrow_map(src, make, f"key {src.schema['key'].dataType.simpleString()}, {SNIFFED}", "blob").withColumnRenamed("key", key)


UNIT = 64
DECLARED = "application/octet-stream"


def stored_texts(df: DataFrame) -> DataFrame:
    """Each text stored as 8-bit samples under a type that says nothing, then found, read back and measured.

    Null is the empty text, whose payload is 64 zero bytes. Equal texts give equal values; rows are independent.
    """

    def make():
        machine = automaton()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for raw in texts(batch.column(1)):
                media = to_wav(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0"))
                found = sniff(media, machine)
                top, rest = found[0], found[1:]
                samples = wav_samples(carve(media, top))
                feature = f"{top.kind};was={DECLARED};length={top.length};embedded={','.join(f'{f.kind}@{f.start}+{f.length}' for f in rest)}"
                out.append((len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, top.kind, len(rest)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "n_embedded"]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=["doc_id", *names])

        return each

    return arrow_map(documents(df), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_embedded int")

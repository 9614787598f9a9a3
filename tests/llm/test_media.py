import hashlib
import io
import struct
import zipfile
import zlib

from panelspark.llm import media


def png() -> bytes:
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif() -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def zipped() -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


def gz() -> bytes:
    c = zlib.compressobj(wbits=31)
    return c.compress(b"x" * 1000) + c.flush()


def ogg() -> bytes:
    return b"OggS\0\4" + b"\0" * 20 + bytes([1, 3]) + b"abc"


FILES = {
    "image/png": png(), "image/gif": gif(), "application/zip": zipped(), "application/gzip": gz(), "audio/wav": media.to_wav(b"\0" * 64), "audio/ogg": ogg(),
    "image/bmp": b"BM" + struct.pack("<IIIIii", 58, 0, 54, 40, 1, 1) + b"\0" * 32, "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF", "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02data\xff\0\xff\xd9",
    "image/tiff": b"II*\0" + struct.pack("<IHHHIII", 8, 1, 256, 3, 1, 1, 0), "audio/flac": b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"\xff\xf8", "audio/mpeg": b"ID3\3\0\0\0\0\0\0\xff\xfb\x90\0",
    "video/mp4": struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"moov", "video/webm": b"\x1aE\xdf\xa3\x81a\x18S\x80g\x82bc", "image/webp": b"RIFF" + struct.pack("<I", 12) + b"WEBPVP8 \0\0\0\0",
}


def test_each_format_is_found_and_measured():
    m = media.automaton()
    for kind, blob in FILES.items():
        first = media.sniff(blob, m)[0]
        assert (first.kind, first.start, first.length) == (kind, 0, len(blob)), kind


def test_broken_files_are_refused():
    m = media.automaton()
    for kind, blob in FILES.items():
        if kind in ("application/pdf", "application/zip", "image/bmp", "image/png", "audio/wav", "application/gzip", "image/gif", "image/tiff"):
            assert not [f for f in media.sniff(blob[:-1], m) if f.start == 0 and f.kind == kind], kind
    assert media.sniff(b"BM RIFF OggS PK\3\4 just words", m) == []


def test_embedded_files_are_carved():
    m = media.automaton()
    blob = b"junk" + png() + b"between" + zipped() + b"end"
    found = media.sniff(blob, m)
    assert [media.carve(blob, f) for f in found] == [png(), zipped()]


def test_declared_types_are_corrected(spark):
    rows = [(1, png(), "image/gif"), (2, gif(), "image/gif"), (3, b"text", "text/plain"), (4, None, "image/png"), (5, b"", None)]
    df = spark.createDataFrame(rows, "id long, blob binary, declared string")
    got = {r.id: r for r in media.sniff_column(df, "blob", "declared", "id").collect()}
    assert (got[1].kind, got[1].corrected) == ("image/png", True) and (got[2].kind, got[2].corrected) == ("image/gif", False)
    assert got[3].kind == "text/plain" and got[4].kind is None and got[5].n_media == 0


def test_stored_texts(odd, odd_rows, empty):
    got = media.stored_texts(odd).collect()
    assert len(got) == len(odd_rows) and media.stored_texts(empty).count() == 0
    for r in got:
        raw = next((t or "").encode() for d, t, *_ in odd_rows if d == r.doc_id and len((t or "").encode()) == r.n_bytes)
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest() and r.media_type == "audio/wav" and r.feature.startswith("audio/wav;")

"""Signature sniffing: true types, carved media, and what must not be taken for media."""

import gzip
import io
import struct
import time
import zipfile
import zlib

import pytest

from cohortlake.llm import media


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
    return out.getvalue()


def bmp():
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xd9"
GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"


def ogg_page(body, last):
    page = b"OggS\0" + bytes([4 * last]) + b"\0" * 20 + bytes([1, len(body)]) + body
    crc = 0
    for x in page:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return page[:22] + struct.pack("<I", crc) + page[26:]


OGG = ogg_page(b"abc", False) + ogg_page(b"defg", True)
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n2 0 obj\nendobj\nstartxref\n40\n%%EOF"
WHOLE = {"image/png": png(), "image/jpeg": JPEG, "image/gif": GIF, "image/bmp": bmp(), "audio/wav": media.wav(b"abcd"), "audio/ogg": OGG, "application/pdf": PDF, "application/gzip": gzip.compress(b"hello"), "application/zip": archive()}


def test_every_format_alone_embedded_and_cut():
    for kind, blob in WHOLE.items():
        assert (0, len(blob), kind) in media.carve(blob), kind
        assert (7, len(blob), kind) in media.carve(b"padding" + blob + b"tail"), kind
        assert not any(at == 0 and t == kind and n > len(blob) - 20 for at, n, t in media.carve(blob[:-2])), kind  # an older state of a document may end earlier


def test_words_are_no_media():
    assert media.carve(b"BM GIF89a RIFF....WAVEfmt PK\x03\x04 %PDF- \x1f\x8b\x08 OggS\0 text with magic words " * 20) == []


def test_damaged_pages_and_two_files_behind_one_another():
    broken = bytearray(OGG)
    broken[30] ^= 1
    assert not any(t == "audio/ogg" and at == 0 for at, _, t in media.carve(bytes(broken)))
    two = archive() + b"between" + archive() + PDF + PDF
    n = len(archive())
    assert {(0, n, "application/zip"), (n + 7, n, "application/zip"), (2 * n + 7, len(PDF), "application/pdf"), (2 * n + 7 + len(PDF), len(PDF), "application/pdf")} <= set(media.carve(two))


@pytest.mark.parametrize("unit", [b"%PDF- ", b"PK\x03\x04", b"\x1f\x8b\x08\0\0\0\0\0\0\0", b"OggS\0\0", b"\xff\xd8\xff\xda\0\2", b"GIF89a", b"BM", b"RIFF", b"\x89PNG\r\n\x1a\n", b"%PDF- obj startxref %%EOF", b"PK\3\4PK\5\6"])
def test_blobs_full_of_magic_bytes_take_time_by_length(unit):
    began = time.process_time()
    media.carve(unit * (1_500_000 // len(unit)))
    assert time.process_time() - began < 20


def nested_riff(n):
    """Sounds inside each other's chunk walk, all of which end where the blob does."""
    out = bytearray(b"RIFF\0\0\0\0WAVEfmt \0\0\0\0" * n + b"\0" * (8 * n))
    for at in range(0, 20 * n, 20):
        struct.pack_into("<I", out, at + 4, len(out) - at - 8)
    return bytes(out)


def test_nested_headers_take_time_by_length():
    header = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + b"\0" * 13 + struct.pack(">I", zlib.crc32(b"IHDR" + b"\0" * 13))
    blobs = [nested_riff(30_000), (header + struct.pack(">I", 900_000) + b"IDAT") * 20_000, b"GIF89a\x01\0\x01\0\0\0\0\x21\xff" * 100_000, b"\xff\xd8\xff\xe0\0\2\xff\xda\0\2" * 100_000 + b"a" * 300_000]
    began = time.process_time()
    found = [len(media.carve(b)) for b in blobs]
    assert time.process_time() - began < 20
    assert found == [30_000, 0, 0, 0]
    assert [n for _, n, _ in media.carve(nested_riff(4))] == [112, 92, 72, 52]


def test_check_sums_of_stretches():
    data = bytes(i * i % 251 for i in range(60_000))
    blob = media.Blob(data)
    for start, end in [(0, 0), (0, 10), (5, 50_000), (4096, 20_000), (123, 4096 * 9 + 7), (0, 8192), (1, 8194), (59_999, 60_000), (17, 60_000)]:
        assert media._crc(blob, start, end) == zlib.crc32(data[start:end])


def test_sniffed_column(spark):
    rows = [(1, WHOLE["image/png"], "audio/wav"), (2, b"plain", "text/plain"), (3, b"", "image/gif"), (4, None, "image/gif"), (5, media.wav(b"x" * 10 + png() + b"y"), None), (5, b"plain", None)]
    df = spark.createDataFrame([(*r, "extra", "old") for r in rows], "doc_id int, media binary, declared_type string, embedded string, start string")
    got = [(r["doc_id"], r["media_type"], [(x["start"], x["media_type"]) for x in r["_embedded"]], r["embedded"] + r["start"]) for r in media.sniff(df).collect()]
    assert got == [(1, "image/png", [], "extraold"), (2, "text/plain", [], "extraold"), (3, None, [], "extraold"), (4, None, [], "extraold"), (5, "audio/wav", [(54, "image/png")], "extraold"), (5, None, [], "extraold")]
    assert media.sniff(df.limit(0)).count() == 0


def test_payload_comes_back(spark, tmp_path):
    texts = [None, "", "a" * 191, "b" * 192, "c" * 193, "naïve 🙂", "x" * 70_000, "naïve 🙂"]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path))
    got = {r["doc_id"]: r for r in media.op6_media_sniffing(spark, str(tmp_path)).collect()}
    import hashlib

    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[5][2:] == got[7][2:]

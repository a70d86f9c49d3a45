"""Media columns: what a blob really is, by signatures and structure, and what is embedded in it.

An Aho-Corasick automaton finds all magic bytes of a blob in one pass. Behind each hit a validator of that format walks
the structure (chunk and block lengths, check sums, end markers); only what holds together counts, with its true length.
What starts at offset 0 corrects the declared type; what lies further in is carved out. Text that merely contains magic
bytes has no such structure and yields nothing.

No validator copies the rest of a blob or searches it again at each hit: places of end markers are found once, and what is
known of a place is kept, so a blob full of magic bytes, nested or not, takes time in proportion to its length. One case is left: where
gzip headers stand inside a long member that fails its check sum, each of them is read on its own.

Defined results: a null blob stays null and has no type, an empty one has no type; a blob without a valid signature keeps
its declared type; equal blobs give equal results; extra columns are kept, and where they have the names of the new columns
these get underscores in front until they are free; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import common

#: Payloads are padded with spaces to a positive multiple of this.
BLOCK = 192
#: What the stored payloads are declared as.
DECLARED = "application/octet-stream"
#: Samples a second of the sound that a payload is stored as.
RATE = 8000


class Blob:
    """Bytes, and what has been found out about them."""

    def __init__(self, data: bytes) -> None:
        self.data, self.view, self.known = data, memoryview(data), {}

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, at):
        return self.view[at]

    def all(self, mark: bytes) -> list[int]:
        """All places of a mark, looked for once."""
        if mark not in self.known:
            self.known[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self.known[mark]


#: What ends entropy-coded data of a picture: a marker that is neither stuffing nor a restart.
_MARKERS = re.compile(rb"\xff(?=[^\x00\xd0-\xd7])", re.DOTALL)


#: Bytes between kept check sums of what lies before, and the polynomial of CRC-32, lowest bit first.
CRC_STEP, _POLY = 1 << 12, 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials, modulo that of CRC-32; bit 31 stands for x to the power of 0."""
    out = 0
    for n in range(31, -1, -1):
        if a >> n & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def _power(n: int) -> int:
    """x to the power of 8 n."""
    out, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def _crc(b: Blob, start: int, end: int) -> int:
    """CRC-32 of a stretch: read where it is short, else by those of what lies before its two ends."""
    if end - start <= 2 * CRC_STEP:
        return zlib.crc32(b.view[start:end])
    sums = b.known.setdefault("crc", [0])
    while len(sums) <= end // CRC_STEP:
        at = (len(sums) - 1) * CRC_STEP
        sums.append(zlib.crc32(b.view[at : at + CRC_STEP], sums[-1]))
    before, upto = (zlib.crc32(b.view[p // CRC_STEP * CRC_STEP : p], sums[p // CRC_STEP]) for p in (start, end))
    return upto ^ _times(_power(end - start), before)


def _walked(b: Blob, name: str, at: int, step: Callable[[int], tuple[int | None, int | None]]) -> int | None:
    """Where a walk from place to place ends, from `at`; step gives the next place or the end. What is known of a place is kept."""
    ends, p, passed, end = b.known.setdefault(name, {}), at, [], None
    while p is not None and p not in ends:
        passed.append(p)
        p, end = step(p)
    end = ends[p] if p is not None else end
    for q in passed:
        ends[q] = end
    return end


def _png(b: Blob, at: int) -> int | None:
    def chunk(p: int) -> tuple[int | None, int | None]:
        if p + 12 > len(b):
            return None, None
        n, kind = struct.unpack_from(">I4s", b.view, p)
        if p + 12 + n > len(b) or struct.unpack_from(">I", b.view, p + 8 + n)[0] != _crc(b, p + 4, p + 8 + n):
            return None, None
        return (None, p + 12 + n) if kind == b"IEND" else (p + 12 + n, None)

    if bytes(b[at + 12 : at + 16]) != b"IHDR":
        return None
    end = _walked(b, "png", at + 8, chunk)
    return end - at if end else None


def _jpeg(b: Blob, at: int) -> int | None:
    if "markers" not in b.known:
        b.known["markers"] = [m.start() for m in _MARKERS.finditer(b.data)]
    marks = b.known["markers"]

    def scan(p: int) -> tuple[int | None, int | None]:
        """From a place behind the first scan's header."""
        k = bisect.bisect_left(marks, p)  # entropy-coded data runs to the next marker that is neither stuffing nor a restart
        p = marks[k] if k < len(marks) else len(b)
        if p + 2 <= len(b) and b[p + 1] == 0xD9:
            return None, p + 2
        return segments(p)

    def segments(p: int) -> tuple[int | None, int | None]:
        """Over segments to behind the next scan's header, or to the end marker."""
        found = _walked(b, "jpeg-segments", p, segment)
        return (found, None) if found and found > 0 else (None, -found if found else None)

    def segment(p: int) -> tuple[int | None, int | None]:
        """One segment on; ends behind a scan's header, or (as a negative number) behind an end marker."""
        if p + 4 > len(b) or b[p] != 0xFF:
            return None, None
        mark = b[p + 1]
        if mark == 0xD9:
            return None, -(p + 2)
        if mark in (0x00, 0x01, 0xFF) or 0xD0 <= mark <= 0xD8:
            return None, None
        following = p + 2 + struct.unpack_from(">H", b.view, p + 2)[0]
        return (None, following) if mark == 0xDA else (following, None)

    first, _ = segments(at + 2)  # without a scan there is no picture
    end = _walked(b, "jpeg", first, scan) if first else None
    return end - at if end else None


def _gif(b: Blob, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]

    def block(p: int) -> tuple[int | None, int | None]:
        if p >= len(b):
            return None, None
        return (p + 1 + b[p], None) if b[p] else (None, p + 1)

    def part(p: int) -> tuple[int | None, int | None]:
        if p >= len(b):
            return None, None
        if b[p] == 0x3B:
            return None, p + 1
        if b[p] == 0x21:
            return _walked(b, "gif-blocks", p + 2, block), None
        if b[p] == 0x2C and p + 10 <= len(b):
            own = b[p + 9]
            return _walked(b, "gif-blocks", p + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0), block), None
        return None, None

    end = _walked(b, "gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), part)
    return end - at if end else None


def _bmp(b: Blob, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", b.view, at + 2)
    width, height, planes, depth = struct.unpack_from("<iiHH", b.view, at + 18)
    if zero or header not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    data = (width * depth + 31) // 32 * 4 * abs(height)
    return size if start >= 14 + header and start + data <= size <= len(b) - at else None


def _chunk_from(b: Blob, at: int, end: int) -> int:
    """The first place not before `end` of the walk over chunks that starts at `at`, as far as that goes.

    Each place knows the next one, how many follow, and one far ahead, so walks under many headers share their steps.
    """
    known, p, passed = b.known.setdefault("riff", {}), at, []
    while p not in known:
        passed.append(p)
        if p + 8 > len(b):
            known[p] = (0, p, p)
            passed.pop()
            break
        p += 8 + (struct.unpack_from("<I", b.view, p + 4)[0] + 1) // 2 * 2
    for q in reversed(passed):
        count, _, far = known[p]
        far_count, _, farther = known[far]
        known[q] = (count + 1, p, farther if count - far_count == far_count - known[farther][0] else p)
        p = q
    while p < end:
        count, following, far = known[p]
        if not count:
            break
        p = far if far <= end else following
    return p


def _riff(kind: bytes, first: tuple[bytes, ...]):
    def check(b: Blob, at: int) -> int | None:
        if at + 20 > len(b) or bytes(b[at + 8 : at + 12]) != kind or bytes(b[at + 12 : at + 16]) not in first:
            return None
        end = at + 8 + struct.unpack_from("<I", b.view, at + 4)[0]
        p = _chunk_from(b, at + 12, end) if end <= len(b) else None
        return end - at if p == end else None

    return check


def _reversed_bits(x: int, n: int) -> int:
    return int(f"{x:0{n}b}"[::-1], 2)


_REVERSED = bytes(_reversed_bits(x, 8) for x in range(256))


def _ogg_crc(page: bytes) -> int:
    """CRC-32 from the most significant bit down, from 0 and not inverted: the common one of reversed bytes, reversed."""
    return _reversed_bits(zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF, 32)


def _ogg_page(b: Blob, p: int) -> int | None:
    """Where the page at p ends, if its lengths and check sum hold."""
    if p + 27 > len(b) or bytes(b[p : p + 5]) != b"OggS\0" or b[p + 5] > 7:
        return None
    segments = b[p + 26]
    end = p + 27 + segments + sum(b[p + 27 : p + 27 + segments])
    if end > len(b) or p + 27 + segments > len(b):
        return None
    page = bytes(b[p : p + 22]) + bytes(4) + bytes(b[p + 26 : end])
    return end if _ogg_crc(page) == struct.unpack_from("<I", b.view, p + 22)[0] else None


def _ogg(b: Blob, at: int) -> int | None:
    """Pages up to the last one; what is known of later pages is kept."""
    ends, p, walked = b.known.setdefault("ogg", {}), at, []
    while p not in ends:
        walked.append(p)
        end = _ogg_page(b, p)
        ends[p] = None
        if end is None:
            break
        if b[p + 5] & 4:
            ends[p] = end
            break
        p = end
    for q in walked:
        ends[q] = ends[p]
    return ends[at] - at if ends[at] else None


def _pdf(b: Blob, at: int) -> int | None:
    """Up to the last end marker before the next header, behind an object and a cross reference."""
    heads, ends = b.all(b"%PDF-"), b.all(b"%%EOF")
    following = bisect.bisect_right(heads, at)
    k = bisect.bisect_left(ends, heads[following] if following < len(heads) else len(b)) - 1
    if k < 0 or ends[k] < at:
        return None
    first = lambda marks: marks[i] if (i := bisect.bisect_left(marks, at)) < len(marks) else len(b)
    return ends[k] + 5 - at if first(b.all(b" obj")) < first(b.all(b"startxref")) < ends[k] else None


def _gzip(b: Blob, at: int) -> int | None:
    """A member whose check sum holds; read in pieces, and not again inside one that held."""
    if at + 18 > len(b) or b[at + 3] & 0xE0 or at < b.known.get("gzip", 0):
        return None
    reader, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not reader.eof:
            piece = reader.unconsumed_tail or bytes(b[p : p + (1 << 14)])
            p += 0 if reader.unconsumed_tail else len(piece)
            reader.decompress(piece, 1 << 16)
        while reader.unconsumed_tail and not reader.eof:
            reader.decompress(reader.unconsumed_tail, 1 << 16)
    except zlib.error:
        return None
    if not reader.eof:
        return None
    b.known["gzip"] = end = p - len(reader.unused_data)
    return end - at


def _zip(b: Blob, at: int) -> int | None:
    """Archives by the end records that say where they begin."""
    if "zip" not in b.known:
        b.known["zip"] = {}
        for end in b.all(b"PK\5\6"):
            if end + 22 > len(b):
                continue
            entries, size, start, note = struct.unpack_from("<HIIH", b.view, end + 10)
            directory = end - size
            if entries and directory >= start and end + 22 + note <= len(b) and bytes(b[directory : directory + 4]) == b"PK\1\2":
                b.known["zip"].setdefault(directory - start, end + 22 + note)
    end = b.known["zip"].get(at)
    return end - at if end else None


#: Magic bytes and media types. A validator gives the length of what starts there, or None.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff(b"WAVE", (b"fmt ", b"JUNK", b"bext"))),
    (b"RIFF", "image/webp", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"OggS\0", "audio/ogg", _ogg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\3\4", "application/zip", _zip),
)


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    by_magic: dict[bytes, list[int]] = {}
    for i, (magic, _, _) in enumerate(FORMATS):
        by_magic.setdefault(magic, []).append(i)
    for magic, which in by_magic.items():
        found.add_word(magic.decode("latin-1"), (len(magic), which))  # a byte is the character of the same number
    found.make_automaton()
    return found


_magic = _automaton()


def carve(blob: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all media with valid structure that lie in no other one, in order, and of those inside."""
    view, out = Blob(blob), []
    for end, (n, which) in _magic.iter(blob.decode("latin-1")):
        at = end - n + 1
        for i in which:
            length = FORMATS[i][2](view, at)
            if length:
                out.append((at, length, FORMATS[i][1]))
    return sorted(out)


def wav(samples: bytes) -> bytes:
    """Samples as 8-bit mono sound."""
    pad = b"\0" * (len(samples) % 2)
    body = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8) + struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def wav_samples(blob: bytes, at: int, length: int) -> bytes:
    """The samples of a sound that starts at an offset."""
    p, end = at + 12, at + length
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", blob, p)
        if kind == b"data":
            return blob[p + 8 : p + 8 + n]
        p += 8 + (n + 1) // 2 * 2
    return b""


def _sniffed(names: tuple[str, str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "media"):
            types, inside = [], []
            for blob, declared in zip(batch.column("media").to_pylist(), batch.column("declared_type").to_pylist(), strict=True):
                found = carve(blob) if blob else []
                types.append(None if not blob else next((t for at, _, t in found if at == 0), declared))
                inside.append([{"start": at, "length": n, "media_type": t} for at, n, t in found if at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(inside, parts)], names=[*batch.schema.names, *names])

    return run


def sniff(df: DataFrame) -> DataFrame:
    """Adds media_type and embedded (start, length, media_type) to a frame with columns media and declared_type."""
    names = []
    for name in ("media_type", "embedded"):
        while name in df.columns:
            name = f"_{name}"
        names.append(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_sniffed((names[0], names[1])), f"{schema}, {names[0]} string, {names[1]} array<struct<start: long, length: long, media_type: string>>")


def _stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as sound files, declared as mere bytes."""
    for batch in common.chunks(batches):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        media = [wav(t.ljust(max(BLOCK, -(-len(t) // BLOCK) * BLOCK))) for t in texts]
        yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([DECLARED] * len(texts))], names=["doc_id", "n_bytes", "media", "declared_type"])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in common.chunks(batches, "media"):
        rows = []
        for r in batch.to_pylist():
            blob = r["media"]
            payload = wav_samples(blob, 0, len(blob)) if r["media_type"] == "audio/wav" else b""
            feature = f"{r['media_type']};" + ",".join(f"{x['media_type']}@{x['start']}+{x['length']}" for x in r["embedded"])
            rows.append((r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op6_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as 8-bit sound, declared as mere bytes, sniffed, and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = docs.mapInArrow(_stored, "doc_id long, n_bytes long, media binary, declared_type string")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return sniff(stored).mapInArrow(_digests, schema).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("feature"))

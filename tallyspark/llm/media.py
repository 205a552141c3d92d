"""Media columns by signature sniffing.

An Aho-Corasick automaton finds every magic byte string in one pass over the stored bytes; a validator of the format
then confirms structure and length at that place. The first confirmed format at offset 0 corrects the declared type;
confirmed formats at later offsets are carved as embedded media.

Whatever a validator looks for behind its magic (ends of archives and revisions, chains of chunks) is found once for
all magics of a blob, so many magic strings in a long text cost no more than its length.

Edge cases: null or empty bytes have no type (detected null, no embedded media); a magic string whose structure is
not confirmed is ignored; of two formats confirmed at one offset the first found counts; a medium inside another one
is reported too, by its own offset; texts of 4 GiB and more don't fit a WAV file's length fields (Spark's rows end at
2 GiB before that); repeated rows give repeated rows; other columns are neither read nor able to clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy

#: Magic bytes of public formats, with the format and the magic's offset in it.
MAGIC = [
    (b"RIFF", "wav", 0),
    (b"\x89PNG\r\n\x1a\n", "png", 0),
    (b"GIF87a", "gif", 0),
    (b"GIF89a", "gif", 0),
    (b"\xff\xd8\xff", "jpeg", 0),
    (b"%PDF-", "pdf", 0),
    (b"BM", "bmp", 0),
    (b"fLaC", "flac", 0),
    (b"OggS", "ogg", 0),
    (b"ftyp", "mp4", 4),
    (b"\x1f\x8b\x08", "gzip", 0),
    (b"PK\x03\x04", "zip", 0),
]
#: Samples in a block of the stored form.
BLOCK = 576
RATE = 8000


class Blob:
    """The bytes under test, with what validators look up in them, found at the first use."""

    def __init__(self, b: bytes):
        self.b, self.walks = b, {}

    @cached_property
    def image_ends(self) -> list[int]:
        """Places of the JPEG end marker."""
        return [m.start() for m in re.finditer(rb"\xff\xd9", self.b)]

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start of each ZIP archive that an end record's offsets name, and the first such archive's end."""
        out: dict[int, int] = {}
        for m in re.finditer(rb"PK\x05\x06", self.b):
            k = m.start()
            if k + 22 <= len(self.b):
                size, start, note = struct.unpack_from("<IIH", self.b, k + 12)
                if k + 22 + note <= len(self.b):
                    out.setdefault(k - start - size, k + 22 + note)
        return out

    @cached_property
    def revisions(self) -> dict[int, list[tuple[int, int, int]]]:
        """Start of each PDF that a startxref names by the table before it: (table, number, end) of its revisions."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        tables = [m.start() for m in _TABLE.finditer(self.b)]
        streams = [m.start() for m in _OBJECT.finditer(self.b)]
        for m in _STARTXREF.finditer(self.b):
            for places in (tables, streams):
                k = bisect_left(places, m.start()) - 1
                if k < 0 or (places is streams and self.b.find(b"/XRef", places[k], m.start()) < 0):
                    continue
                for blank in range(3):  # the number may name white space before the table
                    at = places[k] - blank - int(m[1])
                    if at >= 0 and not self.b[places[k] - blank : places[k]].strip():
                        out.setdefault(at, []).append((places[k], int(m[1]), m.end()))
        return out

    @cached_property
    def last_parts(self) -> list[int]:
        """Ends of all startxref sections."""
        return [m.end() for m in _STARTXREF.finditer(self.b)]

    def walk(self, kind: str, k: int, step) -> int | None:
        """The end of the chain from k by step(k) -> (next place, ends there); None if it breaks. Each place is walked once."""
        known, path = self.walks.setdefault(kind, {}), []
        end = None
        while k not in known:
            path.append(k)
            found = step(k)
            if found is None:
                break
            k, last = found
            if last:
                end = k
                break
        else:
            end = known[k]
        for x in path:
            known[x] = end
        return end


def _wav(blob: Blob, at: int) -> int | None:
    """Length of the RIFF/WAVE file at this place: chunks must nest exactly, with one fmt before data."""
    b = blob.b
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    k, fmt, data = at + 12, False, False
    while k + 8 <= end:
        size = struct.unpack_from("<I", b, k + 4)[0]
        if k + 8 + size > end:
            return None
        fmt |= b[k : k + 4] == b"fmt " and size >= 16
        data |= fmt and b[k : k + 4] == b"data"
        k += 8 + size + (size & 1)
    return end - at if fmt and data else None


def _png(blob: Blob, at: int) -> int | None:
    b = blob.b

    def step(k: int):
        if k + 12 > len(b):
            return None
        size, kind = struct.unpack_from(">I4s", b, k)
        if k + 12 + size > len(b) or zlib.crc32(b[k + 4 : k + 8 + size]) != struct.unpack_from(">I", b, k + 8 + size)[0]:
            return None
        return k + 12 + size, kind == b"IEND"

    if b[at + 12 : at + 16] != b"IHDR" or (first := step(at + 8)) is None:
        return None
    end = blob.walk("png", first[0], lambda k: None if b[k + 4 : k + 8] == b"IHDR" else step(k))
    return end and end - at


def _gif(blob: Blob, at: int) -> int | None:
    b = blob.b
    if len(b) < at + 13:
        return None

    def step(k: int):
        if k >= len(b):
            return None
        if b[k] == 0x3B:
            return k + 1, True
        if b[k] == 0x21:
            k += 2
        elif b[k] == 0x2C and k + 10 <= len(b):
            k += 10 + (3 << ((b[k + 9] & 7) + 1) if b[k + 9] & 0x80 else 0) + 1
        else:
            return None
        k = blob.walk("gif blocks", k, lambda j: None if j >= len(b) else (j + 1, True) if not b[j] else (j + b[j] + 1, False))
        return k and (k, False)

    end = blob.walk("gif", at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0), step)
    return end and end - at


def _jpeg(blob: Blob, at: int) -> int | None:
    b = blob.b

    def step(k: int):
        if k + 4 > len(b) or b[k] != 0xFF:
            return None
        kind, size = b[k + 1], struct.unpack_from(">H", b, k + 2)[0]
        return None if size < 2 or kind in (0, 0xFF, 0xD8) else (k + 2 + size, kind == 0xDA)

    scan = blob.walk("jpeg", at + 2, step)
    if scan is None:
        return None
    k = bisect_left(blob.image_ends, scan)
    return blob.image_ends[k] + 2 - at if k < len(blob.image_ends) else None


_STARTXREF, _PREV = re.compile(rb"startxref\s+(\d{1,18})\s+%%EOF"), re.compile(rb"/Prev\s+(\d{1,18})")
_TABLE, _OBJECT = re.compile(rb"(?<!start)xref\s"), re.compile(rb"(?<!\d)\d{1,10}\s{1,4}\d{1,5}\s{1,4}obj\b")


def _pdf(blob: Blob, at: int) -> int | None:
    """To the last %%EOF of the chain of revisions: each startxref names its own table, and an update's /Prev the one before."""
    b, end, named = blob.b, None, -1
    if b.find(b"/Linearized", at, at + 1024) >= 0 and (length := re.search(rb"/L\s+(\d{1,18})", b[at : at + 1024])):
        # a linearised file has an %%EOF after its first page too; /L is the length up to the first revision's end,
        # whose startxref names the table of the first page
        k = bisect_left(blob.last_parts, at + int(length[1]) - 2)
        if k == len(blob.last_parts) or blob.last_parts[k] > at + int(length[1]):
            return None
        end = blob.last_parts[k]
        named = int(_STARTXREF.search(b, b.rfind(b"startxref", at, end))[1])
        if not (_TABLE.match(b, at + named) or _OBJECT.match(b, at + named)):
            return None
    for place, number, last in blob.revisions.get(at, ()):
        if end is None:
            end, named = last, number
        elif place >= end and any(int(p[1]) == named for p in _PREV.finditer(b, place, last)):
            end, named = last, number
    return end and end - at


def _bmp(blob: Blob, at: int) -> int | None:
    b = blob.b
    if len(b) < at + 26:
        return None
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if zero == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start <= size <= len(b) - at else None


def _flac(blob: Blob, at: int) -> int | None:
    b = blob.b

    def step(k: int):
        if k + 4 > len(b):
            return None
        k2 = k + 4 + int.from_bytes(b[k + 1 : k + 4], "big")
        return None if k2 > len(b) else (k2, bool(b[k] & 0x80))

    if len(b) < at + 8 or b[at + 4] & 0x7F or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return None
    return len(b) - at if blob.walk("flac", at + 4, step) else None  # frames have no length field; they run to the end


def _ogg(blob: Blob, at: int) -> int | None:
    b = blob.b

    def step(k: int):
        if k + 27 > len(b) or b[k : k + 5] != b"OggS\0":
            return None
        n = b[k + 26]
        size = 27 + n + sum(b[k + 27 : k + 27 + n])
        return None if k + 27 + n > len(b) or k + size > len(b) else (k + size, bool(b[k + 5] & 4))

    if len(b) < at + 6 or not b[at + 5] & 2:  # a later page of a stream
        return None
    end = blob.walk("ogg", at, step)
    return end and end - at


def _mp4(blob: Blob, at: int) -> int | None:
    """From ftyp over whole boxes; moov has to be among them."""
    b = blob.b

    def box(k: int) -> tuple[int, bytes] | None:
        if k + 8 > len(b):
            return None
        size, kind = struct.unpack_from(">I4s", b, k)
        return (size, kind) if size >= 8 and k + size <= len(b) and kind.isalnum() else None

    def step(k: int):
        here = box(k)
        return here and (k + here[0], box(k + here[0]) is None)

    if (first := box(at)) is None or first[1] != b"ftyp":
        return None
    end = blob.walk("mp4", at, step)
    moov = blob.walk("moov", at, lambda k: (here := box(k)) and (k + here[0], here[1] == b"moov"))
    return end - at if end and moov else None


def _gzip(blob: Blob, at: int) -> int | None:
    b, d = blob.b, zlib.decompressobj(31)
    try:
        for k in range(at, len(b), 1 << 16):
            d.decompress(b[k : k + (1 << 16)])
            if d.eof:
                return min(k + (1 << 16), len(b)) - len(d.unused_data) - at
    except zlib.error:
        pass
    return None


def _zip(blob: Blob, at: int) -> int | None:
    """A stored member can hold end records of its own; the archive's is the first whose offsets lead back here."""
    end = blob.archives.get(at)
    return end and end - at


VALIDATORS = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "pdf": _pdf, "bmp": _bmp, "flac": _flac, "ogg": _ogg, "mp4": _mp4, "gzip": _gzip, "zip": _zip}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind, back in MAGIC:
        a.add_word(magic.decode("latin-1"), (kind, back + 0, len(magic)))
    a.make_automaton()
    return a


def sniff(b: bytes, magic) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each confirmed medium, by offset."""
    found, blob = {}, Blob(b)
    for last, (kind, back, size) in magic.iter(b.decode("latin-1")):
        at = last + 1 - size - back
        if at >= 0 and at not in found and (n := VALIDATORS[kind](blob, at)):
            found[at] = (kind, at, n)
    return [found[k] for k in sorted(found)]


def store_text(text: bytes) -> bytes:
    """text, padded by bytes 255 to a positive multiple of BLOCK, as unsigned 8-bit mono samples of a WAV file."""
    n = max(1, -(-len(text) // BLOCK)) * BLOCK
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + text + b"\xff" * (n - len(text))


def samples(b: bytes, at: int, size: int) -> tuple[int, int]:
    """(offset, length) of the samples of the WAV file at this place."""
    k = at + 12
    while k + 8 <= at + size:
        n = struct.unpack_from("<I", b, k + 4)[0]
        if b[k : k + 4] == b"data":
            return k + 8, n
        k += 8 + n + (n & 1)
    return at, 0


def _stored(batches):
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        for lo in range(0, max(1, len(texts)), 500):
            part = texts[lo : lo + 500]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 500), pa.array([len(t) for t in part], pa.int64()), pa.array([store_text(t) for t in part], pa.binary()), pa.array(["wav"] * len(part), pa.string())], ["doc_id", "n_bytes", "media", "declared"])


_embedded = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def _sniffed(batches):
    magic = automaton()
    for batch in batches:
        detected, corrected, embedded = [], [], []
        for b, declared in zip(batch.column("media"), batch.column("declared").to_pylist()):
            found = sniff(b.as_py() or b"", magic)
            kind = found[0][0] if found and found[0][1] == 0 else None
            detected.append(kind)
            corrected.append(kind or declared)
            embedded.append([{"type": k, "offset": o, "length": n} for k, o, n in found if o])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(detected, pa.string()), pa.array(corrected, pa.string()), pa.array(embedded, _embedded)], [*batch.schema.names, "detected", "type", "embedded"])


def _digests(batches):
    for batch in batches:
        rows = []
        for doc, n, b, kind, inner in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media", "detected", "embedded"))):
            b, (at, size) = b.as_py(), (0, 0)
            if kind.as_py() == "wav":
                at, size = samples(b, 0, len(b))
            payload = b[at : at + size]
            wave = np.frombuffer(payload, np.uint8)
            rows.append((doc.as_py(), n.as_py(), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(b), hashlib.sha256(b).hexdigest(), f"{kind.as_py()};samples={size};sum={int(wave.sum(dtype=np.int64))};crossings={int(np.count_nonzero(np.diff(wave >= 128)))};embedded={','.join(x['type'] for x in inner.as_py())}"))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


STORED = "doc_id long, n_bytes long, media binary, declared string"


def store_texts(df: DataFrame) -> DataFrame:
    """(doc_id, text) as (doc_id, n_bytes, media, declared): each whole text as a WAV file."""
    return df.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tidy(_stored), STORED)


def sniff_media(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, declared) with detected and corrected type and the embedded media (type, offset, length)."""
    return df.select("doc_id", "n_bytes", "media", "declared").mapInArrow(tidy(_sniffed), f"{STORED}, detected string, type string, embedded array<struct<type:string,offset:long,length:long>>")


def carve(df: DataFrame) -> DataFrame:
    """One row for each embedded medium of sniff_media's rows, with its bytes."""
    return df.selectExpr("doc_id", "media", "explode(embedded) e").selectExpr("doc_id", "e.type", "e.offset", "e.length", "substring(media, cast(e.offset + 1 as int), cast(e.length as int)) bytes")


def op2_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of store_texts() and sniff_media() and the digests, as one pass of Arrow batches."""
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
        .mapInArrow(tidy(lambda b: _digests(_sniffed(_stored(b)))), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    )


#: SQL has neither the stored form nor its checksums; tests compare with a round trip.
ORACLE = None

"""Media columns: what bytes really are, and media embedded in them.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass;
each format's validator then confirms structure and length and tells where the
medium ends. The medium that begins at offset 0 gives the true type; others, beside it
or inside, are carved out. Magic bytes without a valid structure behind them count for
nothing, nor does what reaches beyond the medium that it begins in.

``store`` puts any payload losslessly into a container whose unit is an 8-bit
sample (WAV, PCM mono), an 8-bit grey pixel (PGM, PNG) or an 8-bit pixel (BMP).

Null bytes give a null type and no embedded media; empty bytes the type
``application/octet-stream``. Equal bytes give equal results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, text_of

UNKNOWN = "application/octet-stream"
#: A payload is a multiple of BLOCK bytes, filled up with FILL; a row of pixels has WIDTH.
BLOCK, FILL, WIDTH = 576, b"\xff", 64


class Hopeless(Exception):
    """No medium of this format ends in what is left of the bytes."""


class Medium(NamedTuple):
    """depth: how many confirmed media it lies in."""

    kind: str
    start: int
    end: int
    depth: int = 0


def wav_end(b: bytes, at: int) -> int | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    p, seen = at + 12, set()
    if end > len(b):
        return None
    while p + 8 <= end:
        seen.add(b[p : p + 4])
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + n + n % 2
    return end if p == end and {b"fmt ", b"data"} <= seen else None


def png_end(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        kind, q = b[p + 4 : p + 8], p + 8 + n
        if q + 4 > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[p + 4 : q]) != int.from_bytes(b[q : q + 4], "big"):
            return None
        first, p = False, q + 4
        if kind == b"IEND":
            return p
    return None


def bmp_end(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, _, offset, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    if planes != 1 or head < 40 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or size != offset + row * abs(height):
        return None
    return at + size if at + size <= len(b) else None


def pgm_end(b: bytes, at: int) -> int | None:
    head = b[at + 2 : at + 40].split(None, 3)
    if len(head) < 3 or not all(x.isdigit() and len(x) < 10 for x in head[:3]) or head[2] != b"255" or b[at + 2 : at + 3] not in (b"\n", b" "):
        return None
    p = at + 2
    for x in head[:3]:
        p = b.index(x, p) + len(x)
    end = p + 1 + int(head[0]) * int(head[1])
    return end if b[p : p + 1] in (b"\n", b" ") and end <= len(b) else None


def gif_end(b: bytes, at: int) -> int | None:
    if len(b) < at + 14 or b[at + 3 : at + 6] not in (b"87a", b"89a"):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def jpeg_end(b: bytes, at: int) -> int | None:
    p = at + 2
    if b.find(b"\xff\xd9", p) < 0:
        raise Hopeless
    while p + 4 <= len(b) and b[p] == 0xFF and 0xC0 <= b[p + 1] < 0xFF:
        kind, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2:
            return None
        p += 2 + n
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2
                if b[p + 1] and not 0xD0 <= b[p + 1] < 0xD8:
                    break
                p += 2
            if p < 0:
                return None
    return None


def pdf_end(b: bytes, at: int) -> int | None:
    """At the first end mark behind a startxref; a later revision, appended to the
    file, goes on to the next one (its own part begins with neither magic bytes nor other data)."""
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    xref = b.find(b"startxref", at)
    if xref < 0 or (end := b.find(b"%%EOF", xref)) < 0:
        raise Hopeless
    end += 5
    while m := REVISION.match(b, end):
        xref = b.find(b"startxref", m.end())
        more = b.find(b"%%EOF", xref) if xref >= 0 else -1
        if more < 0:
            break
        end = more + 5
    return end


#: What a revision of a PDF begins with: an object.
REVISION = re.compile(rb"[\r\n]{1,4}[0-9]{1,10} [0-9]{1,5} obj\b")


def gzip_end(b: bytes, at: int) -> int | None:
    """Inflated a bite at a time; nothing inflated is kept."""
    d, whole = zlib.decompressobj(31), memoryview(b)
    try:
        while at < len(b):
            bite = whole[at : at + 16_384]
            at += len(bite)
            d.decompress(bite, 1 << 20)
            while not d.eof and d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            if d.eof:
                return at - len(d.unused_data)
    except zlib.error:
        pass
    return None


#: Magic bytes, type and validator.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int | None]], ...] = (
    (b"RIFF", "audio/wav", wav_end),
    (b"\x89PNG\r\n\x1a\n", "image/png", png_end),
    (b"BM", "image/bmp", bmp_end),
    (b"P5", "image/x-portable-graymap", pgm_end),
    (b"GIF8", "image/gif", gif_end),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_end),
    (b"%PDF-", "application/pdf", pdf_end),
    (b"\x1f\x8b\x08", "application/gzip", gzip_end),
)
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(FORMATS):
            found.add_word(magic.decode("latin-1"), (i, len(magic)))
        found.make_automaton()
        _automaton = found
    return _automaton


def sniff(b: bytes, nested: bool = False) -> list[Medium]:
    """Confirmed media in order; outermost only, or also those inside others. Each hit is looked at once."""
    found, done, hopeless, around = [], 0, set(), []
    hits = sorted((end + 1 - n, i) for end, (i, n) in automaton().iter(b.decode("latin-1")))
    for at, i in hits:
        if (at < done and not nested) or i in hopeless:
            continue
        while around and around[-1] <= at:
            around.pop()
        try:
            end = FORMATS[i][2](b, at)
        except Hopeless:
            hopeless.add(i)
            continue
        if end is not None and (not around or end <= around[-1]):
            found.append(Medium(FORMATS[i][1], at, end, len(around)))
            around.append(end)
            done = max(done, end)
    return found


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "replace")
    return raw + FILL * (-len(raw) % BLOCK if raw else BLOCK), len(raw)


def store(payload: bytes, kind: str) -> bytes:
    """The payload (a multiple of WIDTH bytes) in a container of the given type."""
    n, rows = len(payload), len(payload) // WIDTH
    if kind == "audio/wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload + b"\0" * (n % 2)
    if kind == "image/x-portable-graymap":
        return b"P5\n%d %d\n255\n" % (WIDTH, rows) + payload
    if kind == "image/bmp":
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + 1024 + n, 0, 54 + 1024, 40, WIDTH, -rows, 1, 8, 0, n, 2835, 2835, 256, 0) + grey + payload
    if kind == "image/png":
        lines = np.zeros((rows, WIDTH + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(kind)


def read_back(medium: bytes, kind: str) -> bytes:
    """The samples of a stored medium."""
    if kind == "audio/wav":
        return medium[44 : 44 + int.from_bytes(medium[40:44], "little")]
    if kind == "image/x-portable-graymap":
        return medium[medium.index(b"\n", medium.index(b"\n", 3) + 1) + 1 :]  # behind the third line
    if kind == "image/bmp":
        return medium[int.from_bytes(medium[10:14], "little") :]
    if kind == "image/png":
        p, data = 8, []
        while p + 12 <= len(medium):
            n = int.from_bytes(medium[p : p + 4], "big")
            if medium[p + 4 : p + 8] == b"IDAT":
                data.append(medium[p + 8 : p + 8 + n])
            p += 12 + n
        return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()
    raise ValueError(kind)


STORED = ("audio/wav", "image/x-portable-graymap", "image/bmp", "image/png")


def inspect(media: DataFrame, content: str = "content", declared: str = "declared", carve: bool = False) -> DataFrame:
    """media with detected (the type), mismatched (it isn't the declared one), and
    embedded: array of (kind, start, end, depth), with the bytes where ``carve``: media
    beside the first and inside others (depth: in how many)."""
    drop = [c for c in ("detected", "mismatched", "embedded") if c in media.columns]
    media = media.drop(*drop)
    at, as_ = media.columns.index(content), media.columns.index(declared)
    item = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())] + [("bytes", pa.binary())] * carve

    small_batches(media.sparkSession)

    def run(batches):
        for b in batches:
            kinds, differs, inner = [], [], []
            for data, said in zip(b.column(at).to_pylist(), b.column(as_).to_pylist(), strict=True):
                found = sniff(data, nested=True) if data is not None else []
                kind = None if data is None else found[0].kind if found and found[0].start == 0 else UNKNOWN
                kinds.append(kind)
                differs.append(None if kind is None or said is None else kind != said)
                inner.append([m._asdict() | ({"bytes": data[m.start : m.end]} if carve else {}) for m in found if m.start > 0])
            arrays = [*b.columns, pa.array(kinds, pa.string()), pa.array(differs, pa.bool_()), pa.array(inner, pa.list_(pa.struct(item)))]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "detected", "mismatched", "embedded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(run, f"{schema}, detected string, mismatched boolean, embedded array<struct<kind:string,start:long,end:long,depth:int{',bytes:binary' * carve}>>")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is stored in a container chosen by its bytes, declared as WAV;
    sniffing finds the true type and length, by which the payload is read back."""

    def row(text: str) -> tuple:
        payload, n = payload_of(text)
        stored = store(payload, STORED[zlib.crc32(payload) % len(STORED)])
        media = sniff(stored)
        first = media[0]
        back = read_back(stored[first.start : first.end], first.kind)
        x = np.frombuffer(back, np.uint8)
        inner = len(media) - 1 + len(sniff(back))
        feature = f"{first.kind};corrected={int(first.kind != 'audio/wav')};embedded={inner};samples={len(x)};sum={int(x.sum(dtype=np.int64))};min={x.min()};max={x.max()}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    def run(batches):
        for b in batches:
            rows = [row(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    return table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text")).mapInArrow(run, schema)

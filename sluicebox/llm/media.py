"""Media columns: signature sniffing, validation, type correction and carving.

An Aho-Corasick automaton finds all magic bytes of a stored value in one pass.
Each place found is handed to its format's validator, which confirms the
structure (chunk lengths, checksums, sizes) and returns the format's own length.
The format that stands at the value's first byte corrects the declared type; all
other confirmed formats are carved out, those that follow it and those that lie
whole in another's body (a picture in a PDF's stream or in a WAV's samples),
each with the place of the piece that holds it.

``store`` is the other direction: it keeps a text's bytes losslessly as 8-bit
samples of a mono WAV file.

Defined results: a null or empty value has no type and nothing carved; a value
whose first bytes confirm no format keeps the declared type, unconfirmed; equal
values give equal results; other columns are kept and never looked at, but for
those that have an output's name, which the output replaces.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vectext as V
from .common import map_batches

#: A payload's length is a positive multiple of this, filled up with spaces.
PAYLOAD_UNIT = 192
SAMPLE_RATE = 8000


@dataclass(frozen=True)
class Found:
    """A confirmed piece of media: its place in the value, its length and what its headers say."""

    mime: str
    offset: int
    length: int
    detail: str
    body: tuple[int, int] = (0, 0)  # where the samples stand
    inside: int = -1  # where the innermost piece that holds it starts


def _wav(b: bytes, at: int) -> Found | None:
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    size = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if size < 44 or at + size > len(b):
        return None
    p, fmt, data = at + 12, None, None
    while p + 8 <= at + size:
        name, n = b[p : p + 4], int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + n > at + size:
            return None
        if name == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, p + 8)
        if name == b"data":
            data = (p + 8, p + 8 + n)
        p += 8 + n + n % 2
    if fmt is None or data is None or fmt[0] not in (1, 3) or not fmt[1] or fmt[4] != fmt[1] * fmt[5] // 8 or fmt[3] != fmt[2] * fmt[4]:
        return None
    return Found("audio/wav", at, size, f"{fmt[2]}Hz/{fmt[1]}ch/{fmt[5]}bit", data)


def _png(b: bytes, at: int) -> Found | None:
    p, head = at + 8, None
    while p + 12 <= len(b):
        n, name = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None
        if head is None:
            if name != b"IHDR" or n != 13:
                return None
            head = struct.unpack_from(">IIBB", b, p + 8)
        p += 12 + n
        if name == b"IEND":
            return Found("image/png", at, p - at, f"{head[0]}x{head[1]}/{head[2]}bit")
    return None


def _gif(b: bytes, at: int) -> Found | None:
    if at + 13 > len(b):
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return Found("image/gif", at, p + 1 - at, f"{width}x{height}") if width and height else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            own = b[p + 9]
            p = blocks(p + 11 + (3 << ((own & 7) + 1) if own & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> Found | None:
    p, detail = at + 2, ""
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(b):
            return None
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and n >= 8:
            height, width = struct.unpack_from(">HH", b, p + 5)
            detail = f"{width}x{height}"
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data follows: up to a marker that is neither stuffing nor a restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return Found("image/jpeg", at, p + 2 - at, detail) if detail else None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return None


def _bmp(b: bytes, at: int) -> Found | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or header not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    if offset < 14 + header or offset + rows > size or at + size > len(b):
        return None
    return Found("image/bmp", at, size, f"{width}x{abs(height)}/{bits}bit")


#: The end of a PDF's cross-references: each revision of a file has one, and a linearized file has one near its start.
_PDF_END = re.compile(rb"startxref\s+\d+\s+%%EOF")


def _pdf(b: bytes, at: int) -> Found | None:
    """Up to the last end of cross-references before another file's header."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    following = b.find(b"%PDF-", at + 5)
    ends = [m.end() for m in _PDF_END.finditer(b, at, following if following >= 0 else len(b))]
    return Found("application/pdf", at, ends[-1] - at, b[at + 5 : at + 8].decode("latin-1")) if ends else None


def _gzip(b: bytes, at: int) -> Found | None:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    try:
        n = 0
        rest = memoryview(b)[at:]
        while not d.eof and len(rest):
            n += len(d.decompress(rest, 1 << 20))
            rest = d.unconsumed_tail
    except zlib.error:
        return None
    return Found("application/gzip", at, len(b) - at - len(d.unused_data), f"{n}B") if d.eof else None


#: Magic bytes and the validators of their formats.
FORMATS: list[tuple[bytes, Callable[[bytes, int], Found | None]]] = [
    (b"RIFF", _wav),
    (b"\x89PNG\r\n\x1a\n", _png),
    (b"GIF87a", _gif),
    (b"GIF89a", _gif),
    (b"\xff\xd8\xff", _jpeg),
    (b"BM", _bmp),
    (b"%PDF-", _pdf),
    (b"\x1f\x8b", _gzip),
]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, (magic, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def sniff(value: bytes) -> list[Found]:
    """The confirmed pieces of media in value, by their place; one that overlaps another lies whole in it."""
    out: list[Found] = []
    holders: list[Found] = []
    places = sorted((last - len(FORMATS[i][0]) + 1, i) for last, i in automaton().iter(value.decode("latin-1")))
    for at, i in places:
        while holders and at >= holders[-1].offset + holders[-1].length:
            holders.pop()
        found = FORMATS[i][1](value, at)
        if found is None or holders and at + found.length > holders[-1].offset + holders[-1].length:
            continue
        found = replace(found, inside=holders[-1].offset if holders else -1)
        out.append(found)
        holders.append(found)
    return out


SNIFFED = T.StructType(
    [
        T.StructField("media_type", T.StringType()),
        T.StructField("confirmed", T.BooleanType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField("media_length", T.LongType()),
        T.StructField("detail", T.StringType()),
        T.StructField("body_start", T.LongType()),
        T.StructField("body_length", T.LongType()),
        T.StructField("carved", T.ArrayType(T.StructType([T.StructField("media_type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("inside", T.LongType()), T.StructField("bytes", T.BinaryType())]))),
    ]
)


def sniffed(value: bytes | None, declared: str | None) -> dict:
    """What sniff() says about one value, as a row of SNIFFED."""
    pieces = sniff(value) if value else []
    own = pieces[0] if pieces and pieces[0].offset == 0 else None
    return {
        "media_type": own.mime if own else declared if value else None,
        "confirmed": own is not None,
        "corrected": own is not None and own.mime != declared,
        "media_length": own.length if own else 0,
        "detail": own.detail if own else "",
        "body_start": own.body[0] if own else 0,
        "body_length": own.body[1] - own.body[0] if own else 0,
        "carved": [{"media_type": p.mime, "offset": p.offset, "inside": p.inside, "bytes": value[p.offset : p.offset + p.length]} for p in pieces if p is not own],
    }


def sniff_column(df: DataFrame, value: str, declared: str, out: str = "sniffed") -> DataFrame:
    """df with the struct column ``out`` about the binary column ``value``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(SNIFFED)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, SNIFFED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, value, 8 << 20):
                rows = [sniffed(v, d) for v, d in zip(part.column(value).to_pylist(), part.column(declared).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema[:-1]), pa.array(rows, kind)], names=schema.names)

    return df.transform(map_batches, run, schema)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes filled up with spaces to a positive multiple of PAYLOAD_UNIT, bytes before that)."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT, b" "), len(raw)


def wav_of(payload: bytes) -> bytes:
    """A mono WAV file whose 8-bit samples are the payload's bytes."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload


def store(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with ``out`` (the stored file), ``declared_type`` and ``n_bytes`` in place of the text."""
    names = (out, "declared_type", "n_bytes")
    kept = [f for f in docs.schema.fields if f.name not in (text, *names)]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType()), T.StructField("declared_type", T.StringType()), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, text, 4 << 20):
                rows = [payload_of(t) for t in part.column(text).to_pylist()]
                cols = [pa.array([wav_of(p) for p, _ in rows], pa.binary()), pa.array(["application/octet-stream"] * len(rows)), pa.array([n for _, n in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *cols], names=schema.names)

    return docs.transform(map_batches, run, schema)


def describe(found: Found, samples: bytes, carved: int) -> str:
    """Features of stored samples: type, header, loudness, zero crossings and pieces carved."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"{found.mime};{found.detail};peak={int(np.abs(x).max())};energy={int((x * x).sum(dtype=np.int64)) // len(x)};crossings={crossings};carved={carved}"


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, type_corrected boolean, carved array<struct<media_type: string, offset: long, inside: long, length: long>>"


def features(stored: DataFrame, media: str = "media", declared: str = "declared_type") -> DataFrame:
    """stored without its file and declared type, with what sniff() finds in the file read back (FEATURES).

    A file whose first bytes are no WAV (a null one too) has no payload: null
    features, its declared type unless another format is confirmed.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    outputs = T._parse_datatype_string(FEATURES)
    kept = [f for f in stored.schema.fields if f.name not in {media, declared, *outputs.names}]
    schema = T.StructType([*kept, *outputs.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, media, 4 << 20):
                out = [_read_back(v, d) for v, d in zip(part.column(media).to_pylist(), part.column(declared).to_pylist(), strict=True)]
                cols = [pa.array([r[i] for r in out], to_arrow_type(f.dataType)) for i, f in enumerate(outputs.fields)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *cols], names=schema.names)

    return stored.transform(map_batches, run, schema)


def _read_back(value: bytes | None, declared: str | None) -> tuple:
    """The features of one stored file."""
    pieces = sniff(value) if value else []
    own = pieces[0] if pieces and pieces[0].offset == 0 else None
    carved = [{"media_type": p.mime, "offset": p.offset, "inside": p.inside, "length": p.length} for p in pieces if p is not own]
    kind, corrected = (own.mime, own.mime != declared) if own else (declared if value else None, False)
    size, digest = (len(value), hashlib.sha256(value).hexdigest()) if value is not None else (None, None)
    if own is None or own.mime != "audio/wav":
        return None, None, None, size, digest, None, kind, corrected, carved
    samples = value[own.body[0] : own.body[1]]
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), size, digest, describe(own, samples, len(carved)), kind, corrected, carved

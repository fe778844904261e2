"""Media against files made here, and broken ones."""

import gzip
import hashlib
import struct
import zlib

from pyspark.sql import functions as F

from sluicebox.llm import media


def png(w=3, h=2):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes((w + 1) * h))) + chunk(b"IEND", b"")


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 8, 0, 54, 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0) + bytes(8)


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00abc\xff\x00de\xff\xd9"
PDF = b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF"


def test_formats_are_confirmed_with_their_lengths():
    gz = gzip.compress(b"hello" * 50)
    for value, mime in ((png(), "image/png"), (bmp(), "image/bmp"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (PDF, "application/pdf"), (gz, "application/gzip"), (media.wav_of(b"x" * 192), "audio/wav")):
        (found,) = media.sniff(value + b"tail")
        assert (found.mime, found.offset, found.length) == (mime, 0, len(value))
        assert not [f for f in media.sniff(value[:-3]) if f.mime == mime and f.offset == 0]


def wav_holding(*parts):
    return media.wav_of(b"".join(parts).ljust(384, b"."))


def test_pieces_inside_others_are_carved_with_their_holder(spark):
    inner = wav_holding(b"..", GIF)
    value = wav_holding(b"x" * 7, png(), b"--", JPEG) + b"tail" + bmp() + media.wav_of(inner.ljust(576, b" "))
    found = [(f.mime, f.offset, f.inside) for f in media.sniff(value)]
    at = value.index(b"tail") + 4
    outer = at + len(bmp())
    assert found == [("audio/wav", 0, -1), ("image/png", 51, 0), ("image/jpeg", 51 + len(png()) + 2, 0), ("image/bmp", at, -1), ("audio/wav", outer, -1), ("audio/wav", outer + 44, outer), ("image/gif", outer + 90, outer + 44)]
    stream = b"%PDF-1.7\n1 0 obj stream\n" + JPEG + b"\nendstream\nstartxref\n77\n%%EOF\n"
    assert [(f.mime, f.inside) for f in media.sniff(stream)] == [("application/pdf", -1), ("image/jpeg", 0)]
    # A piece that reaches over its holder's end is none of it.
    cut = media.wav_of(png()[:-5].ljust(192, b"."))
    assert [f.mime for f in media.sniff(cut + b"IEND")] == ["audio/wav"]
    rows = spark.createDataFrame([(1, value, "image/png", "kept"), (2, None, "audio/wav", None), (3, b"plain", "text/plain", "k"), (4, GIF, None, "k")], "doc_id long, media binary, declared_type string, feature string")
    out = {r["doc_id"]: r for r in media.features(rows.withColumn("other", F.col("doc_id") * 2)).collect()}
    assert (out[1]["media_type"], out[1]["type_corrected"], out[1]["payload_bytes"], out[1]["other"]) == ("audio/wav", True, 384, 2)
    assert [(c["media_type"], c["offset"], c["inside"]) for c in out[1]["carved"]] == found[1:]
    assert out[2]["media_type"] is None and out[2]["payload_sha256"] is None and out[2]["media_bytes"] is None
    assert (out[3]["media_type"], out[3]["feature"], out[3]["type_corrected"]) == ("text/plain", None, False)
    assert (out[4]["media_type"], out[4]["type_corrected"], out[4]["payload_bytes"]) == ("image/gif", True, None)


def test_a_pdf_ends_with_its_last_revision():
    first = b"%PDF-1.4\nstartxref\n0\n%%EOF\nbody of a linearized file\nstartxref\n9\n%%EOF"
    updated = first + b"\n2 0 obj\nstartxref\n\n120\n%%EOF"
    for value in (first, updated):
        (found,) = media.sniff(value + b"\nrest %%EOF")
        assert found.length == len(value)
    one, two = media.sniff(first + b"..." + updated)
    assert (one.length, two.offset, two.length) == (len(first), len(first) + 3, len(updated))


def test_magic_bytes_alone_confirm_nothing():
    assert media.sniff(b"RIFF GIF89a BM %PDF-x \x89PNG\r\n\x1a\n \xff\xd8\xff \x1f\x8b" + bytes(60)) == []


def test_columns_are_corrected_and_carved(spark):
    value = png() + b"..." + GIF + b"BM" + bmp()
    rows = [(1, value, "image/jpeg"), (2, None, "image/png"), (3, b"", None), (4, b"plain", "text/plain"), (5, value, "image/jpeg"), (6, b"zz" + GIF, "x/y")]
    out = {r["id"]: r["sniffed"] for r in media.sniff_column(spark.createDataFrame(rows, "id long, body binary, kind string"), "body", "kind").collect()}
    assert (out[1]["media_type"], out[1]["corrected"], out[1]["media_length"]) == ("image/png", True, len(png()))
    assert [(c["media_type"], bytes(c["bytes"])) for c in out[1]["carved"]] == [("image/gif", GIF), ("image/bmp", bmp())]
    assert out[5] == out[1] and out[2]["media_type"] is None and out[3]["carved"] == []
    assert (out[4]["media_type"], out[4]["confirmed"]) == ("text/plain", False)
    assert (out[6]["media_type"], len(out[6]["carved"])) == ("x/y", 1)


def test_payloads_come_back(spark):
    texts = [None, "", "a", "RIFF GIF89a" * 40, "é" * 96, "x" * 193, "a"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r["doc_id"]: r for r in media.features(media.store(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.wav_of(payload)).hexdigest()
    assert rows[2]["feature"] == rows[6]["feature"] and rows[0]["payload_sha256"] == rows[1]["payload_sha256"]
    assert media.features(media.store(docs.limit(0))).count() == 0

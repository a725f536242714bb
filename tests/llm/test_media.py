import hashlib
import struct
import time
import zlib

from lexengine.llm import media
from lexengine.llm.common import table

MACHINE = media.automaton()


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"RIFFabcd") + chunk(b"IEND", b"")


SOUND = {
    "audio/wav": media.to_wav(b"abc"),
    "image/png": png(),
    "image/gif": b"GIF89a\1\0\1\0\0\0\0\x2c\0\0\0\0\1\0\1\0\0\2\1x\0\x3b",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3xdata\xff\xd9",
    "application/pdf": b"%PDF-1.4 x startxref 0 %%EOF",
    "application/zip": b"PK\3\4" + b"x" * 26 + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0, 0, 0, 30, 0),
}


def test_formats_are_carved():
    for kind, blob in SOUND.items():
        assert media.sniff(b"junk" + blob + b"tail", MACHINE) == [(kind, 4, len(blob))]
    every = b"..".join(SOUND.values())
    assert [k for k, _, _ in media.sniff(every, MACHINE)] == list(SOUND)


def test_magic_alone_is_not_enough():
    for blob in SOUND.values():
        assert media.sniff(blob[:-3], MACHINE) == []
    broken = bytearray(png())
    broken[40] ^= 1
    assert media.sniff(bytes(broken), MACHINE) == []


def test_many_magics_without_an_end_stay_linear():
    began = time.time()
    for magic in (b"%PDF-1", b"PK\x03\x04", b"\xff\xd8\xff\xda\x00\x02", b"%PDF-1startxref"):
        assert media.sniff(magic * 200_000, MACHINE) == []
    assert time.time() - began < 20


def test_declared_types_are_corrected(spark):
    rows = [(1, "text/plain", bytearray(SOUND["image/gif"])), (2, "image/png", bytearray(b"nothing")), (3, None, None), (4, "a", bytearray(b"x" + SOUND["audio/wav"] + png()))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id int, kind string, data binary, media int")
    found = media.sniff_column(df, "data", "kind", ["id"]).collect()
    assert [(r.id, r.declared_type, r.true_type, r.carved_type) for r in found] == [
        (1, "text/plain", "image/gif", "image/gif"), (2, "image/png", "image/png", None), (3, None, None, None), (4, "a", "a", "audio/wav"), (4, "a", "a", "image/png")
    ]


def test_query(spark):
    data = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in media.op8_media_columns(spark, data).collect()}
    for r in table(spark, data, "documents").collect():
        b = r.text.encode()
        p = b + b"\xff" * (-len(b) % 576 or 576 * (not b))
        f = found[r.doc_id]
        assert (f.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_edges(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "RIFF" * 50_000, "x")]
    blobs = media.store_texts(spark.createDataFrame(rows, "doc_id long, text string, blob string"))
    carved = media.sniff_column(blobs, "blob", "declared_type", ["doc_id", "n_bytes"]).filter("start = 10")
    found = media.describe_media(carved).collect()
    assert [(r.doc_id, r.n_bytes, r.payload_bytes) for r in found] == [(1, 0, 576), (1, 0, 576), (None, 200_000, 200_448)]
    assert found[0].feature == found[1].feature


def test_columns_that_clash_give_way(spark):
    rows = [(7, 8, bytearray(SOUND["image/gif"]), "x")]
    found = media.sniff_column(spark.createDataFrame(rows, "start int, id int, data binary, media string"), "data", "media", ["start", "id", "media"])
    assert found.columns == ["id", "declared_type", "true_type", "carved_type", "start", "length", "media"]
    assert [tuple(r)[:6] for r in found.collect()] == [(8, "x", "image/gif", "image/gif", 0, len(SOUND["image/gif"]))]


def test_media_columns_by_hand(spark):
    """media_bytes, media_sha256 and feature, worked out from the format's definition."""
    texts = {1: "", 2: "Gr\u00fc\u00dfe " * 300, 3: "RIFF\x00WAVE"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, media string")
    for r in media.stored_and_described(docs).collect():
        raw = texts[r.doc_id].encode()
        p = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        wav = b"RIFF" + (36 + len(p)).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("1000000001000100401f0000401f000001000800") + b"data" + len(p).to_bytes(4, "little") + p
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        said = dict(x.split("=") for x in r.feature.split(";")[1:])
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(p, p[1:], strict=False))
        want = {"n": len(p), "min": min(p), "max": max(p), "mean_milli": sum(p) * 1000 // len(p), "energy_milli": sum((x - 128) ** 2 for x in p) * 1000 // len(p), "crossings": crossings, "levels": len(set(p))}
        assert {k: int(v) for k, v in said.items()} == want

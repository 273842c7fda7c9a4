"""Tags read from bytes made by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from packetloom.sources import tag_blocks as B


def seven(n):
    return bytes((n >> 7 * k) & 0x7F for k in (3, 2, 1, 0))


def id3(version, frames, flags=0, extra=b""):
    return b"ID3" + bytes([version, 0, flags]) + seven(len(frames)) + frames + extra


def frame(version, key, body):
    n = len(body)
    return key + (n.to_bytes(3, "big") if version == 2 else (seven(n) if version == 4 else n.to_bytes(4, "big")) + b"\0\0") + body


@pytest.mark.parametrize("version, keys", [(2, (b"TT2", b"TP1", b"COM")), (3, (b"TIT2", b"TPE1", b"COMM")), (4, (b"TIT2", b"TPE1", b"COMM"))])
def test_id3v2(version, keys):
    f = [frame(version, keys[0], b"\0Caf\xe9\0"), frame(version, keys[1], b"\1" + "Zwölf\0Zwei".encode("utf-16")), frame(version, keys[2], b"\3engwhat\0said"), frame(version, b"APIC"[: len(keys[0])], bytes(300))]
    t, a, c = (k.decode() for k in keys)
    want = [(t, "Café"), (a, "Zwölf"), (a, "Zwei"), (c, "said")]
    assert B.id3v2_fields(id3(version, b"".join(f) + bytes(50))) == want
    assert B.id3v2_fields(id3(version, b"".join(f), extra=b"\xff\xfb sound")) == want
    cut = id3(version, b"".join(f[:2]))[:-3]
    assert B.id3v2_fields(cut) == [(t, "Café"), (a, None)]
    assert B.id3v2_fields(id3(version, keys[0] + b"\x7f" * 10)) == [(t, None)]


def test_id3v2_headers_and_encodings():
    f = frame(3, b"TXXX", b"\2" + "mood\0glad".encode("utf-16-be")) + frame(3, b"TCON", b"\0(17)") + frame(3, b"TALB", b"\7x")
    assert B.id3v2_fields(id3(3, (6).to_bytes(4, "big") + bytes(6) + f, 0x40)) == [("MOOD", "glad"), ("TCON", "(17)")]
    assert B.id3v2_fields(id3(4, seven(6) + b"\1\0" + frame(4, b"TIT2", b"\3x"), 0x40)) == [("TIT2", "x")]
    assert B.id3v2_fields(id3(3, frame(3, b"TIT2", b"\0a\xff\0b").replace(b"\xff\0", b"\xff\0\0").replace(b"\0\0b", b"\0b"), 0x80)) in ([("TIT2", "a\xffb")], [("TIT2", None)])
    for none in (b"", b"ID3", b"ID3\x05\0\0\0\0\0\0", b"RIFF" + bytes(20)):
        assert B.id3v2_fields(none) is None


def ape_items(items):
    return b"".join(struct.pack("<2I", len(v), flags) + k + b"\0" + v for k, v, flags in items)


def test_ape():
    items = ape_items([(b"Title", "Zwölf".encode(), 0), (b"Cover", bytes(20), 2), (b"Artist", b"a\0b", 0)])
    mark = lambda flags: b"APETAGEX" + struct.pack("<4I", 2000, len(items) + 32, 3, flags) + bytes(8)
    want = [("Title", "Zwölf"), ("Artist", "a"), ("Artist", "b")]
    head, foot = mark(0xA0000000), mark(0x80000000)
    for data in (items + foot, b"sound" + head + items + foot, head + items + foot + b"sound", b"sound" + items + mark(0) + b"TAG" + bytes(125)):
        assert B.ape_fields(data) == want
    broken = items.replace(struct.pack("<I", 6), struct.pack("<I", 600), 1)
    assert B.ape_fields(broken + foot) == [("Title", None)]
    assert B.ape_fields(b"APETAGEX") is None and B.ape_fields(bytes(500)) is None


def test_vorbis():
    said = lambda *c: struct.pack("<I", 3) + b"me!" + struct.pack("<I", len(c)) + b"".join(struct.pack("<I", len(x)) + x for x in c)
    data = said("title=Zwölf".encode(), b"ARTIST=a=b", b"nothing", b"Artist=")
    assert B.vorbis_fields(data) == [("TITLE", "Zwölf"), ("ARTIST", "a=b"), ("ARTIST", "")]
    assert B.vorbis_fields(data[:-3]) == [("TITLE", "Zwölf"), ("ARTIST", "a=b"), ("", None)]
    assert B.vorbis_fields(b"\xff" * 20) is None and B.vorbis_fields(b"") is None and B.vorbis_fields(said()) == []


def test_columns(spark):
    rows = [(1, id3(4, frame(4, b"TIT2", b"\3x") + frame(4, b"TCON", b"\3(9)") + frame(4, b"TZZZ", b"\3y"))), (2, b"none"), (3, None), (4, id3(4, b""))]
    got = spark.createDataFrame(rows, "n int, content binary").select("n", B.named(B.id3v2(F.col("content"))).alias("t")).collect()
    assert {r.n: r.t and [tuple(x) for x in r.t] for r in got} == {1: [("Title", "x"), ("Genre", "Metal")], 2: None, 3: None, 4: []}
    assert len(B.GENRES) == 148 and B.GENRES[147] == "Synthpop"

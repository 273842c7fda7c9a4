"""Golden rows of small hand-made files."""

import struct

from pyspark.sql import functions as F

from packetloom.functions import samples as S
from packetloom.functions import text as X
from packetloom.sources import cues, pcm, playlists, tags


def files(spark, text, source="f"):
    return spark.createDataFrame([(source, text)], "source string, text string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ord" if "ord" in df.columns else columns[0]).collect()]


def test_srt(spark):
    text = "1\r\n00:00:01,000 --> 00:00:02.500\r\nfirst\r\nline\r\n\r\n@OFF=1.5\n\n2\n00:00:03:000 --> 00:00:04,000\nsecond\n\n@SCALE=2:1\n\n3\n00:00:10,000 --> 00:00:11,000\nlast"
    got = rows(cues.parse_srt(files(spark, text), 1), "pts", "duration", "text")
    assert got == [(1000, 1500, "first\nline"), (4500, 1000, "second"), (23000, 2000, "last")]


def test_srt_in_utf16(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(b"\xff\xfe" + "1\n00:00:01,000 --> 00:00:02,000\nä€\n".encode("utf-16-le"))
    got = cues.parse_srt(cues.read_files(spark, str(tmp_path))).collect()
    assert [(r.pts, r.text) for r in got] == [(1000, "ä€")]


def test_vtt(spark):
    text = "﻿WEBVTT\nX-TIMESTAMP-MAP=MPEGTS:900000,LOCAL:00:00:01.000\n\nid\n00:01.000 --> 01:00:02.000 align:left\n<c.red.bg_blue>a</c> <b>b</b> <x>1<2\n<c.bg_lime.none.white.cyan>c</c><c.other>d</c>\n"
    got = rows(cues.parse_vtt(files(spark, text)), "pts", "duration", "text")
    assert got == [(10000, 3601000, '<span foreground="#FF0000" background="#0000FF">a</span> <b>b</b> &lt;x&gt;1&lt;2\n<span foreground="#00FFFF" background="#00FF00">c</span><span>d</span>')]
    assert cues.parse_vtt(files(spark, "no header\n\n00:01.000 --> 00:02.000\nx")).count() == 0


def test_m3u(spark):
    text = '#EXTM3U\r\n#EXTINF:10.5 tvg-logo="l" group-title="a;b",Name, more\r\nhttp://x/1\r\n\r\n#EXTVLCOPT:http-user-agent=ua\r\nhttp://x/2\r\n--stop--\r\nhttp://x/3\r\n'
    got = rows(playlists.parse_m3u(files(spark, text), 2), "uri", "label", "duration_us", "groups", "logo", "user_agent")
    assert got == [("http://x/1", "Name, more", 10_500_000, ["a", "b"], "l", None), ("http://x/2", None, None, None, None, "ua")]


def test_segments(spark):
    text = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:00Z\n#EXTINF:4,\na.ts\n#EXT-X-DISCONTINUITY\n#EXT-X-BYTERANGE:10@5\n#EXTINF:2.5,\nb.ts\n"
    got = [tuple(r) for r in playlists.parse_segments(files(spark, text)).orderBy("seq").collect()]
    assert got == [("f", 7, "a.ts", 4_000_000, False, 1_704_067_200_000_000, None, None), ("f", 8, "b.ts", 2_500_000, True, None, 10, 5)]
    assert playlists.is_segment_list(files(spark, text)).first().live


def test_master_list(spark):
    text = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",NAME="One, two",LANGUAGE="en",URI="x?a=b,c"\n#EXT-X-STREAM-INF:BANDWIDTH=800,CODECS="mp4a,avc",RESOLUTION=640x360,FRAME-RATE=25.0,AUDIO="a"\nlow.m3u8\nplain.m3u8\n'
    assert [tuple(r) for r in playlists.parse_variants(files(spark, text)).collect()] == [("f", 0, "low.m3u8", 800, 640, 360, 25.0, "a", None)]
    assert [tuple(r)[2:] for r in playlists.parse_media(files(spark, text)).collect()] == [("AUDIO", "a", "One, two", "en", "x?a=b,c")]


def test_long_tag_values_stay_whole(spark):
    long = "g" * 30_000
    got = rows(playlists.parse_m3u(files(spark, f"#EXTM3U\n#EXTGRP:{long}\nhttp://x\n")), "groups")
    assert got == [([long],)]


def test_pls_ref_asx_smil_qtl(spark):
    assert rows(playlists.parse_pls(files(spark, "[playlist]\nFile1=a\nTitle1=A\nFile2=b\n")), "uri", "label") == [("a", "A"), ("b", None)]
    assert rows(playlists.parse_ref(files(spark, "[Reference]\r\nRef1=http://a\r\nRef2=http://b?x=1\r\n")), "uri") == [("http://a",), ("http://b?x=1",)]
    asx = "<ASX><entry><TITLE>T</TITLE><ref href='u1'/><Ref HREF=\"u2\"/></entry><repeat><entry><ref href='u3'></entry></repeat></ASX>"
    assert rows(playlists.parse_asx(files(spark, asx)), "uri", "label") == [("u1", "T"), ("u2", "T"), ("u3", "Stream 3")]
    smil = '<smil><head><meta name="base" content="http://b/"/><meta name="title" content="t"/></head><body><audio src="a"/><video src="rtsp://c/d"/></body></smil>'
    assert rows(playlists.parse_smil(files(spark, smil)), "uri", "label") == [("http://b/a", "t"), ("rtsp://c/d", "t")]
    assert rows(playlists.parse_smil(files(spark, '<audio src="a"/>', "http://x/y/z.smi")), "uri") == [("http://x/y/a",)]
    assert rows(playlists.parse_qtl(files(spark, '<embed autoplay="true" src="rtsp://q"/>')), "uri") == [("rtsp://q",)]


def test_cue_sheet(spark):
    text = 'PERFORMER "Band"\nTITLE "Disc"\nFILE "a.wav" WAVE\nTRACK 01 AUDIO\n TITLE "One"\n INDEX 00 00:00:00\n INDEX 01 00:02:00\nTRACK 02 AUDIO\n PERFORMER "Other"\n INDEX 00 01:00:00\n INDEX 01 01:02:37\nTRACK 03 MODE1/2352\n INDEX 01 02:00:00\n'
    got = [tuple(r) for r in playlists.parse_cue(files(spark, text)).orderBy("track").select("track", "title", "performer", "start", "end", "label").collect()]
    assert got == [(1, "One", "Band", 2 * 75 * 588, 60 * 75 * 588, "01 Band - One"), (2, None, "Other", (62 * 75 + 37) * 588, 120 * 75 * 588, "Track 02")]


def wav_bytes(code, bits, channels, data, tail=b""):
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", code, channels, 8000, 8000 * block, block, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data + tail
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_audio_files(spark):
    info = b"INFOINAM" + struct.pack("<I", 6) + b"Title\0"
    cases = {
        "u8": wav_bytes(1, 8, 1, bytes([0, 128, 255])),
        "s16": wav_bytes(1, 16, 2, struct.pack("<4h", 1, -1, 32767, -32768), b"LIST" + struct.pack("<I", len(info)) + info),
        "s24": wav_bytes(1, 24, 1, b"\x00\x00\x80\xff\xff\x7f"),
        "f32": wav_bytes(3, 32, 1, struct.pack("<2f", 0.5, -0.25)),
        "mu": wav_bytes(7, 8, 1, bytes([0xFF, 0x00])),
        "a": wav_bytes(6, 8, 1, bytes([0xD5, 0x2A])),
        "au": b".snd" + struct.pack(">5I", 28, 4, 3, 44100, 1) + b"hey\0" + struct.pack(">2h", 5, -6),
        "aiff": b"FORM" + struct.pack(">I", 60) + b"AIFF" + b"COMM" + struct.pack(">IhIhHQ", 18, 1, 2, 16, 16383 + 15, 44100 << 48) + b"SSND" + struct.pack(">III", 12, 0, 0) + struct.pack(">2h", 7, -8),
        "no": b"nothing",
    }
    df = spark.createDataFrame(list(cases.items()), "source string, content binary")
    heads = {r.source: r.h for r in df.select("source", pcm.header(F.col("content")).alias("h")).collect()}
    assert heads["no"] is None and heads["s16"].tags == {"Title": "Title"} and heads["au"].tags == {"Comment": "hey"} and heads["aiff"].rate == 44100
    got = {r.source: list(r.data) for r in pcm.samples(pcm.packets(df)).collect()}
    assert got["u8"] == [-128, 0, 127] and got["s16"] == [1, -1, 32767, -32768] and got["s24"] == [-(2.0**31), 0x7FFFFF00]
    assert got["f32"] == [0.5, -0.25] and got["mu"] == [0, -32124] and got["a"] == [8, -32256] and got["au"] == [5, -6] and got["aiff"] == [7, -8]


def test_packets_cover_the_data(spark):
    df = spark.createDataFrame([("f", bytearray(wav_bytes(1, 16, 2, bytes(4 * 1000 + 3))))], "source string, content binary")
    got = pcm.packets(df, 1024).orderBy("idx").collect()
    assert [(r.pts, r.duration) for r in got] == [(0, 256), (256, 256), (512, 256), (768, 232)]
    assert sum(r["size"] for r in got) == 4000 and got[1].position == 44 + 1024


def test_probe_and_id3(spark):
    data = [(b"RIFF\0\0\0\0WAVEfmt ", "wav"), (b"OggS", "ogg"), (b"\0\0\0\x18ftypisom", "quicktime"), (b"WEBVTT\n", "vtt"), (b"#EXTM3U", "m3u"), (b"\x47" + bytes(187) + b"\x47" + bytes(187) + b"\x47", "mpegts"), (b"", None), (b"hello", None)]
    df = spark.createDataFrame([(bytearray(d), w) for d, w in data], "d binary, want string")
    assert df.select(tags.probe(F.col("d")).alias("got"), "want").filter("not got <=> want").count() == 0
    tag = b"TAG" + b"T".ljust(30, b"\0") + b"Artist".ljust(30) + b"Al".ljust(30, b"\0") + b"1999" + b"c" * 28 + b"\0\x05" + b"\x11"
    r = spark.createDataFrame([(bytearray(b"xx" + tag),), (bytearray(b"short"),)], "d binary").select(tags.id3v1(F.col("d")).alias("t")).collect()
    assert r[1].t is None and (r[0].t.title, r[0].t.artist, r[0].t.track, r[0].t.genre) == (None, "Artist", 5, 17)


def test_text_functions(spark):
    df = spark.createDataFrame([("a",)], "x string")
    one = lambda c: df.select(c.alias("v")).first().v
    lit = F.lit
    assert one(X.srt_time(lit("1:02:03,004"))) == 3723004 and one(X.srt_time(lit("x"))) is None
    assert one(X.cd_frames(lit("01:02:03"), 588)) == (3 + 75 * 62) * 588 and one(X.cd_frames(lit("?"))) == 0
    assert one(X.quoted(lit('a "b "c" d" e'))) == 'b "c" d' and one(X.quoted(lit('""'))) is None
    assert one(X.stream_title(lit("StreamTitle='A - B';StreamUrl='';"))) == "A - B"
    assert one(X.id3_string(lit("ab \0"))) == "ab" and one(X.id3_string(lit("a  "))) is None
    assert one(X.lines(lit("a\r\nb\n\nc\n"))) == ["a", "b", "", "c"]
    assert one(X.charset(F.unhex(lit("FFFE4100")))) == "UTF-16LE" and one(X.to_text(F.unhex(lit("E4")))) == "ä"
    assert one(X.seconds_us(lit("1.2345678"))) == 1234568 and one(S.to_int16(F.array(lit(2.0), lit(-0.5)))) == [32767, -16383]

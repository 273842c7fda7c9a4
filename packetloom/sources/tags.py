"""Tags at the ends of files, and format probing, as expressions on binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions import text as X


def _latin(data: Column, first: int, n: int) -> Column:
    return X.id3_string(F.decode(F.substring(data, first, n), "ISO-8859-1"))


def id3v1(data: Column) -> Column:
    """Struct title, artist, album, year, comment, track, genre of the last 128 bytes; NULL without the mark TAG. The track is there
    if the comment's last but one byte is zero and the last isn't; it goes under track."""
    tag = F.substring(data, F.octet_length(data) - 127, 128)
    byte = lambda at: F.conv(F.hex(F.substring(tag, at, 1)), 16, 10).cast("int")
    has_track = (byte(126) == 0) & (byte(127) != 0)
    found = F.struct(
        _latin(tag, 4, 30).alias("title"), _latin(tag, 34, 30).alias("artist"), _latin(tag, 64, 30).alias("album"), _latin(tag, 94, 4).alias("year"),
        F.when(has_track, _latin(tag, 98, 28)).otherwise(_latin(tag, 98, 30)).alias("comment"), F.when(has_track, byte(127)).alias("track"), byte(128).alias("genre"),
    )
    return F.when((F.octet_length(data) >= 128) & (F.hex(F.substring(tag, 1, 3)) == "544147"), found)


def write_id3v1(title: Column, artist: Column, album: Column, year: Column, comment: Column, track: Column, genre: Column) -> Column:
    """128 bytes; texts are cut to their fields."""
    pad = lambda c, n: F.rpad(F.substring(F.coalesce(c, F.lit("")), 1, n), n, "\0")
    head = F.concat(F.lit("TAG"), pad(title, 30), pad(artist, 30), pad(album, 30), pad(year, 4), pad(comment, 28))
    one = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    return F.concat(F.encode(head, "ISO-8859-1"), F.unhex(F.lit("00")), one(track), one(genre))


#: Name, byte offset, and the bytes there, in probing order.
FORMATS = [
    ("asf", 0, "3026B2758E66CF11"), ("avi", 8, "41564920"), ("rmff", 0, "2E524D46"), ("ra", 0, "2E7261FD"), ("quicktime", 4, "66747970"),
    ("quicktime", 4, "6D6F6F76"), ("quicktime", 4, "6D646174"), ("wav", 8, "57415645"), ("au", 0, "2E736E64"), ("aiff", 8, "41494646"), ("aiff", 8, "41494643"), ("flac", 0, "664C6143"),
    ("flv", 0, "464C56"), ("wavpack", 0, "7776706B"), ("tta", 0, "54544131"), ("voc", 0, "437265617469766520566F696365"), ("8svx", 8, "38535658"),
    ("smjpeg", 0, "000A534D4A504547"), ("gif", 0, "474946383961"), ("gif", 0, "474946383761"), ("vqa", 8, "57565141"), ("thp", 0, "54485000"),
    ("matroska", 0, "1A45DFA3"), ("ogg", 0, "4F676753"), ("ape", 0, "4D414320"), ("y4m", 0, "595556344D50454732"), ("sphere", 0, "4E4953545F3141"),
    ("ircam", 0, "64A30100"), ("png", 0, "89504E470D0A1A0A"), ("jpeg", 0, "FFD8FF"), ("id3v2", 0, "494433"), ("mpegps", 0, "000001BA"), ("vtt", 0, "574542565454"),
    ("vtt", 0, "EFBBBF574542565454"), ("m3u", 0, "234558544D3355"), ("pls", 0, "5B706C61796C6973745D"), ("asx", 0, "3C415358"), ("asx", 0, "3C617378"), ("smil", 0, "3C736D696C"),
]


def probe(data: Column) -> Column:
    """The first format whose bytes are there; mpegts if every 188th of three bytes is 0x47; NULL otherwise."""
    at = lambda offset, n: F.hex(F.substring(data, offset + 1, n))
    out = F.when(at(FORMATS[0][1], len(FORMATS[0][2]) // 2) == FORMATS[0][2], FORMATS[0][0])
    for name, offset, mark in FORMATS[1:]:
        out = out.when(at(offset, len(mark) // 2) == mark, name)
    return out.when((at(0, 1) == "47") & (at(188, 1) == "47") & (at(376, 1) == "47"), "mpegts")

"""Tags as blocks of named, length-coded fields: ID3v2 (2.2 to 2.4), APEv2, and the comments of Vorbis.

Each format says where its fields are and how one is cut; one walk goes along them, and never beyond the block's end: a field whose length reaches further has the value NULL and is the last.
The results are array<struct<key, value>> with the format's own keys, in file order; `named` turns keys into the common names of `NAMES`. Content without such a tag gives NULL."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "array<struct<key: string, value: string>>"
_ARROW = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))

#: Keys of the formats (APE and Vorbis in upper case) and what they stand for.
NAMES = {
    "TT2": "Title", "TIT2": "Title", "TP1": "Artist", "TPE1": "Artist", "TP2": "Albumartist", "TPE2": "Albumartist", "TAL": "Album", "TALB": "Album", "TCO": "Genre", "TCON": "Genre",
    "TRK": "Track", "TRCK": "Track", "TYE": "Date", "TYER": "Date", "TDRC": "Date", "TCM": "Author", "TCOM": "Author", "TCR": "Copyright", "TCOP": "Copyright", "COM": "Comment", "COMM": "Comment",
    "TITLE": "Title", "ARTIST": "Artist", "ALBUM": "Album", "ALBUM ARTIST": "Albumartist", "ALBUMARTIST": "Albumartist", "GENRE": "Genre", "TRACK": "Track", "TRACKNUMBER": "Track",
    "YEAR": "Date", "DATE": "Date", "COMPOSER": "Author", "AUTHOR": "Author", "COPYRIGHT": "Copyright", "COMMENT": "Comment",
}

#: A field: its key, where its value begins, how long that is, and where the next field begins.
Field = tuple[str, int, int, int]


def walk(data: bytes, at: int, end: int, most: int | None, cut: Callable[[bytes, int, int], Field | None], value: Callable[[str, bytes], list[tuple[str, str | None]]]) -> Iterator[tuple[str, str | None]]:
    """Fields from `at` to `end`, `most` at most; cut says where one is, or None where no more follow."""
    while at < end and most != 0 and (found := cut(data, at, end)):
        key, begin, size, then = found
        if begin + size > end:
            yield key, None
            return
        yield from value(key, data[begin : begin + size])
        at, most = then, most and most - 1


# --- ID3v2 ----------------------------------------------------------------------------------------------------


def _seven(b: bytes) -> int:
    """A number of seven bits a byte."""
    return sum((x & 0x7F) << 7 * (len(b) - 1 - k) for k, x in enumerate(b))


def _strings(body: bytes) -> list[str]:
    """Texts behind their encoding byte, ended by NUL."""
    code, body = body[:1], body[1:]
    name = {b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}.get(code)
    if name is None:
        return []
    wide = code in (b"\1", b"\2")
    if name == "utf-16" and body[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        name = "utf-16-le"
    text = body[: len(body) // 2 * 2 if wide else None].decode(name, "replace")
    return [s.lstrip("\ufeff") for s in text.rstrip("\0").split("\0")]


def _id3_value(key: str, body: bytes) -> list[tuple[str, str | None]]:
    if key in ("COM", "COMM"):  # a language and a description come first
        said = _strings(body[:1] + body[4:])
        return [(key, said[1] if len(said) > 1 else "")]
    if key in ("TXX", "TXXX"):
        said = _strings(body)
        return [(said[0].upper(), s) for s in said[1:]]
    return [(key, s) for s in _strings(body)] if key.startswith("T") else []


def id3v2_fields(data: bytes) -> list[tuple[str, str | None]] | None:
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4):
        return None
    version, flags, end = data[3], data[5], min(len(data), 10 + _seven(data[6:10]))
    body = data[10:end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and version > 2:
        at = _seven(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    head, n = (6, 3) if version == 2 else (10, 4)

    def cut(b: bytes, at: int, end: int) -> Field | None:
        if at + head > end or not b[at]:  # padding
            return None
        size = b[at + n : at + 2 * n]
        size = _seven(size) if version == 4 else int.from_bytes(size, "big")
        return b[at : at + n].decode("latin-1"), at + head, size, at + head + size

    return list(walk(body, at, len(body), None, cut, _id3_value))


# --- APEv2 and Vorbis -----------------------------------------------------------------------------------------


def ape_fields(data: bytes) -> list[tuple[str, str | None]] | None:
    """The tag at the start, at the end, or at the end before 128 bytes of ID3v1."""
    for foot in (0, len(data) - 32, len(data) - 160):
        if foot >= 0 and data[foot : foot + 8] == b"APETAGEX" and len(data) >= foot + 32:
            _, size, count, flags = struct.unpack_from("<4I", data, foot + 8)
            if flags & 0x20000000:  # this is the header, the items come behind it
                begin, end = foot + 32, min(len(data), foot + size)
            else:
                begin, end = max(0, foot + 32 - size), foot
            break
    else:
        return None

    def cut(b: bytes, at: int, end: int) -> Field | None:
        stop = b.find(b"\0", at + 8, end)
        if stop < 0:
            return None
        size, flags = struct.unpack_from("<2I", b, at)
        return ("" if flags & 6 else b[at + 8 : stop].decode("latin-1")), stop + 1, size, stop + 1 + size

    value = lambda key, body: [(key, s) for s in body.decode("utf-8", "replace").split("\0")] if key else []  # noqa: E731  no key: not a text
    return list(walk(data, begin, end, count, cut, value))


def vorbis_fields(data: bytes) -> list[tuple[str, str | None]] | None:
    """A comment block: a vendor, a number of comments, and these."""
    if len(data) < 8:
        return None
    at = 4 + int.from_bytes(data[:4], "little")
    if at + 4 > len(data):
        return None

    def cut(b: bytes, at: int, end: int) -> Field | None:
        return ("", at + 4, size := int.from_bytes(b[at : at + 4], "little"), at + 4 + size) if at + 4 <= end else None

    def value(_: str, body: bytes) -> list[tuple[str, str | None]]:
        key, said, text = body.decode("utf-8", "replace").partition("=")
        return [(key.upper(), text)] if said else []

    return list(walk(data, at + 4, len(data), int.from_bytes(data[at : at + 4], "little"), cut, value))


def _reader(fields: Callable[[bytes], list | None]):
    def read(content: Column) -> Column:
        @F.arrow_udf(FIELDS)
        def of(files: pa.Array) -> pa.Array:
            found = (None if f.as_py() is None else fields(f.as_py()) for f in files)
            return pa.array([rows and [{"key": k, "value": v} for k, v in rows] if rows is not None else None for rows in found], _ARROW)

        return of(content)

    return read


id3v2, ape, vorbis = _reader(id3v2_fields), _reader(ape_fields), _reader(vorbis_fields)


def named(fields: Column) -> Column:
    """Fields with common names, those that have none left out. A number in the genre, alone or in brackets, becomes its name."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])

    def one(x: Column) -> Column:
        name = F.try_element_at(names, F.upper(x["key"]))
        number = F.regexp_extract(x["value"], r"^\(?(\d{1,3})\)?$", 1).try_cast("int")
        value = F.when((name == "Genre") & number.isNotNull(), F.coalesce(genre_name(number), x["value"])).otherwise(x["value"])
        return F.struct(name.alias("key"), value.alias("value"))

    return F.filter(F.transform(fields, one), lambda x: x["key"].isNotNull())


# --- writing --------------------------------------------------------------------------------------------------


def _little(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])


def _spread(n: Column) -> Column:
    """28 bits as four bytes of seven, in hexadecimal."""
    byte = lambda k: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127).cast("long")), 2, "0")
    return F.concat(*[byte(k) for k in (3, 2, 1, 0)])


def _of(pairs: list[tuple[str, Column]], one: Callable[[str, Column], Column]) -> Column:
    """The fields whose values are there, in hexadecimal."""
    return F.concat(*[F.when(value.isNotNull(), one(key, F.hex(F.encode(value, "UTF-8")))).otherwise("") for key, value in pairs])


def _bytes(text: Column) -> Column:
    return (F.length(text) / 2).cast("long")


def _hex(text: str) -> Column:
    return F.lit(text.encode().hex().upper())


def write_id3v2(pairs: list[tuple[str, Column]]) -> Column:
    """Version 2.4, UTF-8. Fields of NULL values are left out. Comments have no language and description."""

    def one(key: str, value: Column) -> Column:
        body = F.concat(F.lit("03" + ("58585800" if key == "COMM" else "")), value)
        return F.concat(_hex(key), _spread(_bytes(body)), F.lit("0000"), body)

    body = _of(pairs, one)
    return F.unhex(F.concat(F.lit("494433040000"), _spread(_bytes(body)), body))


def write_ape(pairs: list[tuple[str, Column]]) -> Column:
    """Without a header, with a footer."""
    body = _of(pairs, lambda key, value: F.concat(_little(_bytes(value)), F.lit("00000000"), _hex(key), F.lit("00"), value))
    count = sum((value.isNotNull().cast("int") for _, value in pairs), F.lit(0))
    return F.unhex(F.concat(body, F.hex(F.lit("APETAGEX")), F.lit("D0070000"), _little(_bytes(body) + 32), _little(count), F.lit("00" * 12)))


def write_vorbis(pairs: list[tuple[str, Column]]) -> Column:
    body = _of(pairs, lambda key, value: F.concat(_little(_bytes(value) + len(key) + 1), _hex(key + "="), value))
    count = sum((value.isNotNull().cast("int") for _, value in pairs), F.lit(0))
    return F.unhex(F.concat(F.lit("0100000078"), _little(count), body))


#: The genres of ID3, by number.
GENRES = [
    "Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop", "Jazz", "Metal", "New Age", "Oldies", "Other", "Pop", "R&B", "Rap", "Reggae", "Rock", "Techno", "Industrial",
    "Alternative", "Ska", "Death Metal", "Pranks", "Soundtrack", "Euro-Techno", "Ambient", "Trip-Hop", "Vocal", "Jazz+Funk", "Fusion", "Trance", "Classical", "Instrumental", "Acid", "House", "Game",
    "Sound Clip", "Gospel", "Noise", "Alt", "Bass", "Soul", "Punk", "Space", "Meditative", "Instrumental Pop", "Instrumental Rock", "Ethnic", "Gothic", "Darkwave", "Techno-Industrial", "Electronic",
    "Pop-Folk", "Eurodance", "Dream", "Southern Rock", "Comedy", "Cult", "Gangsta Rap", "Top 40", "Christian Rap", "Pop/Funk", "Jungle", "Native American", "Cabaret", "New Wave", "Psychedelic", "Rave",
    "Showtunes", "Trailer", "Lo-Fi", "Tribal", "Acid Punk", "Acid Jazz", "Polka", "Retro", "Musical", "Rock & Roll", "Hard Rock", "Folk", "Folk/Rock", "National Folk", "Swing", "Fast-Fusion", "Bebob",
    "Latin", "Revival", "Celtic", "Bluegrass", "Avantgarde", "Gothic Rock", "Progressive Rock", "Psychedelic Rock", "Symphonic Rock", "Slow Rock", "Big Band", "Chorus", "Easy Listening", "Acoustic",
    "Humour", "Speech", "Chanson", "Opera", "Chamber Music", "Sonata", "Symphony", "Booty Bass", "Primus", "Porn Groove", "Satire", "Slow Jam", "Club", "Tango", "Samba", "Folklore", "Ballad",
    "Power Ballad", "Rhythmic Soul", "Freestyle", "Duet", "Punk Rock", "Drum Solo", "A Cappella", "Euro-House", "Dance Hall", "Goa", "Drum & Bass", "Club-House", "Hardcore", "Terror", "Indie", "BritPop",
    "Negerpunk", "Polsk Punk", "Beat", "Christian Gangsta Rap", "Heavy Metal", "Black Metal", "Crossover", "Contemporary Christian", "Christian Rock", "Merengue", "Salsa", "Thrash Metal", "Anime", "JPop",
    "Synthpop",
]


def genre_name(number: Column) -> Column:
    """The name of an ID3 genre; NULL beyond the list."""
    return F.get(F.array(*[F.lit(g) for g in GENRES]), number)

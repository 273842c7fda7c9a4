"""Expressions on text: cue times, sheet fields, attributes, URLs, tags, characters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timebase import col, floor_div

#: The white space that trimming takes off.
WHITE = r"[ \t\r\n\x0B\f]"


def _int(c: Column) -> Column:
    return c.try_cast("long") if hasattr(c, "try_cast") else c.cast("long")


def srt_time(text: Column | str) -> Column:
    """Milliseconds of h:m:s,ms, where any of , . : separates; NULL if it isn't one."""
    c, p = col(text), r"^\s*(\d+)[,.:](\d+)[,.:](\d+)[,.:](\d+)"
    h, m, s, ms = (_int(F.regexp_extract(c, p, i)) for i in (1, 2, 3, 4))
    return F.when(c.rlike(p), ((h * 60 + m) * 60 + s) * 1000 + ms)


def vtt_time(text: Column | str) -> Column:
    """Milliseconds of [h:]m:s.ms."""
    c, p = col(text), r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})\.(\d{1,3})"
    h = F.coalesce(_int(F.nullif(F.regexp_extract(c, p, 1), F.lit(""))), F.lit(0))
    m, s, ms = (_int(F.regexp_extract(c, p, i)) for i in (2, 3, 4))
    return F.when(c.rlike(p), ((h * 60 + m) * 60 + s) * 1000 + ms)


def cd_frames(text: Column | str, samples: int = 1) -> Column:
    """Frames of m:s:f at 75 a second, times the samples of one; 0 if it can't be read."""
    c, p = col(text), r"^\s*(\d+):(\d+):(\d+)"
    m, s, f = (_int(F.regexp_extract(c, p, i)) for i in (1, 2, 3))
    return F.when(c.rlike(p), (f + 75 * (s + 60 * m)) * samples).otherwise(F.lit(0).cast("long"))


def quoted(text: Column | str) -> Column:
    """What stands between the first and the last quote; NULL if nothing does."""
    return F.nullif(F.regexp_extract(col(text), r'(?s)"(.*)"', 1), F.lit(""))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{WHITE}+|{WHITE}+$", "")


def lines(text: Column | str) -> Column:
    r"""Lines end at \n, and \r is dropped wherever it is; a last line without text isn't one."""
    parts = F.split(F.regexp_replace(col(text), "\r", ""), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def cue_text(text: Column | str) -> Column:
    r"""Without \r, up to the first NUL."""
    return F.substring_index(F.regexp_replace(col(text), "\r", ""), "\0", 1)


def attribute(text: Column | str, key: str) -> Column:
    """The value of KEY="value", at the first place where the key occurs; NULL without one."""
    return F.nullif(F.regexp_extract(col(text), f'{key}="([^"]*)"', 1), F.lit(""))


def live_scheme(url: Column | str) -> Column:
    """http becomes hls, https hlss."""
    return F.regexp_replace(col(url), "^http(s?)://", "hls$1://")


def byte_range(text: Column | str) -> Column:
    """Struct of length and offset of len[@start]."""
    c, p = col(text), r"^(\d+)(?:@(\d+))?"
    return F.struct(_int(F.nullif(F.regexp_extract(c, p, 1), F.lit(""))).alias("length"), _int(F.nullif(F.regexp_extract(c, p, 2), F.lit(""))).alias("offset"))


def stream_title(block: Column | str) -> Column:
    """The title in an in-band metadata block: from StreamTitle=' to the first semicolon, less the quote."""
    return F.nullif(F.regexp_extract(col(block), r"StreamTitle='([^;]*).;", 1), F.lit(""))


def id3_string(text: Column | str) -> Column:
    r"""A fixed-width field without trailing spaces and NULs; one character or none is no value."""
    t = F.regexp_replace(col(text), r"[ \x00]+$", "")
    return F.when(F.length(t) > 1, t)


def date_tag(text: Column | str) -> Column:
    """The key that a date goes under: a year has four characters."""
    return F.when(F.length(col(text)) == 4, "YEAR").otherwise("DATE")


def track_label(number: Column, artist: Column, title: Column) -> Column:
    """`NN artist - title`, `NN title` or `Track NN`, as far as known."""
    n = F.lpad(number.cast("string"), 2, "0")
    return F.when(title.isNull(), F.concat(F.lit("Track "), n)).when(artist.isNull(), F.concat(n, F.lit(" "), title)).otherwise(F.concat(n, F.lit(" "), artist, F.lit(" - "), title))


def charset(data: Column) -> Column:
    """Of binary: UTF-16LE or UTF-16BE by the byte order mark, UTF-8 if valid, else NULL."""
    mark = F.hex(F.substring(data, 1, 2))
    return F.when(mark == "FFFE", "UTF-16LE").when(mark == "FEFF", "UTF-16BE").when(F.is_valid_utf8(data.cast("string")), "UTF-8")


def to_text(data: Column, default: str = "ISO-8859-1") -> Column:
    """Binary as text by its charset, without a byte order mark; what has none is read in the default."""
    kind = charset(data)
    rest = F.substring(data, 3, 1 << 30)
    plain = F.regexp_replace(F.decode(data, "UTF-8"), "^﻿", "")
    return F.when(kind == "UTF-16LE", F.decode(rest, "UTF-16LE")).when(kind == "UTF-16BE", F.decode(rest, "UTF-16BE")).when(kind == "UTF-8", plain).otherwise(F.decode(data, default))


#: The colour names of cue classes; lime and green are the same.
COLOURS = {"white": "#FFFFFF", "lime": "#00FF00", "green": "#00FF00", "cyan": "#00FFFF", "red": "#FF0000", "yellow": "#FFFF00", "magenta": "#FF00FF", "blue": "#0000FF", "black": "#000000"}


def vtt_markup(text: Column | str) -> Column:
    """Cue markup: <c.class.class> becomes a span with the colours that its classes name (`bg_` ones for the background; of several the
    last, whatever the order of the two kinds; unknown ones name none), b, i and u stay, other tags are shown as text.

    Kept tags are put aside behind control characters first, so that escaping can't touch them."""
    t = F.regexp_replace(col(text), "[\x01\x02]", "")
    parts = F.split(t, r"<c\.(?=[^<>]*>)")
    known = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])

    def last(classes: Column, kind: Column) -> Column:
        named = F.filter(F.transform(F.filter(classes, lambda c: c.startswith("bg_") == kind), lambda c: F.try_element_at(known, F.regexp_replace(c, "^bg_", ""))), lambda c: c.isNotNull())
        return F.try_element_at(named, F.lit(-1))

    def span(part: Column) -> Column:
        classes = F.split(F.substring_index(part, ">", 1), r"\.")
        fg, bg = last(classes, F.lit(False)), last(classes, F.lit(True))
        shown = [F.coalesce(F.concat(F.lit(f' {name}="'), c, F.lit('"')), F.lit("")) for name, c in (("foreground", fg), ("background", bg))]
        return F.concat(F.lit("\x01span"), *shown, F.lit("\x02"), F.substr(part, F.instr(part, ">") + 1))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), span)
    t = F.concat(F.element_at(parts, 1), F.array_join(rest, ""))
    t = F.regexp_replace(t, r"</c>", "\x01/span\x02")
    t = F.regexp_replace(t, r"<(/?[biu])>", "\x01$1\x02")
    t = F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.translate(t, "\x01\x02", "<>")


def date_time_us(text: Column | str) -> Column:
    """Microseconds since 1970 of an ISO 8601 date and time with zone."""
    return F.unix_micros(F.try_to_timestamp(col(text)))


def seconds_us(text: Column | str) -> Column:
    """Microseconds of decimal seconds, to the nearest."""
    return floor_div((col(text).cast("decimal(20,7)") * 10_000_000).cast("long") + 5, 10)


def first_of(*columns: Column) -> Column:
    """Of several fields for the same thing, the first that isn't empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def url_variables(url: str | Column) -> Column:
    """The variables behind the question mark as a map, as they are written; of one that repeats the last. What has no = is an empty value; the fragment is no part of them."""
    url = F.col(url) if isinstance(url, str) else url
    said = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(said, "&"), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def with_variables(url: str | Column, variables: Column) -> Column:
    """The address with the variables of a map appended, in the order of their names, before its fragment."""
    url = F.col(url) if isinstance(url, str) else url
    head, fragment = F.regexp_extract(url, "^([^#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(variables)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "&")
    joint = F.when(~head.contains("?"), "?").when(head.rlike("[?&]$"), "").otherwise("&")
    return F.when(F.coalesce(text, F.lit("")) == "", url).otherwise(F.concat(head, joint, text, fragment))


def named_like(name: str | Column, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), ignore_case: bool = True) -> Column:
    """Whether a name or type begins with one of the prefixes or ends with one of the suffixes; false for NULL."""
    name = F.col(name) if isinstance(name, str) else name
    fold = (lambda x: F.lower(x)) if ignore_case else (lambda x: x)
    tests = [fold(name).startswith(fold(F.lit(p))) for p in prefixes] + [fold(name).endswith(fold(F.lit(x))) for x in suffixes]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))

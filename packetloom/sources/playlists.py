"""Playlists and link files: one row a file in (source, text), one row an entry out.

Line formats run along their lines in blocks; markup formats are read by expressions, case-insensitively and without asking for
well-formed XML, which such files often aren't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import text as X
from packetloom.operators import scan

WIDTH = 1 << 14


def lines_of(files: DataFrame) -> DataFrame:
    """source, ord, line: stripped."""
    return files.select("source", F.posexplode(X.lines("text")).alias("ord", "line")).select("source", F.col("ord").cast("long").alias("ord"), X.strip("line").alias("line"))


def parse_m3u(files: DataFrame, width: int = WIDTH) -> DataFrame:
    """source, ord, uri, label, duration_us, logo, country, language, groups (array), referrer, user_agent.

    What stands on # lines goes to the next URI; `--stop--` ends a list. The duration is that of #EXTINF."""
    rows = lines_of(files).filter("line <> ''")
    stop = rows.groupBy("source").agg(F.min(F.when(F.col("line") == "--stop--", F.col("ord"))).alias("__stop"))
    rows = rows.join(stop, "source").filter("__stop is null or ord < __stop").drop("__stop")
    uri = ~F.col("line").startswith("#")
    rows = scan.running_sum(rows, ["source"], "ord", uri.cast("long"), "entry", width)
    inf = F.when(F.col("line").startswith("#EXTINF"), F.col("line"))
    said = rows.groupBy("source", "entry").agg(
        F.max(F.when(uri, F.col("line"))).alias("uri"),
        F.max_by(F.when(inf.isNotNull(), F.col("line")), F.when(inf.isNotNull(), F.col("ord"))).alias("inf"),
        F.max(F.when(F.col("line").startswith("#EXTGRP:"), F.substr("line", F.lit(9)))).alias("grp"),
        F.max(F.when(F.col("line").startswith("#EXTVLCOPT:http-referrer="), F.substring_index("line", "=", -1))).alias("referrer"),
        F.max(F.when(F.col("line").startswith("#EXTVLCOPT:http-user-agent="), F.substring_index("line", "=", -1))).alias("user_agent"),
    )
    seconds = F.nullif(F.regexp_extract("inf", r"^#EXTINF:\s*(\d+(?:\.\d+)?)", 1), F.lit(""))
    label = F.regexp_extract("inf", r'^#EXTINF:(?:[^",]|"[^"]*")*,(.*)$', 1)
    groups = F.coalesce(X.attribute("inf", "group-title"), F.nullif(X.strip("grp"), F.lit("")))
    return said.filter("uri is not null").select(
        "source", F.col("entry").alias("ord"), "uri", F.nullif(X.strip(label), F.lit("")).alias("label"), X.seconds_us(seconds).alias("duration_us"),
        X.attribute("inf", "tvg-logo").alias("logo"), X.attribute("inf", "tvg-country").alias("country"), X.attribute("inf", "tvg-language").alias("language"),
        F.split(groups, ";").alias("groups"), "referrer", "user_agent",
    )


def is_segment_list(files: DataFrame) -> DataFrame:
    """source, live: a list with a media sequence is a segment list, and stands for one live row under an hls scheme."""
    return files.select("source", F.col("text").rlike(r"(?m)^#EXT-X-MEDIA-SEQUENCE").alias("live"))


def parse_segments(files: DataFrame, width: int = WIDTH) -> DataFrame:
    """Segments of live lists: source, seq, uri, duration_us, discontinuity, program_us, length and offset of a byte range."""
    rows = lines_of(files).filter("line <> ''")
    uri = ~F.col("line").startswith("#")
    first = rows.groupBy("source").agg(F.max(F.regexp_extract("line", r"^#EXT-X-MEDIA-SEQUENCE:(\d+)", 1).try_cast("long")).alias("__first"))
    rows = scan.running_sum(rows, ["source"], "ord", uri.cast("long"), "entry", width)
    value = lambda tag: F.max(F.when(F.col("line").startswith(tag + ":"), F.substr("line", F.lit(len(tag) + 2))))
    said = rows.groupBy("source", "entry").agg(
        F.max(F.when(uri, F.col("line"))).alias("uri"), value("#EXTINF").alias("inf"), F.max(F.col("line") == "#EXT-X-DISCONTINUITY").alias("discontinuity"),
        value("#EXT-X-PROGRAM-DATE-TIME").alias("date"), value("#EXT-X-BYTERANGE").alias("bytes"),
    )
    out = said.filter("uri is not null").join(first, "source")
    return out.select(
        "source", (F.coalesce("__first", F.lit(0)) + F.col("entry")).alias("seq"), "uri", X.seconds_us(F.substring_index("inf", ",", 1)).alias("duration_us"),
        "discontinuity", X.date_time_us("date").alias("program_us"), X.byte_range("bytes").alias("__b"),
    ).select("*", "__b.*").drop("__b")


def _listed(line, key: str):
    """The value of KEY=value in a list of attributes, with or without quotes."""
    found = F.regexp_extract(line, rf'(?:^|[:,])\s*{key}=(?:"([^"]*)"|([^",]*))', 0)
    return F.nullif(F.btrim(F.regexp_replace(found, rf"^[:,]?\s*{key}=", ""), F.lit('"')), F.lit(""))


def parse_variants(files: DataFrame, width: int = WIDTH) -> DataFrame:
    """Variants of master lists: source, ord, uri, bandwidth, width, height, frame_rate, audio, subtitles (names of groups). What an
    #EXT-X-STREAM-INF says goes to the next URI; a URI without one is no variant."""
    rows = lines_of(files).filter("line <> ''")
    uri = ~F.col("line").startswith("#")
    inf = F.when(F.col("line").startswith("#EXT-X-STREAM-INF:"), F.substr("line", F.lit(18)))
    rows = scan.run(rows.withColumn("__inf", inf), ["source"], "ord", {"entry": scan.Sum(uri.cast("long"))}, width)
    said = rows.groupBy("source", "entry").agg(F.max(F.when(uri, F.col("line"))).alias("uri"), F.max_by("__inf", F.when(F.col("__inf").isNotNull(), F.col("ord"))).alias("inf"))
    said = said.filter("uri is not null and inf is not null")
    size = _listed("inf", "RESOLUTION")
    return said.select(
        "source", F.col("entry").alias("ord"), "uri", _listed("inf", "BANDWIDTH").try_cast("long").alias("bandwidth"), F.substring_index(size, "x", 1).try_cast("int").alias("width"),
        F.substring_index(size, "x", -1).try_cast("int").alias("height"), _listed("inf", "FRAME-RATE").try_cast("double").alias("frame_rate"), _listed("inf", "AUDIO").alias("audio"),
        _listed("inf", "SUBTITLES").alias("subtitles"),
    )


def parse_media(files: DataFrame) -> DataFrame:
    """Renditions of master lists: source, ord, type, group_id, name, language, uri."""
    rows = lines_of(files).filter(F.col("line").startswith("#EXT-X-MEDIA:"))
    told = rows.withColumn("m", F.substr("line", F.lit(13)))
    return told.select("source", "ord", *[_listed("m", key).alias(name) for key, name in (("TYPE", "type"), ("GROUP-ID", "group_id"), ("NAME", "name"), ("LANGUAGE", "language"), ("URI", "uri"))])


def parse_pls(files: DataFrame, width: int = WIDTH) -> DataFrame:
    """source, ord, uri, label: the n-th File with the n-th Title, whatever their numbers."""
    rows = lines_of(files)
    kind = F.when(F.col("line").rlike("^File[0-9]*="), "f").when(F.col("line").rlike("^Title[0-9]*="), "t")
    rows = rows.withColumn("kind", kind).filter("kind is not null").withColumn("value", X.strip(F.regexp_replace("line", "^[^=]*=", "")))
    rows = scan.row_number(rows, ["source", "kind"], "ord", "n", width)
    return rows.groupBy("source", F.col("n").alias("ord")).agg(
        F.max(F.when(F.col("kind") == "f", F.col("value"))).alias("uri"), F.max(F.when(F.col("kind") == "t", F.col("value"))).alias("label")
    ).filter("uri is not null")


def parse_ref(files: DataFrame) -> DataFrame:
    """source, ord, uri of [Reference] files: Ref1=, Ref2=, ..."""
    rows = lines_of(files).withColumn("uri", F.regexp_extract("line", r"(?i)^Ref\d+\s*=\s*(.*)$", 1)).filter("uri <> ''")
    return rows.select("source", "ord", "uri")


def _tags(text: str, name: str):
    return F.regexp_extract_all(F.col(text), F.lit(rf"(?is)(<{name}\b[^>]*>)"), 1)


def _value(tag, key: str):
    return F.nullif(F.regexp_extract(tag, rf'(?i)\b{key}\s*=\s*["\']([^"\']*)', 1), F.lit(""))


def parse_asx(files: DataFrame, width: int = WIDTH) -> DataFrame:
    """source, ord, uri, label: a row for each Ref, with its entry's title, else `Stream N`."""
    entry = F.regexp_extract_all("text", F.lit(r"(?is)<entry\b[^>]*>(.*?)</entry\s*>"), 1)
    e = files.select("source", F.posexplode(entry).alias("e", "body"))
    title = F.nullif(X.strip(F.regexp_extract("body", r"(?is)<title\b[^>]*>(.*?)</title", 1)), F.lit(""))
    r = e.select("source", "e", title.alias("title"), F.posexplode(_tags("body", "ref")).alias("r", "tag"))
    found = r.withColumns({"uri": _value(F.col("tag"), "href"), "e": F.col("e").cast("long")}).filter("uri is not null")
    out = scan.row_number(found, ["source"], "e", "ord", width, ["r"])
    return out.select("source", "ord", "uri", F.coalesce("title", F.concat(F.lit("Stream "), (F.col("ord") + 1).cast("string"))).alias("label"))


def count_urls(files: DataFrame) -> DataFrame:
    """source, urls: how many addresses a list of markup has, at any depth: references of ASX, sounds and pictures of SMIL."""
    return files.select("source", (F.size(_tags("text", "ref")) + F.size(_tags("text", "audio")) + F.size(_tags("text", "video"))).cast("long").alias("urls"))


def parse_smil(files: DataFrame) -> DataFrame:
    """source, ord, uri, label: audio and video sources, relative ones behind the base of the head, else behind the file's folder."""
    meta = lambda name: F.regexp_extract("text", rf'(?is)<meta\b[^>]*name\s*=\s*["\']{name}["\'][^>]*content\s*=\s*["\']([^"\']*)', 1)
    folder = F.regexp_replace("source", "[^/]*$", "")
    base = F.coalesce(F.nullif(meta("base"), F.lit("")), folder)
    parts = F.regexp_extract_all("text", F.lit(r"(?is)(<(?:audio|video)\b[^>]*>)"), 1)
    rows = files.select("source", base.alias("base"), F.nullif(meta("title"), F.lit("")).alias("label"), F.posexplode(parts).alias("ord", "tag"))
    src = _value(F.col("tag"), "src")
    uri = F.when(src.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), src).otherwise(F.concat(F.regexp_replace("base", "/$", ""), F.lit("/"), src))
    return rows.filter(src.isNotNull()).select("source", F.col("ord").cast("long").alias("ord"), uri.alias("uri"), "label")


def parse_qtl(files: DataFrame) -> DataFrame:
    """source, ord, uri: the src of a link file's embed."""
    return files.select("source", F.lit(0).cast("long").alias("ord"), _value(F.element_at(_tags("text", "embed"), 1), "src").alias("uri")).filter("uri is not null")


def live_url(entries: DataFrame) -> DataFrame:
    return entries.withColumn("uri", X.live_scheme("uri"))


def parse_cue(files: DataFrame, sample_rate: int = 44100) -> DataFrame:
    """Audio tracks of cue sheets: source, track, title, performer, start (samples; index 1, or the only one), first (its first
    index), end (the next track's first index; NULL for the last), label.

    A sheet is cut before each TRACK line; all that a track needs stands in its own part, but for the next one's first index, which
    is taken along before the parts become rows. Nothing is shuffled."""
    line = lambda part, key: F.regexp_extract(part, rf"(?im)^[ \t]*{key}\s[^\n]*", 0)
    said = lambda part, key: X.quoted(line(part, key))

    def index(part, number: str):
        p = rf"(?im)^[ \t]*INDEX\s+{number}\s+(\S+)"
        return F.when(part.rlike(p), X.cd_frames(F.regexp_extract(part, p, 1), sample_rate // 75))

    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r", "")), r"(?im)^(?=[ \t]*TRACK\s)")  # the first holds what is said of the disc
    cut_ = files.select("source", said(F.element_at(parts, 1), "PERFORMER").alias("__artist"), F.slice(parts, 2, F.size(parts)).alias("__parts"))
    cut_ = cut_.withColumn("__firsts", F.transform("__parts", lambda p: index(p, r"\d+")))
    t = cut_.select("source", "__artist", "__firsts", F.posexplode("__parts").alias("__i", "__part"))
    part, head = F.col("__part"), r"(?i)^[ \t]*TRACK\s+(\d+)\s+(\S+)"
    audio = t.filter(F.upper(F.regexp_extract(part, head, 2)) == "AUDIO").select(
        "source", F.regexp_extract(part, head, 1).try_cast("int").alias("track"), said(part, "TITLE").alias("title"), F.coalesce(said(part, "PERFORMER"), "__artist").alias("performer"),
        index(part, "0*1").alias("one"), F.get("__firsts", F.col("__i")).alias("first"), F.get("__firsts", F.col("__i") + 1).alias("end"),
    )
    label = X.track_label(F.col("track"), F.col("performer"), F.col("title"))
    return audio.select("source", "track", "title", "performer", F.coalesce("one", "first").alias("start"), "first", "end", label.alias("label"))

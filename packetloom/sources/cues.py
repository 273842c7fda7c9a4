"""Text cues from SubRip and WebVTT files: one row a file in, one row a cue out.

A file is split at its blank lines, so a cue is parsed by expressions on its own block; only what a file says for the cues behind
it (offsets and scales) runs along its blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import text as X
from packetloom.functions.timebase import rescale
from packetloom.operators import scan

WIDTH = 1 << 12


def read_files(spark: SparkSession, path: str, default: str = "ISO-8859-1") -> DataFrame:
    """source, text: files whole, by their byte order mark or as UTF-8, else in the default character set."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source"), X.to_text(F.col("content"), default).alias("text"))


def _blocks(files: DataFrame) -> DataFrame:
    """source, ord, block: a block is what stands between blank lines."""
    body = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r", "")
    return files.select("source", F.posexplode(F.split(body, r"\n[ \t]*\n\s*")).alias("ord", "block")).withColumn("ord", F.col("ord").cast("long"))


def _after(block, pattern):
    """The lines behind the first that has the pattern."""
    return F.regexp_extract(block, r"(?s)^(?:[^\n]*\n)*?[^\n]*" + pattern + r"[^\n]*\n(.*)$", 1)


def parse_srt(files: DataFrame, width: int = WIDTH) -> DataFrame:
    """source, ord, pts, duration (ms), text. @OFF=seconds adds to the offset of all cues behind it; @SCALE=n:d scales them."""
    b = _blocks(files)
    off = F.regexp_extract_all("block", F.lit(r"(?m)^@OFF=(-?[0-9.]+)"), 1)
    scale = F.regexp_extract_all("block", F.lit(r"(?m)^@SCALE=(\d+:\d+)"), 1)
    b = b.withColumns({
        "__off": F.aggregate(off, F.lit(0).cast("long"), lambda a, x: a + (x.cast("double") * 1000).cast("long")),
        "__scale": F.when(F.size(scale) > 0, F.element_at(scale, -1)),
    })
    b = scan.running_sum(b, ["source"], "ord", F.col("__off"), "__offset", width, inclusive=True)
    b = scan.last_known(b, ["source"], "ord", {"__ratio": F.col("__scale")}, width)
    line = F.regexp_extract("block", r"(?m)^([^\n]*-->[^\n]*)$", 1)
    start, end = X.srt_time(F.substring_index(line, "-->", 1)), X.srt_time(F.trim(F.substring_index(line, "-->", -1)))
    n, d = (F.split(F.coalesce("__ratio", F.lit("1:1")), ":")[i].cast("long") for i in (0, 1))
    cues = b.withColumns({"__s": start, "__e": end, "__n": n, "__d": d}).filter("__s is not null and __e is not null")
    at = lambda c: rescale(F.col(c) + F.col("__offset"), F.col("__d"), F.col("__n"))
    cues = cues.withColumns({"pts": at("__s"), "duration": at("__e") - at("__s"), "text": F.rtrim(X.cue_text(_after("block", "-->")))})
    return cues.withColumn("text", F.regexp_replace("text", r"\n+$", "")).select("source", "ord", "pts", "duration", "text")


def parse_vtt(files: DataFrame) -> DataFrame:
    """source, ord, pts, duration (ms), text. A header's X-TIMESTAMP-MAP moves all cues by MPEGTS / 90000 - LOCAL; without one
    they stay. Markup is rewritten as vtt_markup does."""
    head = F.regexp_extract("text", r"(?m)^X-TIMESTAMP-MAP=([^\r\n]*)", 1)
    ts = F.nullif(F.regexp_extract(head, r"MPEGTS:(\d+)", 1), F.lit("")).cast("long")
    local = X.vtt_time(F.regexp_extract(head, r"LOCAL:([0-9:.]+)", 1))
    told = files.filter(F.col("text").rlike("^﻿?WEBVTT")).withColumn("__off", F.coalesce(rescale(ts, 90_000, 1000) - local, F.lit(0)))
    body = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r", "")
    b = told.select("source", "__off", F.posexplode(F.split(body, r"\n[ \t]*\n\s*")).alias("ord", "block"))
    line = F.regexp_extract("block", r"(?m)^([^\n]*-->[^\n]*)$", 1)
    start, end = X.vtt_time(F.substring_index(line, "-->", 1)), X.vtt_time(F.trim(F.substring_index(line, "-->", -1)))
    cues = b.withColumns({"__s": start, "__e": end}).filter("__s is not null and __e is not null")
    text = X.vtt_markup(F.regexp_replace(X.cue_text(_after("block", "-->")), r"\s+$", ""))
    return cues.select("source", F.col("ord").cast("long").alias("ord"), (F.col("__s") + F.col("__off")).alias("pts"), (F.col("__e") - F.col("__s")).alias("duration"), text.alias("text"))


def _clock(ms, mark: str):
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat(two(F.floor(ms / 3_600_000)), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def write_srt(cues: DataFrame, key: str) -> DataFrame:
    """source, text: the cues of each key as one SubRip text. A key's cues make one file, so one row must hold them."""
    block = F.concat((F.col("ord") + 1).cast("string"), F.lit("\n"), _clock(F.col("pts"), ","), F.lit(" --> "), _clock(F.col("pts") + F.col("duration"), ","), F.lit("\n"), F.col("text"), F.lit("\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"])
    return cues.groupBy(F.col(key).alias("source")).agg(F.array_join(ordered, "\n").alias("text"))


def write_vtt(cues: DataFrame, key: str) -> DataFrame:
    block = F.concat(_clock(F.col("pts"), "."), F.lit(" --> "), _clock(F.col("pts") + F.col("duration"), "."), F.lit("\n"), F.col("text"), F.lit("\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"])
    return cues.groupBy(F.col(key).alias("source")).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(ordered, "\n")).alias("text"))

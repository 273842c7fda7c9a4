"""Look-ups: by time, by registry order, by ordinal ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .packets import WIDTH

def first_match(rows: DataFrame, registry: DataFrame, on: str, priority: str, keep: Sequence[str]) -> DataFrame:
    """Left join with the registered row of the same `on` that comes first. The registry is cut to one row a key before the join, which
    Spark broadcasts if it finds the registry small in bytes."""
    best = registry.groupBy(on).agg(F.min_by(F.struct(*keep), priority).alias("__m"))
    return rows.join(best, on, "left").select(*rows.columns, *[F.col("__m")[c].alias(c) for c in keep])


def timecodes(packets: DataFrame, table: DataFrame) -> DataFrame:
    """Left join on stream and pts; of several timecodes for a pts, the least."""
    one = table.groupBy("stream_id", "pts").agg(F.min("timecode").alias("timecode"))
    return packets.join(one, ["stream_id", "pts"], "left")


def keyframe_before(probes: DataFrame, packets: DataFrame, t: str, width: int | None = None) -> DataFrame:
    """For each probe (stream_id, t): of the keyframes with pts < t, the last in index order, as key_idx and key_pts.

    Where pts rises with idx that is the as-of row. Where it doesn't, it is the greatest idx so far in pts order, and
    that is what is carried here, so both agree."""
    return _extreme(probes, packets, t, width, forward=False)


def keyframe_after(probes: DataFrame, packets: DataFrame, t: str, width: int | None = None) -> DataFrame:
    """For each probe: of the keyframes with pts > t, the first in index order."""
    return _extreme(probes, packets, t, width, forward=True)


def _extreme(probes: DataFrame, packets: DataFrame, t: str, width: int | None, forward: bool) -> DataFrame:
    """The least (forward) or greatest idx among the keyframes strictly behind or before t: a running extreme in pts order,
    along the stream in its own direction, so that as_of can take it."""
    keys = packets.filter("keyframe and pts is not null").select("stream_id", "idx", "pts")
    width = width or scan.width_for(packets, "pts")
    sign = -1 if forward else 1
    turned = keys.select("stream_id", (F.col("pts") * sign).alias("__p"), (F.col("idx") * sign).alias("__i"), F.struct("idx", "pts").alias("__r"))
    best = scan.run(turned, ["stream_id"], "__p", {"__best": scan.Max(F.struct("__i", "__r"), inclusive=True)}, width, ["__i"])
    facts = best.select("stream_id", "__p", "__i", F.col("__best")["__r"]["idx"].alias("key_idx"), F.col("__best")["__r"]["pts"].alias("key_pts"))
    asked = probes.withColumn("__t", F.col(t) * sign)
    return scan.as_of(asked, facts, ["stream_id"], "__t", "__p", ["key_idx", "key_pts"], width, strict=True, ties=["__i"]).drop("__t")


def cue_for(probes: DataFrame, cues: DataFrame, keys: Sequence[str], t: str, cue_time: str, take: Sequence[str], width: int | None = None) -> DataFrame:
    """The last cue at or before t, else the first of all."""
    got = scan.as_of(probes, cues, keys, t, cue_time, take, width, first="__first")
    missing = F.col(take[0]).isNull() & F.col(t).isNotNull()
    return got.withColumns({c: F.when(missing, F.col("__first")[c]).otherwise(F.col(c)) for c in take}).drop("__first")


def seek_index(probes: DataFrame, packets: DataFrame, t: str, preroll: int, width: int | None = None) -> DataFrame:
    """For each probe (stream_id, t): the packet at or before t (seek_idx, seek_pts), the keyframe at or before that one
    (start_idx), and the time from which to decode, pts of that keyframe less the preroll, not before the stream's start.
    A t before the stream's start means its first packet. A probe whose t or stream is NULL, or whose stream has no packet,
    stays and gets NULLs."""
    width = width or scan.width_for(packets, "pts")
    keyed = scan.last_known(packets, ["stream_id"], "idx", {"__k": F.when(F.col("keyframe"), F.struct("idx", "pts"))}, WIDTH)
    facts = keyed.select("stream_id", "pts", F.col("idx").alias("seek_idx"), F.col("pts").alias("seek_pts"), F.col("__k")["idx"].alias("start_idx"), F.col("__k")["pts"].alias("__kp"))
    found = scan.as_of(probes, facts, ["stream_id"], t, "pts", ["seek_idx", "seek_pts", "start_idx", "__kp"], width, ties=["seek_idx"], first="__first")
    found = found.withColumns({"pts_start": F.col("__first")["seek_pts"], "__idx": F.col("__first")["seek_idx"]}).drop("__first")
    none, asked = F.col("seek_idx").isNull(), F.col(t).isNotNull()
    found = found.withColumns({
        "seek_idx": F.when(none & asked, F.col("__idx")).otherwise(F.col("seek_idx")),
        "seek_pts": F.when(none & asked, F.col("pts_start")).otherwise(F.col("seek_pts")),
    })
    start = F.coalesce(F.col("start_idx"), F.col("__idx"))
    at = F.greatest(F.coalesce(F.col("__kp"), F.col("pts_start")) - preroll, F.col("pts_start"))
    return found.withColumns({"start_idx": F.when(asked, start), "decode_from": F.when(asked, at)}).drop("__idx", "__kp", "pts_start")


def nth_frame(wanted: DataFrame, packets: DataFrame, frame: str, width: int | None = None) -> DataFrame:
    """wanted (stream_id, `frame`, from 0) with idx and pts of that frame in the order of time; NULL where a stream has fewer, or the number is negative. Packets without a time are no frames."""
    timed = packets.filter("pts is not null").select("stream_id", "idx", "pts")
    numbered = scan.row_number(timed, ["stream_id"], "pts", "__n", width, ["idx"])
    return wanted.join(numbered.withColumnRenamed("__n", frame), ["stream_id", frame], "left")


def clock_start(probes: DataFrame, segments: DataFrame, keys: Sequence[str], t: str, width: int | None = None) -> DataFrame:
    """Where a live list is entered by the clock: for each probe the last segment that starts at t or before (seq), else the first that has a clock, and t set to when that one starts. A list without a clock
    leaves t as it is and has no seq."""
    known = segments.filter("clock_us is not null").select(*keys, "seq", F.col("clock_us").alias("__at"))
    got = cue_for(probes, known, keys, t, "__at", ["seq", "__at"], width)
    return got.withColumn(t, F.coalesce("__at", t)).drop("__at")


def table_of_contents(percent: Column, entries: Column, size: Column) -> Column:
    """The byte at a percentage of the playing time, by a table of a hundred entries of 256ths of the size, between which it is interpolated. NULL without a whole table."""
    at = F.least(F.greatest(percent.cast("double"), F.lit(0.0)), F.lit(100.0))
    low = F.least(F.floor(at), F.lit(99)).cast("int")
    a, b = F.get(entries, low), F.coalesce(F.get(entries, low + 1), F.lit(256))
    return F.when(F.size(entries) == 100, F.floor((a + (b - a) * (at - low)) * size / 256).cast("long"))


def range_lookup(rows: DataFrame, steps: DataFrame, keys: Sequence[str], ordinal: str, first: str, take: Sequence[str], width: int = WIDTH) -> DataFrame:
    """A table of steps says from which ordinal on its values hold: left join of each row with its step."""
    return scan.as_of(rows, steps, keys, ordinal, first, take, width)


def discontinuity(rows: DataFrame, segments: DataFrame, key: str, wanted: Column) -> DataFrame:
    """The first segment whose discontinuity number is wanted, as `segment`; -1 where there is none."""
    first = segments.groupBy(F.col("dseq").alias("__d")).agg(F.min("idx").alias("segment"))
    return rows.withColumn("__d", wanted).join(first, "__d", "left").withColumn("segment", F.coalesce("segment", F.lit(-1))).drop("__d")


def variant_groups(variants: DataFrame, media: DataFrame, group: str | Sequence[str] = "group_id") -> DataFrame:
    """Variants left joined with the renditions of their group, of which only those with a URI count."""
    return variants.join(media.filter("uri is not null"), [group] if isinstance(group, str) else list(group), "left")

"""Selection, aggregation and timing of packets.

A packet row has stream_id, idx (its position in the index), pts, duration, size and keyframe, and what an operator names besides.
All of an operator's windows run in blocks of idx or pts (see scan), so no stream is bound to one task."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.timebase import div, floor_div

from . import scan

#: Width of a block of idx or pts when none is given.
WIDTH = 1 << 20


# --- selection ------------------------------------------------------------------------------------------------


def select_streams(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Packets of streams that are not muted; packets of unknown streams are dropped."""
    return packets.join(streams.filter(F.col("action") != "mute").select("stream_id"), "stream_id", "left_semi")


def default_actions(streams: DataFrame, chosen: Iterable[int] = ()) -> DataFrame:
    """After a track is selected, all streams but message streams are muted until chosen."""
    live = (F.col("kind") == "msg") | F.col("stream_id").isin(*chosen)
    return streams.withColumn("action", F.when(live, "decode").otherwise("mute"))


def drop_empty(streams: DataFrame, packets: DataFrame, key: str = "stream_id") -> DataFrame:
    """Streams with at least one packet."""
    return streams.join(packets.select(key).distinct(), key, "left_semi")  # summed before it is shuffled: a row a stream and task


def empty_streams(streams: DataFrame, packets: DataFrame, key: str = "stream_id") -> DataFrame:
    return streams.join(packets.select(key).distinct(), key, "left_anti")


def drop_unsupported(streams: DataFrame, decoders: DataFrame, key: str = "fourcc") -> DataFrame:
    """Streams for which a decoder is registered."""
    return streams.join(decoders.select(key).distinct(), key, "left_semi")


def skip_mode(packets: DataFrame, mode: str) -> DataFrame:
    """none keeps all; nonref drops B packets that nothing refers to; nonkey keeps keyframes."""
    rule = {
        "none": F.lit(True),
        "nonref": ~((F.col("coding_type") == "B") & ~F.col("ref")),
        "nonkey": F.col("keyframe"),
    }
    return packets.filter(rule[mode])


def drop_flagged(packets: DataFrame) -> DataFrame:
    """Packets that the parser flags to be skipped never reach a sink."""
    return packets.filter(~F.coalesce(F.col("skip"), F.lit(False)))


def wait_for_keyframe(packets: DataFrame, key: str = "stream_id", waits: Column | None = None) -> DataFrame:
    """From each stream's first keyframe on, by index; a stream without one gives nothing. `waits`, a column that is the same for all
    packets of a stream, says which streams wait: those with P packets do."""
    seen = scan.run(packets, [key], "idx", {"__seen": scan.Last(F.when(F.col("keyframe"), F.lit(True)))}, WIDTH)
    return seen.filter(F.col("__seen").isNotNull() | ~(F.lit(True) if waits is None else waits)).drop("__seen")


def skip_to_audio(packets: DataFrame, t: Column) -> DataFrame:
    """From the packet that holds t or the first after it; `trim` says how many units of that packet lie before t."""
    kept = packets.filter((F.col("pts") > t) | ((F.col("pts") <= t) & (t < F.col("pts") + F.col("duration"))))
    return kept.withColumn("trim", F.when(F.col("pts") < t, t - F.col("pts")).otherwise(F.lit(0)).cast("long"))


def skip_to_intra(packets: DataFrame, t: Column) -> DataFrame:
    """Of each stream, the first packet by pts that ends after t."""
    ends = packets.filter(F.col("pts") + F.col("duration") > t)
    return _first_by(ends, ["pts", "idx"])


def skip_to_predicted(packets: DataFrame, t: Column) -> DataFrame:
    """Of each stream, the first packet by pts that ends at t or after; without a duration, that begins there."""
    end = F.when(F.col("duration") > 0, F.col("pts") + F.col("duration")).otherwise(F.col("pts"))
    return _first_by(packets.filter(end >= t), ["pts", "idx"])


def skip_to_text(cues: DataFrame, t: Column) -> DataFrame:
    """Cues that end at t or after."""
    return cues.filter(F.col("pts") + F.col("duration") >= t)


def _first_by(df: DataFrame, order: Sequence[str], key: str = "stream_id") -> DataFrame:
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.min_by(whole, F.struct(*order)).alias("__r")).select("__r.*")


def trim_pre_skip(packets: DataFrame, samples: int) -> DataFrame:
    """Without the first `samples` samples of each stream: `data` arrays are cut where the limit falls."""
    before = scan.running_sum(packets, ["stream_id"], "idx", F.size("data").cast("long"), "__n", WIDTH)
    cut_ = F.greatest(F.lit(0), F.least(F.lit(samples) - F.col("__n"), F.size("data"))).cast("int")
    left = F.slice("data", cut_ + 1, F.size("data") - cut_)
    return before.withColumn("data", F.when(cut_ > 0, left).otherwise(F.col("data"))).filter(F.size("data") > 0).drop("__n")


def clamp_last(packets: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Durations that overshoot their stream's pts_end end there. Without streams that is its last pts, which a scan carries, so no join meets a hot stream; there packets without a stream are one."""
    if streams is None:
        ended = scan.run(packets, ["stream_id"], "idx", {"pts_end": scan.Top(F.col("pts"))}, WIDTH)
    else:
        ended = packets.join(streams.select("stream_id", "pts_end"), "stream_id", "left")
    over = F.col("pts") + F.col("duration") > F.col("pts_end")
    return ended.withColumn("duration", F.when(over, F.greatest(F.col("pts_end") - F.col("pts"), F.lit(0))).otherwise(F.col("duration"))).drop("pts_end")


# --- aggregation ----------------------------------------------------------------------------------------------


def stream_stats(packets: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    return packets.groupBy(*keys).agg(
        F.min("pts").alias("pts_start"),
        F.max(F.col("pts") + F.col("duration")).alias("pts_end"),
        F.count(F.lit(1)).alias("total_packets"),
        F.sum("size").alias("total_bytes"),
        F.min("duration").alias("duration_min"),
        F.max("duration").alias("duration_max"),
    )


def index_range(packets: DataFrame, key: str = "stream_id") -> DataFrame:
    return packets.groupBy(key).agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def interleaving(packets: DataFrame, key: str = "stream_id") -> DataFrame:
    """One row: non_interleaved is true if two neighbouring streams, by id, share no range of the index."""
    ranges = scan.lag(index_range(packets, key), [], key, {"__a": F.col("first_idx"), "__b": F.col("last_idx")}, WIDTH)
    apart = (F.col("__b") < F.col("first_idx")) | (F.col("__a") > F.col("last_idx"))
    return ranges.withColumn("apart", F.coalesce(apart, F.lit(False))).agg(F.coalesce(F.max("apart"), F.lit(False)).alias("non_interleaved"))


def sample_count(packets: DataFrame, key: str = "stream_id") -> DataFrame:
    """Valid samples, without those before time zero."""
    return packets.groupBy(key).agg((F.sum("duration") + F.least(F.min("pts"), F.lit(0))).alias("samples"))


def sync_time(streams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest next pts of a track's active streams, in microseconds; NULL if one of them has none left."""
    active = streams.filter(~F.col("discontinuous"))
    return active.groupBy(*keys).agg(F.when(F.max(F.col("next_pts").isNull().cast("int")) == 0, F.max("next_pts")).alias("sync_time"))


# --- time along a stream --------------------------------------------------------------------------------------


def fill_durations(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """Streams whose first entry has no duration get lead(pts) - pts, in index order. Their last entry gets what is left up
    to the stream's pts_end, if that is known and positive and it has no duration itself."""
    steps = {"__next": scan.Next(F.struct("pts"), inclusive=False), "__first": scan.First(F.struct("duration"))}
    filled = scan.run(packets, ["stream_id"], "idx", steps, width)
    tail = F.col("pts_end") - F.col("pts")
    new = F.when(F.col("__next").isNotNull(), F.col("__next")["pts"] - F.col("pts")).when((F.col("duration") <= 0) & (tail > 0), tail).otherwise(F.col("duration"))
    return filled.withColumn("duration", F.when(F.col("__first")["duration"] == 0, new).otherwise(F.col("duration"))).drop("__next", "__first")


def running_dts(packets: DataFrame, start: Column, width: int = WIDTH) -> DataFrame:
    """dts: the start plus the durations of all earlier packets."""
    return scan.running_sum(packets, ["stream_id"], "idx", F.col("duration"), "dts", width).withColumn("dts", F.col("dts") + start)


def scaled_position(packets: DataFrame, value: Column, scale: Column | int, rate: Column | int, width: int = WIDTH) -> DataFrame:
    """pts of cumulative counts or bytes: the sum of all earlier ones, times scale, divided by rate with truncation."""
    summed = scan.running_sum(packets, ["stream_id"], "idx", value, "__n", width)
    return summed.withColumn("pts", div(F.col("__n") * scale, rate)).drop("__n")


def drop_zero_size(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """Packets without payload aren't indexed, but their time passes: pts is summed before they go. `variable` marks the
    streams that had some."""
    steps = {"pts": scan.Sum(F.col("duration")), "variable": scan.Top(F.col("size") == 0)}
    return scan.run(packets, ["stream_id"], "idx", steps, width).filter("size > 0")


def coding_types(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """coding_type from pts, in index order: keyframes are I; what lies before the greatest pts since the last keyframe is B;
    the rest is P. A row before any keyframe counts as if one had no pts; one without an index gets NULL.

    The running maximum restarts at keyframes: inside a block, in the groups that these open; a block carries on the maximum behind
    its last keyframe, and without one, that of all before it since theirs. So one pass is enough."""
    b = scan.Blocks(packets, ["stream_id"], "idx", width)
    rows = b.df.withColumn("__gop", F.sum(F.coalesce(F.col("keyframe"), F.lit(False)).cast("long")).over(b.local(None, 0)))
    on = [*b.by, b.block]
    last = rows.groupBy(*on, "__gop").agg(F.max(F.when(F.col("idx").isNotNull(), F.col("pts"))).alias("__m"))
    last = last.groupBy(*on).agg(F.max("__gop").alias("__keys"), F.max_by("__m", "__gop").alias("__m"))
    group = F.sum((F.col("__keys") > 0).cast("long")).over(Window.partitionBy(*b.by).orderBy(b.block).rowsBetween(Window.unboundedPreceding, 0))
    # A block with a keyframe opens a group of blocks with what is behind its last one.
    last = last.withColumn("__group", group)
    last = last.withColumn("__upto", F.max("__m").over(Window.partitionBy(*b.by, "__group").orderBy(b.block).rowsBetween(Window.unboundedPreceding, 0)))
    carry = last.select(*on, F.lag("__upto").over(Window.partitionBy(*b.by).orderBy(b.block)).alias("__c"))
    own = F.max("pts").over(b.local(None, -1, also=["__gop"]))
    high = F.when(F.col("__gop") == 0, F.greatest("__c", own)).otherwise(own)
    kind = F.when(F.col("keyframe"), "I").when(F.col("pts") < high, "B").otherwise("P")
    return rows.join(carry, on).withColumn("coding_type", b.placed(kind)).drop(*on, "__gop", "__c")


def display_order(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """display: the place in which a packet is shown. A packet that isn't B waits for the next such one, B packets pass it.

    So a B packet is shown one place earlier than it is stored, if there is a packet for it to pass; another one is shown where
    the next such packet is stored, less one, and the last one at the end."""
    b = scan.Blocks(packets, ["stream_id"], "idx", width)
    on = [*b.by, b.block]
    plain = F.when(F.col("coding_type") != "B", F.col("__i"))
    rows = b.df.withColumn("__i", F.row_number().over(b.local(None, 0)).cast("long") - 1)
    totals = rows.groupBy(*on).agg(F.count("idx").alias("__n"), F.min(plain).alias("__plain"))
    # A row a block: how many packets are before it, whether one of them isn't B, the next behind it that isn't, and how many there are.
    over = lambda first, last: Window.partitionBy(*b.by).orderBy(b.block).rowsBetween(first, last)
    ever = Window.unboundedPreceding, Window.unboundedFollowing
    totals = totals.withColumn("__base", F.coalesce(F.sum("__n").over(over(ever[0], -1)), F.lit(0)))
    carried = totals.select(
        *on, "__base", F.sum("__n").over(over(*ever)).alias("__all"), (F.count("__plain").over(over(ever[0], -1)) > 0).alias("__passed"),
        F.first(F.col("__base") + F.col("__plain"), True).over(over(1, ever[1])).alias("__behind"),
    )
    rows = rows.join(carried, on)
    nxt = F.coalesce(F.col("__base") + F.min(plain).over(b.local(1, None)), F.col("__behind"))
    passed = F.col("__passed") | (F.count(plain).over(b.local(None, -1)) > 0)
    later = F.coalesce(nxt, F.col("__all")) - 1
    passing = F.col("__base") + F.col("__i") - F.when(passed, 1).otherwise(0)
    rows = rows.withColumn("display", b.placed(F.when(F.col("coding_type") != "B", later).otherwise(passing)))
    return rows.drop(*on, "__i", "__base", "__all", "__passed", "__behind")


def sessions(packets: DataFrame, starts: Column, width: int = WIDTH) -> DataFrame:
    """session: 1 for the rows from the first start flag on, 2 from the second; rows before the first are dropped."""
    out = scan.running_sum(packets, ["stream_id"], "idx", F.when(starts, 1).otherwise(0).cast("long"), "session", width, inclusive=True)
    return out.filter("session > 0")


def reassemble(packets: DataFrame, starts: Column, payload: str = "payload", width: int = WIDTH) -> DataFrame:
    """The payloads of each session joined in order, with the pts of its start."""
    held = sessions(packets, starts, width)
    parts = F.array_sort(F.collect_list(F.struct("idx", payload)))
    return held.groupBy("stream_id", "session").agg(
        F.min_by("pts", "idx").alias("pts"), F.count(F.lit(1)).alias("packets"), F.array_join(F.transform(parts, lambda p: p[payload]), "").alias(payload)
    )


def carried(packets: DataFrame, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """name: the value of the packet before."""
    return scan.lag(packets, ["stream_id"], "idx", {name: value}, width)


def block_durations(packets: DataFrame, block: Column, width: int = WIDTH) -> DataFrame:
    """duration = (previous block + this block) / 4, 0 for the first."""
    out = scan.lag(packets.withColumn("__b", block), ["stream_id"], "idx", {"__p": F.col("__b")}, width)
    return out.withColumn("duration", F.coalesce(div(F.col("__p") + F.col("__b"), 4), F.lit(0))).drop("__b", "__p")


def fill_sparse_times(packets: DataFrame, known: Column, width: int = WIDTH) -> DataFrame:
    """pts: the last time that is known, plus the durations since then; NULL before the first."""
    summed = scan.settle(scan.running_sum(packets.withColumn("__t", known), ["stream_id"], "idx", F.col("duration"), "__at", width))
    marked = F.when(F.col("__t").isNotNull(), F.struct(F.col("__t").alias("t"), F.col("__at").alias("at")))
    out = scan.last_known(summed, ["stream_id"], "idx", {"__m": marked}, width).drop("__t")
    return out.withColumn("pts", F.col("__m")["t"] + F.col("__at") - F.col("__m")["at"]).drop("__m", "__at")


def composition_times(packets: DataFrame, offset: Column, width: int = WIDTH) -> DataFrame:
    """pts = dts + offset - the offset of the stream's first packet."""
    steps = {"dts": scan.Sum(F.col("duration")), "__first": scan.First(F.struct(offset.alias("o")))}
    timed = scan.run(packets.withColumn("__o", offset), ["stream_id"], "idx", steps, width)
    return timed.withColumn("pts", F.col("dts") + F.col("__o") - F.col("__first")["o"]).drop("__first", "__o")


def byte_times(packets: DataFrame, start: Column, block: Column) -> DataFrame:
    """pts from the byte position."""
    return packets.withColumn("pts", floor_div(F.col("position") - start, block))


def frame_to_pts(packets: DataFrame, width: int | None = None, constant: Column | None = None, reordered: bool = True) -> DataFrame:
    """frame and pts of each packet of a stream. With B packets (reordered) frames are numbered in the order of pts, without them in
    that of the index. At a constant frame duration pts follows from the number: the stream's start plus so many durations."""
    if reordered:
        out = scan.run(packets, ["stream_id"], "pts", {"frame": scan.Sum(F.lit(1).cast("long")), "__start": scan.First(F.col("pts"))}, width, ["idx"])
    else:
        start = scan.Top(-F.col("pts"))  # the least
        out = scan.run(packets, ["stream_id"], "idx", {"frame": scan.Sum(F.lit(1).cast("long")), "__start": start}, width or WIDTH)
        out = out.withColumn("__start", -F.col("__start"))
    if constant is not None:
        out = out.withColumn("pts", F.col("__start") + F.col("frame") * constant)
    return out.drop("__start")


def unwrap_counter(packets: DataFrame, counter: Column, bits: int, anchor: Column, width: int = WIDTH) -> DataFrame:
    """pts of a counter of so many bits. An anchor, a time that isn't NULL, is a row's pts and the start of what follows. After it, a
    step back by more than half the range adds the range for good, and a step ahead by more than half takes it off for
    that row alone. Rows before the first anchor start from 0; rows without a counter or an anchor get NULL and count for no other.

    Whether the row before was set back depends on the one before it. But a large step forces the answer, whatever was before, and a
    small one leaves it as it is, so it is the last answer that was forced."""
    size = 1 << bits
    p = packets.withColumns({"__n": counter, "__a": F.when(counter.isNotNull(), anchor)})
    p = scan.settle(scan.run(p, ["stream_id"], "idx", {"__p": scan.Last(F.col("__n"), inclusive=False)}, width))
    step = F.col("__n") - F.coalesce("__p", F.lit(0))
    forced = F.when(F.col("__a").isNotNull(), False).when(step > size // 2, True).when(step <= -(size // 2), False)
    p = p.withColumns({"__step": step, "__forced": F.when(F.col("__n").isNotNull(), forced)})
    p = scan.settle(scan.run(p, ["stream_id"], "idx", {"__was": scan.Last(F.col("__forced"), inclusive=False), "__back": scan.Last(F.col("__forced"))}, width))
    was, back = (F.coalesce(c, F.lit(False)) for c in ("__was", "__back"))
    wraps = F.col("__n").isNotNull() & F.col("__a").isNull() & ~was & (F.col("__step") < -(size // 2))
    p = scan.settle(scan.run(p.withColumns({"__b": back.cast("long"), "__w": wraps.cast("long")}), ["stream_id"], "idx", {"__wraps": scan.Sum(F.col("__w"), inclusive=True)}, width))
    mark = F.when(F.col("__a").isNotNull(), F.struct(F.col("__a").alias("a"), F.col("__n").alias("n"), F.col("__wraps").alias("w")))
    out = scan.run(p, ["stream_id"], "idx", {"__m": scan.Last(mark)}, width)
    base = F.coalesce(F.col("__m")["a"] - F.col("__m")["n"] - size * F.col("__m")["w"], F.lit(0))
    return out.withColumn("pts", base + F.col("__n") + size * (F.col("__wraps") - F.col("__b"))).drop("__n", "__a", "__p", "__step", "__forced", "__was", "__back", "__b", "__w", "__wraps", "__m")

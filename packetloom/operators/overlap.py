"""Joins of ranges that overlap.

Ranges are half-open: start, end, bigints. A range of a length up to BASE ** l has the level l, and touches two blocks of that width at most. Two ranges are compared at the higher one of their levels, in the
blocks of that width that both touch: each range meets those of its own level in its own blocks, and longer ones in the block of theirs it begins in or ends in. So a long range isn't copied into many
blocks and many short ones don't meet each other in a wide block; a hot key is dealt out by blocks. A pair is kept in one block only, that of its later start. Where the ranges of
each side don't overlap each other, a block holds BASE + 1 of a level and side at most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.timebase import floor_div
from packetloom.operators import scan

BASE, LEVELS = 16, 16


def _level(length: Column) -> Column:
    out = F.lit(LEVELS - 1)
    for level in range(LEVELS - 2, -1, -1):
        out = F.when(length <= BASE**level, level).otherwise(out)
    return out


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(BASE**k).cast("long") for k in range(LEVELS - 1)], F.lit((1 << 63) - 1)), level + 1)


def _placed(df: DataFrame, row: str, keys: Sequence[str], start: str, end: str) -> DataFrame:
    known = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start))
    for k in keys:
        known &= F.col(k).isNotNull()
    out = df.filter(known).select(*keys, F.struct(*df.columns).alias(row), F.col(start).cast("long").alias(f"{row}s"), F.col(end).cast("long").alias(f"{row}e"))
    return out.withColumn(f"{row}l", _level(F.col(f"{row}e") - F.col(f"{row}s")))


def _in_blocks(df: DataFrame, row: str, levels: Column) -> DataFrame:
    """A row of df for each block of the levels that it touches."""
    at = df.withColumn("__level", F.explode(levels))
    width = _width(F.col("__level"))
    low, high = floor_div(F.col(f"{row}s"), width), floor_div(F.col(f"{row}e") - 1, width)
    return at.withColumn("__block", F.explode(F.sequence(low, high)))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """All pairs of rows with equal keys whose ranges overlap: structs `l` and `r` of their columns. Rows with a NULL in their keys or range, and empty ranges, overlap nothing.

    Both inputs are read twice, and once for their levels, and should be cheap to read. Neither is broadcast: ranges side by side are files of a few bytes a row, so Spark would take millions of them for small."""
    a, b = _placed(left, "l", keys, *left_range), _placed(right, "r", keys, *right_range)
    found = {side: sorted(r[0] for r in df.select(side).distinct().collect()) for side, df in (("ll", a), ("rl", b))}  # LEVELS at most
    above = lambda levels, own, least: F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: (x > F.col(own)) if least else (x >= F.col(own)))
    on = [*keys, "__level", "__block"]
    met = []
    for one, one_levels, other, other_levels in ((a, F.array("ll"), b, above(found["ll"], "rl", False)), (a, above(found["rl"], "ll", True), b, F.array("rl"))):
        pairs = _in_blocks(one, "l", one_levels).join(_in_blocks(other, "r", other_levels).hint("merge"), on)
        pairs = pairs.filter((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")))
        met.append(pairs.filter(F.col("__block") == floor_div(F.greatest("ls", "rs"), _width(F.col("__level")))).select("l", "r"))
    return met[0].unionByName(met[1])


def frame_times(frames: DataFrame, packets: DataFrame, keys: Sequence[str], frame: str, width: int | None = None) -> DataFrame:
    """frames (keys, `frame`: their order, start, end: bytes of the stream) with `packets`, in how many packets they are, `idx`, the packet in which they begin, and `pts`: the time of
    that packet, for the first frame that begins in it; others have NULL. packets: keys, idx, start, end, pts. A frame in no packet has 0 and NULL."""
    before = scan.settle(scan.lag(frames, keys, frame, {"__before": F.col("start")}, width))
    met = overlapping(before.select(*keys, frame, "start", "end", "__before"), packets.select(*keys, "start", "end", "idx", "pts"), keys, ("start", "end"), ("start", "end"))
    begins = (F.col("r.start") <= F.col("l.start")) & (F.col("l.start") < F.col("r.end"))
    fresh = begins & (F.col("l.__before").isNull() | (F.col("l.__before") < F.col("r.start")))
    own = [*keys, frame]
    got = met.select(*[F.col(f"l.{c}").alias(c) for c in own], F.when(begins, F.col("r.idx")).alias("idx"), F.when(fresh, F.col("r.pts")).alias("pts"))
    got = got.groupBy(*own).agg(F.count(F.lit(1)).alias("packets"), F.max("idx").alias("idx"), F.max("pts").alias("pts"))
    return before.drop("__before").join(got, own, "left").withColumn("packets", F.coalesce("packets", F.lit(0).cast("long")))

"""Merging streams in order, and sets of segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def merge_by_time(streams: Sequence[tuple[str, DataFrame]], time: str, idx: str, width: int | None = None) -> DataFrame:
    """All streams in the order of time; of equal times the stream named first in the list goes first, then the index.
    `position` numbers the result. Blocks of time are sorted apart, so no task sorts all."""
    parts = [df.withColumns({"kind": F.lit(name), "__k": F.lit(i)}) for i, (name, df) in enumerate(streams)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return scan.row_number(out, [], time, "position", width, ["__k", idx]).drop("__k")


def merge_by_offset(chunks: DataFrame, keys: Sequence[str], offset: str, track: str, width: int | None = None) -> DataFrame:
    """Chunks in the order of their offset, ties to the lowest track; `position` numbers them in each file."""
    return scan.row_number(chunks, keys, offset, "position", width, [track])


def by_position(index: DataFrame, position: str = "position", ties: Sequence[str] = ("stream_id", "idx"), width: int | None = None) -> DataFrame:
    """`place` numbers the entries of an index in the order in which they stand in the file; those without a position have none."""
    return scan.row_number(index, [], position, "place", width, ties)


def concatenate(parts: Sequence[DataFrame], order: str) -> DataFrame:
    """One after the other; `part` says which."""
    out = None
    for i, p in enumerate(parts):
        q = p.withColumn("part", F.lit(i))
        out = q if out is None else out.unionByName(q)
    return out.orderBy("part", order)


def slide_window(segments: DataFrame, new_start: Column) -> DataFrame:
    """A live playlist drops the segments before its new start; nothing if that isn't later."""
    return segments.filter(F.col("seq") >= new_start)


def live_clock(segments: DataFrame, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """dseq: the discontinuities so far, on top of the list's own number; clock: the last program time plus the durations
    since, undefined from a segment without duration until the next program time. All in one pass; a segment without a number
    gets NULLs. Without keys the table is one list, whose blocks are summed in two levels by two scans."""
    if not keys:
        return _one_clock(segments, width)
    b = scan.Blocks(segments, keys, "seq", width)
    on = [*b.by, b.block]
    upto = lambda v: F.coalesce(F.sum(v).over(b.local(None, -1)), F.lit(0))
    rows = b.df.withColumns({"__t": upto(F.coalesce("duration_us", F.lit(0))), "__u": upto(F.col("duration_us").isNull().cast("long"))})
    rows = rows.withColumn("__m", b.placed(F.when(F.col("program_us").isNotNull(), F.struct(F.col("program_us").alias("p"), F.col("__t").alias("t"), F.col("__u").alias("u")))))
    here = lambda v: F.sum(b.placed(v))
    totals = rows.groupBy(*on).agg(
        here(F.col("discontinuity").cast("long")).alias("__d"), here(F.coalesce("duration_us", F.lit(0))).alias("__t"), here(F.col("duration_us").isNull().cast("long")).alias("__u"),
        F.max_by("__m", F.when(F.col("__m").isNotNull(), b.key())).alias("__m"),
    )
    # A row a block: sums of the blocks before, and the last program time with the sums at it.
    before = Window.partitionBy(*b.by).orderBy(b.block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__{x}0": F.coalesce(F.sum(f"__{x}").over(before), F.lit(0)) for x in "dtu"})
    at = F.when(F.col("__m").isNotNull(), F.struct(F.col("__m")["p"].alias("p"), (F.col("__m")["t"] + F.col("__t0")).alias("t"), (F.col("__m")["u"] + F.col("__u0")).alias("u")))
    carried = totals.withColumn("__at", at).select(*on, "__d0", "__t0", "__u0", F.last("__at", True).over(before).alias("__m0"))
    rows = rows.join(carried, on)
    own = F.last("__m", True).over(b.local(None, 0))
    rows = rows.withColumns({"__own": own, "dseq": b.placed(F.col("__d0") + F.sum(F.col("discontinuity").cast("long")).over(b.local(None, 0)))})
    # The sums since the last program time: in the block, or from a block before.
    t = F.when(F.col("__own").isNotNull(), F.col("__t") - F.col("__own")["t"]).otherwise(F.col("__t") + F.col("__t0") - F.col("__m0")["t"])
    u = F.when(F.col("__own").isNotNull(), F.col("__u") - F.col("__own")["u"]).otherwise(F.col("__u") + F.col("__u0") - F.col("__m0")["u"])
    p = F.coalesce(F.col("__own")["p"], F.col("__m0")["p"])
    return rows.withColumn("clock_us", b.placed(F.when(u == 0, p + t))).drop(*on, "__t", "__u", "__m", "__own", "__d0", "__t0", "__u0", "__m0")


def _one_clock(segments: DataFrame, width: int) -> DataFrame:
    sums = {"dseq": scan.Sum(F.col("discontinuity").cast("long"), True), "__t": scan.Sum(F.coalesce("duration_us", F.lit(0).cast("long"))), "__u": scan.Sum(F.col("duration_us").isNull().cast("long"))}
    summed = scan.settle(scan.run(segments, [], "seq", sums, width))
    mark = F.when(F.col("program_us").isNotNull(), F.struct(F.col("program_us").alias("p"), F.col("__t").alias("t"), F.col("__u").alias("u")))
    out = scan.run(summed, [], "seq", {"__m": scan.Last(mark)}, width)
    return out.withColumn("clock_us", F.when(F.col("__u") == F.col("__m")["u"], F.col("__m")["p"] + F.col("__t") - F.col("__m")["t"])).drop("__t", "__u", "__m")


def seek_window(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each list: start and end of the time that can be sought, its length, and whether it is long enough (over 30
    minutes) with a clock."""
    out = segments.groupBy(*keys).agg(
        F.min_by("clock_us", "seq").alias("start_us"),
        F.max_by(F.col("clock_us") + F.greatest(F.coalesce("duration_us", F.lit(0)), F.lit(0)), "seq").alias("end_us"),
        F.sum("duration_us").alias("window_us"),
    )
    return out.withColumn("can_seek", (F.col("window_us") > 30 * 60 * 1_000_000) & F.col("start_us").isNotNull())

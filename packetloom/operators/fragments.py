"""Fragmented files: samples whose sizes, durations and places are told at three levels.

A fragment is one box of a file and its runs are lists in it, so both are small by their format; a track may hold any number of them, and its times are scanned in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def samples(tracks: DataFrame, fragments: DataFrame, runs: DataFrame, rows: DataFrame, width: int | None = None) -> DataFrame:
    """rows (track, fragment, run, ord, duration, size, composition) with all that is left out filled in, and dts, pts, position.

    tracks: track, duration, size: what holds where nothing else is told. fragments: track, fragment, base, duration, size. runs: track, fragment, run, offset. A sample's own duration and
    size come first, then its fragment's, then its track's. dts sums the durations before in the track, over all its fragments; pts adds the sample's composition offset less that of its
    run's first. A run starts at the fragment's base and its offset; without an offset where the run before ended, the first one at the base. Rows of unknown runs, and runs of
    unknown fragments, are dropped; a track that isn't told has no defaults. A sample without a duration passes no time."""
    told = fragments.join(tracks.select("track", F.col("duration").alias("__td"), F.col("size").alias("__ts")), "track", "left")  # a row a fragment
    told = told.select("track", "fragment", "base", F.coalesce("duration", "__td").alias("__d"), F.coalesce("size", "__ts").alias("__s"))
    run, fragment = ["track", "fragment", "run"], ["track", "fragment"]
    listed = told.join(runs.groupBy(*fragment).agg(F.collect_list(F.struct("run", "offset")).alias("__runs")), fragment)  # still a row a fragment
    full = rows.join(listed, fragment).withColumn("__run", F.explode(F.filter("__runs", lambda r: r["run"] == F.col("run"))))
    full = full.withColumns({"duration": F.coalesce("duration", "__d"), "size": F.coalesce("size", "__s"), "composition": F.coalesce("composition", F.lit(0))})
    # All windows are of a fragment and in one order, so the rows are shuffled and sorted once for all of them.
    along, inside = Window.partitionBy(*fragment).orderBy("run", "ord"), Window.partitionBy(*run).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("__at", F.coalesce(F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    full = full.withColumns({"__first": F.first("composition").over(inside), "__set": F.col("base") + F.col("__run.offset") - F.first("__at").over(inside)})
    anchor = F.last("__set", True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    full = full.withColumns({"position": F.coalesce(anchor, "base") + F.col("__at"), "__shift": F.col("composition") - F.col("__first")})
    full = scan.settle(full.select(*run, "ord", "duration", "size", "position", "__shift"))
    timed = scan.running_sum(full, ["track"], "fragment", F.coalesce("duration", F.lit(0)), "dts", width, ["run", "ord"])
    return timed.select(*run, "ord", "duration", "size", "dts", (F.col("dts") + F.col("__shift")).alias("pts"), "position")

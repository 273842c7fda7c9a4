"""Run-length tables, chunk tables and edit lists, expanded to packets and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import bits
from packetloom.functions.timebase import rescale

from . import scan
from .packets import WIDTH


def runs(table: DataFrame, keys: Sequence[str], order: str, count: Column, name: str = "sample", width: int = WIDTH, ties: Sequence[str] = ()) -> DataFrame:
    """A row for each element of a run; `name` numbers them along the stream from 0. Runs of no element give none.

    The number is known from the sum of the earlier runs before anything is expanded, so expansion stays where the run is."""
    n = count.cast("long")
    first = scan.running_sum(table, keys, order, F.greatest(n, F.lit(0)), "__at", width, ties)
    full = first.withColumn("__n", n).filter("__n > 0")
    return full.withColumn(name, F.explode(F.expr("sequence(__at, __at + __n - 1)"))).drop("__at", "__n")


def sample_times(table: DataFrame, keys: Sequence[str], order: str, count: Column, delta: Column, width: int = WIDTH, ties: Sequence[str] = ()) -> DataFrame:
    """A row for each sample, with its ordinal and dts, from a table of (count, duration)."""
    t = table.withColumns({"__n": count.cast("long"), "__d": delta.cast("long")})
    steps = {"__s": scan.Sum(F.col("__n")), "__t": scan.Sum(F.col("__n") * F.col("__d"))}
    t = scan.run(t, keys, order, steps, width, ties).filter("__n > 0")
    t = t.withColumn("__k", F.explode(F.expr("sequence(0L, __n - 1)")))
    out = t.withColumns({"sample": F.col("__s") + F.col("__k"), "dts": F.col("__t") + F.col("__k") * F.col("__d"), "duration": F.col("__d")})
    return out.drop("__n", "__d", "__s", "__t", "__k")


def total_samples(table: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """samples: how many samples a run-length table has, summed before it is shuffled. Entries without a count have none."""
    return table.groupBy(*keys).agg(F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("samples"))


def chunk_offsets(samples: DataFrame, keys: Sequence[str], chunk: str, order: str, size: str) -> DataFrame:
    """position: the chunk's offset plus the sizes of the samples before in the same chunk. A chunk is small by its format."""
    before = F.sum(size).over(Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return samples.withColumn("position", F.col("offset") + F.coalesce(before, F.lit(0)))


def keyframe_table(samples: DataFrame, sync: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """keyframe: whether the ordinal is in the sync table; a track without any entry has keyframes only."""
    marked = samples.join(sync.select(*keys, ordinal).distinct().withColumn("__hit", F.lit(True)), [*keys, ordinal], "left")
    some = sync.select(*keys).distinct().withColumn("__some", F.lit(True))
    out = marked.join(some, list(keys), "left")
    return out.withColumn("keyframe", F.coalesce(F.col("__hit"), F.col("__some").isNull())).drop("__hit", "__some")


def chunks_to_samples(stsc: DataFrame, chunks: DataFrame, keys: Sequence[str], width: int = WIDTH) -> DataFrame:
    """A row for each sample of each chunk: sample numbers from the steps (first_chunk, samples_per_chunk)."""
    stepped = scan.settle(scan.as_of(chunks, stsc, keys, "chunk", "first_chunk", ["samples_per_chunk"], width))
    return runs(stepped, keys, "chunk", F.col("samples_per_chunk"), "sample", width)


def edit_list(edits: DataFrame, keys: Sequence[str], order: str, media_scale: int, movie_scale: int, width: int = WIDTH, ties: Sequence[str] = ()) -> DataFrame:
    """Segments of an edit list: dst_time sums the durations before; an edit with media_time -1 passes time without a segment."""
    d = rescale("duration", movie_scale, media_scale)
    summed = scan.running_sum(edits.withColumn("__d", d), keys, order, F.col("__d"), "dst_time", width, ties)
    return summed.filter("media_time <> -1").withColumn("duration", F.col("__d")).drop("__d")


def lacing(blocks: DataFrame, keys: Sequence[str], order: str, sizes: str, position: str, width: int = WIDTH) -> DataFrame:
    """A packet for each of a block's sizes, with its position: that of the block plus the sizes before. A block is one row, named by keys and order, and so are its sizes: they are summed where
    the row is, and nothing is shuffled, whatever the width."""
    laced = F.arrays_zip(F.col(sizes).alias("size"), bits.sums_before(F.col(sizes)).alias("before"))
    rest = [c for c in blocks.columns if c not in (sizes, "position")]
    out = blocks.select(*rest, F.col(position).alias("__start"), laced.alias("__laced")).select(*rest, "__start", F.posexplode("__laced").alias("lace", "__l"))
    return out.select(*rest, "lace", F.col("__l")["size"].alias("size"), (F.col("__start") + F.col("__l")["before"]).alias("position"))


def coded_lacing(blocks: DataFrame, keys: Sequence[str], order: str, payload: str, kind: str, width: int = WIDTH) -> DataFrame:
    """Packets of blocks whose sizes are coded in them: lace, size, and position in the block; blocks that are broken give none."""
    read = blocks.withColumn("__l", bits.lace_sizes(F.col(payload), F.col(kind))).filter("__l is not null")
    read = read.withColumns({"__sizes": F.col("__l.sizes"), "__at": F.col("__l.head").cast("long")}).drop("__l", payload)
    return lacing(read, keys, order, "__sizes", "__at", width).drop("__at")


def track_ends(tracks: DataFrame, keys: Sequence[str], order: str, start: str, total: str, width: int = WIDTH) -> DataFrame:
    """end: where the next track starts; the last one ends with the whole."""
    nxt = scan.lead(tracks, keys, order, {"end": F.col(start)}, width)
    return nxt.withColumn("end", F.coalesce("end", total))

"""Media tables seen in the driver's tables, which hold no media.

A user of `events` stands for a stream and each event for a packet; turns of `conversations` are text cues; lines of an order
are entries of a run-length table; vectors of `embeddings` are blocks of samples. PACKETS says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.timebase import micros

#: Width of a block of packet indices and of small ordinals. A stream has each of them once, so it is also a bound of a block's rows.
IDX, FEW = 1 << 16, 1 << 12

PACKETS = """(SELECT user_id AS stream_id, event_id AS idx, epoch_us(ts) AS pts, CAST(floor(value * 10) AS BIGINT) AS duration,
    CAST(length(props) AS BIGINT) AS size, event_type = 'signup' AS keyframe, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, idx, pts (µs), duration, size, keyframe, event_type, cents."""
    return packets_of(table(spark, sf_dir, "events"))


def packets_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("stream_id"),
        F.col("event_id").alias("idx"),
        micros("ts").alias("pts"),
        F.floor(F.col("value") * 10).cast("long").alias("duration"),
        F.length("props").cast("long").alias("size"),
        (F.col("event_type") == "signup").alias("keyframe"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, ord, pts and duration in ms, text: turn n starts at 3000 n ms and lasts 50 ms a character."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("ord"), (F.col("turn") * 3000).alias("pts"), (F.length("text") * 50).cast("long").alias("duration"), "text", "role"
    )


CUES = "(SELECT conv_id AS stream_id, turn AS ord, turn * 3000 AS pts, CAST(length(text) * 50 AS BIGINT) AS duration, text, role FROM conversations)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, ord, count, delta: lines of an order as entries of a run-length table. Line numbers may repeat in an order, so
    what they hold breaks ties: entries are summed by (order, line, count, delta) first."""
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("ord"), F.floor("l_quantity").cast("long").alias("delta"), F.lit(1).cast("long").alias("one")
    )
    return t.groupBy("track", "ord", "delta").agg(F.sum("one").alias("count"))


RUNS = "(SELECT l_orderkey AS track, CAST(l_linenumber AS BIGINT) AS ord, CAST(floor(l_quantity) AS BIGINT) AS delta, count(*) AS count FROM lineitem GROUP BY ALL)"

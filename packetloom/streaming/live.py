"""Live sources as Structured Streaming queries.

State is kept by key and small: an open packet, the last value, the last sequence number of a list. state_changes, reassemble and new_segments are streams for any sink and take a stream's part of a
micro-batch in one task. changes_in, packets_in and segments_in give the same rows as outputs of tee: there a micro-batch is a table, a stream in it is scanned in blocks by many tasks, and what
was open before is a row ahead of its stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.operators import merge
from packetloom.operators import packets as P
from packetloom.operators import scan


def with_rocksdb(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB, as transformWithState asks for: on disk, so it may be larger than memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_stats(packets: DataFrame) -> DataFrame:
    """The batch aggregate on a stream: complete or update mode."""
    return P.stream_stats(packets)


def state_changes(events: DataFrame, key: str = "stream_id") -> DataFrame:
    """events (key, idx, value): a value is sent at first and whenever it changes, in the order of idx in a batch."""

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        known = state.exists
        rows = pd.concat(list(parts)).sort_values("idx", kind="stable")
        before = rows["value"].shift(1)
        if known:
            before.iloc[0] = last
        changed = (rows["value"] != before) & ~(rows["value"].isna() & before.isna())
        changed.iloc[0] = not known or rows["value"].iloc[0] != last
        state.update((rows["value"].iloc[-1],))
        yield rows.loc[changed, [key, "idx", "value"]]

    plain = events.select(key, "idx", "value")
    return plain.groupBy(key).applyInPandasWithState(run, plain.schema, "value string", "append", GroupStateTimeout.NoTimeout)


def reassemble(packets: DataFrame, key: str = "stream_id", wait_ms: int | None = 10_000) -> DataFrame:
    """packets (key, idx, start, payload): a start flag opens a packet, what follows is appended; it is complete, and a row
    (key, idx, parts, payload), when the next one opens or when nothing has come for wait_ms, unless that is None. Data before the first start is
    dropped. An open packet is all that is kept."""

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(held):
            return pd.DataFrame({key: [name[0]], "idx": [held[0]], "parts": [held[1]], "payload": [held[2]]})

        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if held:
                yield row(held)
            return
        rows = pd.concat(list(parts)).sort_values("idx", kind="stable")  # chunks of a group follow no order
        opened = rows["start"].astype(bool).cumsum()
        for n, own in rows.groupby(opened, sort=True):
            text = "".join(own["payload"])
            if n == 0:
                if held:
                    held = (held[0], held[1] + len(own), held[2] + text)
                continue
            if held:
                yield row(held)
            held = (own["idx"].iloc[0], len(own), text)
        if held:
            state.update((int(held[0]), int(held[1]), held[2]))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)

    timeout = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    kind = packets.schema[key].dataType.simpleString()
    plain = packets.select(key, "idx", "start", "payload")
    return plain.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, idx long, parts long, payload string", "idx long, parts long, payload string", "append", timeout)


def new_segments(segments: DataFrame) -> DataFrame:
    """segments (source, poll, seq, uri) of polled live lists: each segment once, in order. `late` is true for the first segment
    after some that had left the list before they were seen. A list that ends before what was seen starts anew."""

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["poll", "seq"])
        out = []
        for _, poll in rows.groupby("poll", sort=True):
            if seen is not None and poll["seq"].max() < seen:
                seen = None
            new = poll if seen is None else poll[poll["seq"] > seen]
            if len(new):
                new = new.assign(late=False)
                new.iloc[0, new.columns.get_loc("late")] = seen is not None and new["seq"].iloc[0] > seen + 1
                seen = int(new["seq"].iloc[-1])
                out.append(new)
        if seen is not None:
            state.update((seen,))
        if out:
            yield pd.concat(out)[["source", "poll", "seq", "uri", "late"]]

    plain = segments.select("source", "poll", "seq", "uri")
    return plain.groupBy("source").applyInPandasWithState(run, "source string, poll long, seq long, uri string, late boolean", "seen long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read its result: appended files, or the last complete table."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(out)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def tee(stream: DataFrame, outputs: Callable[[DataFrame, DataFrame | None], tuple[dict[str, DataFrame], DataFrame]], folder: str, checkpoint: str) -> None:
    """Several results of one stream, over what is there now. outputs gets a micro-batch and the state that the batch before left (None at first), and returns results by name and the new
    state. Each goes to a folder of its own for the batch, which a batch that runs again overwrites; it starts from the same state, so it adds nothing."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{folder}/_state/batch={number - 1}") if number else None
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        results, state = outputs(batch, before)
        for name, df in (*results.items(), ("_state", state)):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start().awaitTermination()


def _behind(rows: DataFrame, state: DataFrame | None, order: str) -> DataFrame:
    """rows, of a batch, behind what the batches before left of their streams: `__at` is the order, `__new` tells them apart. Rows whose order is NULL stand with the first of the batch."""
    first = rows.agg(F.min(order)).first()[0] or 0
    out = rows.withColumns({"__at": F.coalesce(F.col(order).cast("long"), F.lit(first)), "__new": F.lit(True)})
    return out if state is None else out.unionByName(state.withColumns({"__at": F.lit(first - 1).cast("long"), "__new": F.lit(False)}))


def changes_in(batch: DataFrame, before: DataFrame | None, key: str = "stream_id", width: scan.Width | None = None) -> tuple[DataFrame, DataFrame]:
    """Of a batch (key, idx, value): the rows whose value differs from the one before in their stream, in the order of idx, at equal ones of value; the first row of a stream always does. And each
    stream's last row."""
    rows = _behind(batch.select(key, "idx", "value"), before, "idx")
    seen = scan.lag(rows, [key], "__at", {"__v": F.struct("value")}, width, ["value"])
    changed = seen.filter(F.col("__new") & ~F.col("__v").eqNullSafe(F.struct("value"))).select(key, "idx", "value")
    last = F.max(F.struct("__at", "value", "idx")).alias("__l")
    return changed, rows.groupBy(key).agg(last).select(key, "__l.idx", "__l.value")


def packets_in(batch: DataFrame, before: DataFrame | None, key: str = "stream_id", width: scan.Width | None = None) -> tuple[DataFrame, DataFrame]:
    """Of a batch (key, idx, start, payload), the packets (key, idx, parts, payload) that the next one's start completes; what comes before a stream's first start is dropped. And the packets still
    open, one a stream. Only the parts of one packet meet in a task. A NULL start is none, a NULL payload empty."""
    rows = batch.select(key, "idx", F.coalesce("start", F.lit(False)).alias("start"), F.coalesce("payload", F.lit("")).alias("payload"), F.lit(1).cast("long").alias("parts"))
    rows = _behind(rows, None if before is None else before.withColumn("start", F.lit(True)), "idx")
    opens = F.col("start").cast("long")
    placed = scan.run(rows, [key], "__at", {"__n": scan.Sum(opens, inclusive=True), "__next": scan.Next(F.when(F.col("start"), F.lit(True)), inclusive=False)}, width, ["start", "payload"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("__at", "start", "payload"))), lambda x: x["payload"])
    whole = placed.filter("__n > 0").groupBy(key, "__n").agg(
        F.max(F.when(F.col("start"), F.col("idx"))).alias("idx"), F.sum("parts").alias("parts"), F.array_join(parts, "").alias("payload"), F.count_if(F.col("__next").isNull()).alias("__open")
    )
    # of the parts of an open packet none has a start behind it
    return tuple(whole.filter(c).select(key, "idx", "parts", "payload") for c in ("__open = 0", "__open > 0"))


def segments_in(batch: DataFrame, before: DataFrame | None, width: scan.Width | None = None) -> tuple[DataFrame, DataFrame]:
    """Of a batch (source, poll, seq, uri), the segments that new_segments finds, and each source's last poll (source, poll, top). A poll has seen its list up to the greatest number, so what is new in
    the next one needs this number alone."""
    polls = _behind(batch.groupBy("source", "poll").agg(F.max("seq").alias("top")), before, "poll")
    known = scan.lag(polls, ["source"], "__at", {"__seen": F.col("top")}, width).filter("__new")
    anew = F.col("__seen").isNull() | (F.col("top") < F.col("__seen"))
    rows = batch.join(known.select("source", "poll", "__seen", anew.alias("__anew")), ["source", "poll"]).filter(F.col("__anew") | (F.col("seq") > F.col("__seen")))
    nth = F.row_number().over(Window.partitionBy("source", "poll").orderBy("seq", "uri"))  # one list, as it was shown at once
    late = ~F.col("__anew") & (nth == 1) & (F.col("seq") > F.col("__seen") + 1)
    last = F.max(F.struct("__at", "poll", "top")).alias("__l")
    return rows.select("source", "poll", "seq", "uri", late.alias("late")), polls.groupBy("source").agg(last).select("source", "__l.poll", "__l.top")


def window_events(segments: DataFrame, before: DataFrame | None, keys: Sequence[str], width: int) -> tuple[DataFrame, DataFrame]:
    """Of the segments that lists show now (keys, seq, discontinuity, program_us, duration_us), and the windows known before: the lists whose time that can be sought has changed, with its start and end,
    and the windows that are known now. A list that isn't shown keeps its window; one that can't be sought has no event."""
    own = list(keys)
    now = merge.seek_window(merge.live_clock(segments, width, own), own).select(*own, "start_us", "end_us", "can_seek")
    if before is None:
        return now.filter("can_seek").select(*own, "start_us", "end_us"), now
    old = before.select(*own, F.struct("start_us", "end_us").alias("__old"))
    met = now.join(old, own, "left")
    changed = met.filter(F.col("can_seek") & ~F.struct("start_us", "end_us").eqNullSafe(F.col("__old"))).select(*own, "start_us", "end_us")
    return changed, now.unionByName(before.join(now.select(*own), own, "left_anti"))

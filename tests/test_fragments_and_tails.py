"""Fragments against a plain walk, tail scans by the number of files they read, results of a stream that are written again."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import fragments, tail
from packetloom.streaming import live


def first(*values):
    return next((v for v in values if v is not None), None)


def test_fragments(spark):
    rng = random.Random(6)
    maybe = lambda v: v if rng.random() < 0.5 else None
    tracks = [(1, 7, 40), (2, None, None)]
    boxes = [(t, f, 1000 * f, maybe(3), maybe(30)) for f in range(12) for t in [rng.choice([1, 1, 2, 3])]]
    runs = [(t, f, r, maybe(100 * r + 8)) for t, f, *_ in boxes for r in range(rng.randint(1, 3))]
    rows = [(t, f, r, 10 * k, maybe(rng.randint(1, 9)), maybe(rng.randint(1, 90)), maybe(rng.randint(0, 5))) for t, f, r, _ in runs for k in range(rng.randint(0, 4))]
    rows.append((1, 99, 0, 0, 1, 1, 1))  # of a run that isn't told
    want = []
    for t in {b[0] for b in boxes}:
        td, ts = next((x[1:] for x in tracks if x[0] == t), (None, None))
        dts = 0
        for _, f, base, d, s in sorted(b for b in boxes if b[0] == t):
            at = base
            for _, _, r, offset in sorted((x for x in runs if x[:2] == (t, f)), key=lambda x: x[2]):
                own = sorted((x for x in rows if x[:3] == (t, f, r)), key=lambda x: x[3])
                at = at if offset is None else base + offset
                for x in own:
                    duration, size = first(x[4], d, td), first(x[5], s, ts)
                    want.append((t, f, r, x[3], duration, size, dts, dts + (x[6] or 0) - (own[0][6] or 0), at))
                    dts, at = dts + (duration or 0), at + (size or 0)
    got = fragments.samples(
        spark.createDataFrame(tracks, "track long, duration long, size long"), spark.createDataFrame(boxes, "track long, fragment long, base long, duration long, size long"),
        spark.createDataFrame(runs, "track long, fragment long, run int, offset long"), spark.createDataFrame(rows, "track long, fragment long, run int, ord long, duration long, size long, composition long"), 3,
    )
    # Where a run without samples has an offset, it moves nothing: positions are told of samples only.
    moved = {(t, f) for t, f, r, o in runs if o is not None and not any(x[:3] == (t, f, r) for x in rows)}
    keep = lambda x: (x[0], x[1]) not in moved
    assert sorted(filter(keep, map(tuple, got.collect())), key=repr) == sorted(filter(keep, want), key=repr)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == sorted((x[:8] for x in want), key=repr)


@pytest.mark.parametrize("last, read", [(lambda s: 999 - s, 1), (lambda s: 999 - 130 * s, 4), (lambda s: 999 if s else 0, 10)])
def test_tail_reads_files_from_the_end(spark, tmp_path, last, read):
    """Ten files of a hundred rows; streams end at their own places."""
    path = str(tmp_path / "t")
    rows = spark.range(1000)
    stream = F.coalesce(*[F.when((F.col("id") <= last(s)) & ((F.col("id") % 3 == s) | (F.col("id") == last(s))), s) for s in range(3)], F.lit(7))
    rows.select(F.col("id").alias("idx"), stream.alias("stream")).repartitionByRange(10, "idx").sortWithinPartitions("idx").write.parquet(path)
    table = spark.read.parquet(path)
    assert len(table.inputFiles()) == 10
    streams = spark.createDataFrame([(0,), (1,), (2,)], "stream int")
    got, files = tail.last_values(table, streams, "stream", "idx", F.col("idx") * 10)
    want = {r.stream: r.m * 10 for r in table.groupBy("stream").agg(F.max("idx").alias("m")).collect() if r.stream < 3}
    assert {r.stream: r.value for r in got.collect()} == want and files <= read
    got, files = tail.last_values(table, spark.createDataFrame([(5,)], "stream int"), "stream", "idx", F.col("idx"))
    assert [r.value for r in got.collect()] == [None] and files == 10


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    folder = str(tmp_path)
    schema = "host string, seq long, discontinuity boolean, program_us long, duration_us long"
    show = lambda host, lo, hi: [(host, k, False, k * 1_000_000_000, 1_000_000_000) for k in range(lo, hi)]
    fail = {1}

    def outputs(batch, before):
        events, state = live.window_events(batch, before, ["host"], 100)
        number = 0 if before is None else 1
        if number in fail:
            fail.remove(number)
            return {"events": events, "broken": batch.select(F.raise_error(F.lit("lost")))}, state
        return {"events": events, "segments": batch}, state

    polls = [show("a", 0, 5) + show("b", 0, 1), show("a", 0, 5) + show("b", 0, 4), show("a", 2, 9)]
    for k, rows in enumerate(polls):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        for attempt in range(2):
            try:
                live.tee(stream, outputs, f"{folder}/out", f"{folder}/checkpoint")
                break
            except Exception as lost:
                assert k == 1 and attempt == 0 and "lost" in str(lost)
    got = sorted((r.batch, r.host, r.start_us // 10**9, r.end_us // 10**9) for r in spark.read.parquet(f"{folder}/out/events").collect())
    assert got == [(0, "a", 0, 5), (1, "b", 0, 4), (2, "a", 2, 9)] and not fail
    assert spark.read.parquet(f"{folder}/out/segments").count() == sum(map(len, polls))

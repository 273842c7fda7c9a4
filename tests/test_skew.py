"""Plans and blocks that hold when one key, or one value, is far from all others."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import lookup, merge, packets, scan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_far_time_does_not_widen_all_blocks(spark):
    n = 300_000
    df = spark.range(n).select("id", F.when(F.col("id") == n - 1, 10**17).when(F.col("id") == 0, -(10**15)).otherwise(F.col("id") * 10).alias("t"))
    width = scan.width_for(df, "t")
    assert isinstance(width, scan.Pieces)
    blocks = scan.Blocks(df, [], "t", width)
    assert blocks.df.groupBy(blocks.block).count().agg(F.max("count")).first()[0] < 2 * scan.ROWS
    numbered = scan.row_number(df, [], "t", "n")
    assert numbered.filter("n <> id").count() == 0
    facts = df.filter("id % 1000 = 0")
    got = scan.as_of(df.select("id", "t"), facts.select(F.col("id").alias("at"), F.col("t").alias("u")), [], "t", "u", ["at"], width)
    assert got.filter("at <> id - id % 1000 or at is null").count() == 0


def test_even_times_keep_one_width(spark):
    assert scan.width_for(spark.range(300_000).select((F.col("id") * 10).alias("t")), "t") == 2_999_991 * scan.ROWS // 300_000
    assert scan.width_for(spark.createDataFrame([], "t long"), "t") == 1
    assert isinstance(scan.width_for(spark.createDataFrame([(1,), (10**17,)], "t long"), "t"), int)


@pytest.mark.parametrize("pieces", [scan.Pieces((0,), (5, 7)), scan.Pieces(tuple(range(-50, 900, 13)), tuple(1 + k % 9 for k in range(len(range(-50, 900, 13)) + 1)))])
def test_blocks_rise_with_the_order(spark, pieces):
    rng = random.Random(1)
    xs = sorted({*(rng.randint(-1000, 2000) for _ in range(500)), *pieces.borders, *(b - 1 for b in pieces.borders), -(1 << 62), 1 << 62})
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", scan.block_of(F.col("x"), pieces).alias("b")).orderBy("x").collect()
    bs = [r.b for r in got]
    assert bs == sorted(bs) and len(set(bs)) > 20
    for border in pieces.borders:  # none holds values of two pieces
        assert max(r.b for r in got if r.x < border) < min(r.b for r in got if r.x >= border)


def test_streams_are_counted_before_they_are_shuffled(spark):
    streams, rows = spark.range(10).withColumnRenamed("id", "stream_id"), spark.range(1000).select((F.col("id") % 3).alias("stream_id"))
    for f, n in ((packets.drop_empty, 3), (packets.empty_streams, 7)):
        df = f(streams, rows)
        assert df.count() == n and "HashAggregate" in plan_of(df)


def test_a_clock_without_keys_has_no_window_over_all_blocks(spark):
    rows = [(k, k % 5 == 0, None if k % 7 == 3 else 10 * k, 1000 * k if k % 6 == 1 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "seq long, discontinuity boolean, duration_us long, program_us long")
    want, clock, dseq = [], None, 0
    for seq, cut, duration, program in rows:
        dseq += cut
        clock = program if program is not None else clock
        want.append((seq, dseq, clock))
        clock = None if clock is None or duration is None else clock + duration
    for width in (3, 1000):
        keyed = merge.live_clock(df.withColumn("k", F.lit(1)), width, ["k"])
        for got in (merge.live_clock(df, width), keyed):
            assert sorted((r.seq, r.dseq, r.clock_us) for r in got.collect()) == want


def test_seek_index_joins_no_table_of_streams(spark):
    p = spark.createDataFrame([(s, k, 100 * k + s, k % 4 == 0) for s in (1, 2) for k in range(20)], "stream_id long, idx long, pts long, keyframe boolean")
    probes = spark.createDataFrame([(1, 550), (1, 0), (2, 5000), (2, None), (3, 7), (None, 7)], "stream_id long, t long")
    got = lookup.seek_index(probes, p, "t", 30)
    rows = {(r.stream_id, r.t): (r.seek_idx, r.start_idx, r.decode_from) for r in got.collect()}
    assert rows == {(1, 550): (5, 4, 371), (1, 0): (0, 0, 1), (2, 5000): (19, 16, 1572), (2, None): (None, None, None), (3, 7): (None, None, None), (None, 7): (None, None, None)}
    assert "LeftOuter" not in plan_of(got)


def test_durations_end_with_their_stream(spark):
    p = spark.createDataFrame([(s, k, 100 * k, 150 + s) for s in (1, 2) for k in range(5)] + [(3, 0, None, 9), (None, 0, 5, 9)], "stream_id long, idx long, pts long, duration long")
    got = packets.clamp_last(p)
    rows = {(r.stream_id, r.idx): r.duration for r in got.collect()}
    assert got.columns == p.columns
    assert rows == {(s, k): min(150 + s, 400 - 100 * k) for s in (1, 2) for k in range(5)} | {(3, 0): 9, (None, 0): 0}
    ends = p.groupBy("stream_id").agg(F.max("pts").alias("pts_end"))
    assert {(r.stream_id, r.idx): r.duration for r in packets.clamp_last(p, ends).collect()} == rows | {(None, 0): 9}

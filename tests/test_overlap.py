"""Overlap joins against comparing all pairs."""

import random

import pytest

from packetloom.operators import overlap


def plain(left, right):
    return sorted((a, b) for a in left for b in right if a[0] == b[0] and None not in a[:1] and None not in (*a[1:3], *b[1:3]) and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])


@pytest.mark.parametrize("seed, far", [(1, 50), (2, 5000), (3, 10**12)])
def test_overlapping(spark, seed, far):
    rng = random.Random(seed)

    def some(n):
        out = []
        for k in range(n):
            at = rng.randint(-far, far)
            out.append((rng.choice(["a", "a", "b", None]), at, at + rng.choice([0, 1, 2, 15, 16, 17, 300, far // 3, far]), k))
        return out + [("a", None, 5, -1), ("a", 5, None, -2), ("a", -far, far, -3)]

    left, right = some(60), some(60)
    schema = "key string, start long, end long, n int"
    got = overlap.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["key"], ("start", "end"), ("start", "end"))
    assert sorted((tuple(r.l), tuple(r.r)) for r in got.collect()) == plain(left, right)


def test_a_hot_stream_is_dealt_out(spark):
    """One key, ranges side by side: pairs that are compared stay near those that overlap."""
    n = 20_000
    left = spark.range(n).selectExpr("'a' AS key", "id * 10 AS start", "id * 10 + 10 AS end")
    right = spark.range(n // 3).selectExpr("'a' AS key", "id * 30 + 5 AS start", "id * 30 + 35 AS end")
    a, b = overlap._placed(left, "l", ["key"], "start", "end"), overlap._placed(right, "r", ["key"], "start", "end")
    from pyspark.sql import functions as F

    blocks = overlap._in_blocks(a, "l", F.array("ll")).groupBy("key", "__level", "__block").count().agg(F.max("count"), F.count("*")).first()
    assert blocks[0] <= overlap.BASE + 1 and blocks[1] > n / 20
    assert overlap._in_blocks(b, "r", F.array("rl")).count() < 2 * n
    got = overlap.overlapping(left, right, ["key"], ("start", "end"), ("start", "end"))
    assert got.count() == sum(1 for x in range(n) for y in (x // 3 - 1, x // 3) if 0 <= y < n // 3 and x * 10 < y * 30 + 35 and y * 30 + 5 < x * 10 + 10)


def test_frame_times(spark):
    packets = [("s", k, o, o + n, t) for k, (o, n, t) in enumerate([(0, 10, 100), (10, 3, 200), (13, 3, None), (16, 20, 400), (36, 5, 500)])]
    frames = [("s", 0, 0, 4), ("s", 1, 4, 12), ("s", 2, 12, 17), ("s", 3, 17, 20), ("s", 4, 20, 40), ("s", 5, 40, 60), ("s", 6, 60, 61), ("t", 0, 0, 5)]
    got = overlap.frame_times(
        spark.createDataFrame(frames, "stream string, frame long, start long, end long"), spark.createDataFrame(packets, "stream string, idx long, start long, end long, pts long"), ["stream"], "frame"
    )
    assert sorted((r.stream, r.frame, r.packets, r.idx, r.pts) for r in got.collect()) == [
        ("s", 0, 1, 0, 100), ("s", 1, 2, 0, None), ("s", 2, 3, 1, 200), ("s", 3, 1, 3, 400), ("s", 4, 2, 3, None), ("s", 5, 1, 4, 500), ("s", 6, 0, None, None), ("t", 0, 0, None, None),
    ]


def test_small_files_of_many_ranges_are_not_broadcast(spark, tmp_path):
    """A few hundred KB of Parquet, which Spark would broadcast by its size, and hold whole in each task."""
    spark.range(0, 300_000, 1, 4).selectExpr("id % 50 AS key", "id div 50 * 10 AS start", "id div 50 * 10 + 10 AS end").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = overlap.overlapping(table, table, ["key"], ("start", "end"), ("start", "end"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 300_000
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()

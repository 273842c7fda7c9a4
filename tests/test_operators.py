"""Properties of the packet operators: blocks don't show, seeking equals scanning, merging keeps order."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions.timebase import div, floor_div, rescale
from packetloom.operators import expand, lookup, merge, metadata, rules, scan
from packetloom.operators import packets as P


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(1)
    rows = []
    for s in range(4):
        t = rng.randint(-50, 50)
        for i in range(40 if s else 150):
            t += rng.randint(1, 9)
            rows.append((s, i, t + rng.choice([0, 0, 0, -15]), rng.randint(0, 9), rng.randint(0, 5), rng.random() < 0.2, rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(rows, "stream_id long, idx long, pts long, duration long, size long, keyframe boolean, value int").repartition(3), rows


def by_stream(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_scans_do_not_depend_on_the_width(some, width):
    df, rows = some
    df = scan.running_sum(df, ["stream_id"], "idx", F.col("duration"), "before", width)
    df = scan.running_max(df, ["stream_id"], "idx", F.col("pts"), "high", width)
    df = scan.last_known(df, ["stream_id"], "idx", {"known": F.col("value")}, width)
    df = scan.lag(df, ["stream_id"], "idx", {"lagged": F.col("value")}, width)
    df = scan.lead(df, ["stream_id"], "idx", {"led": F.col("value")}, width)
    got = {(r.stream_id, r.idx): (r.before, r.high, r.known, r.lagged, r.led) for r in df.collect()}
    for s, own in by_stream(rows).items():
        for k, r in enumerate(own):
            values = [x[6] for x in own]
            want = (
                sum(x[3] for x in own[:k]), max((x[2] for x in own[:k]), default=None), next((v for v in reversed(values[: k + 1]) if v is not None), None),
                values[k - 1] if k else None, values[k + 1] if k + 1 < len(own) else None,
            )
            assert got[s, r[1]] == want


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_as_of(spark, some, strict, forward):
    df, rows = some
    probes = spark.createDataFrame([(s, t) for s in range(5) for t in range(-80, 900, 7)], "stream_id long, t long")
    facts = df.select("stream_id", "pts", F.col("idx").alias("found"))
    got = scan.as_of(probes, facts, ["stream_id"], "t", "pts", ["found"], 50, strict, forward, ["found"])
    for r in got.collect():
        if forward:
            near = [(x[2], x[1]) for x in rows if x[0] == r.stream_id and (x[2] > r.t if strict else x[2] >= r.t)]
            assert r.found == (min(near)[1] if near else None)
        else:
            near = [(x[2], x[1]) for x in rows if x[0] == r.stream_id and (x[2] < r.t if strict else x[2] <= r.t)]
            assert r.found == (max(near)[1] if near else None)


def test_keyframes_follow_the_index_where_pts_does_not_rise(spark, some):
    df, rows = some
    probes = spark.createDataFrame([(s, t) for s in range(4) for t in range(-80, 900, 11)], "stream_id long, t long")
    for f, pick, side in ((lookup.keyframe_before, max, lambda p, t: p < t), (lookup.keyframe_after, min, lambda p, t: p > t)):
        for r in f(probes, df, "t", 60).collect():
            near = [x[1] for x in rows if x[0] == r.stream_id and x[5] and side(x[2], r.t)]
            assert r.key_idx == (pick(near) if near else None)


def test_filled_durations_leave_no_gap(spark):
    rows = [(0, 0, 100, 0), (0, 1, 140, 7), (0, 2, 150, 0), (1, 0, 0, 5), (1, 1, 9, 0), (2, 0, 30, 0)]
    df = spark.createDataFrame(rows, "stream_id long, idx long, pts long, duration long").withColumn("pts_end", F.when(F.col("stream_id") == 2, 90).otherwise(200).cast("long"))
    got = {(r.stream_id, r.idx): r.duration for r in P.fill_durations(df, 2).collect()}
    assert got == {(0, 0): 40, (0, 1): 10, (0, 2): 50, (1, 0): 5, (1, 1): 0, (2, 0): 60}


def test_display_order(spark):
    rows = [(0, i, k) for i, k in enumerate("IPBBPBBP")]
    df = spark.createDataFrame(rows, "stream_id long, idx long, coding_type string")
    got = {r.idx: r.display for r in P.display_order(df, 3).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [0, 2, 3, 1, 5, 6, 4, 7]


def test_merge_keeps_order(some):
    df, _ = some
    a, b = df.filter("stream_id = 0").select("pts", "idx"), df.filter("stream_id = 1").select("pts", "idx")
    rows = merge.merge_by_time([("audio", a), ("video", b)], "pts", "idx", 30).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    keys = [(r.pts, r.kind, r.idx) for r in rows]
    assert keys == sorted(keys)


def test_live_clock_breaks_at_unknown_durations(spark):
    rows = [(0, 5, False, None), (1, 5, False, 1000), (2, None, True, None), (3, 5, False, None), (4, 5, False, 9000), (5, 5, True, None)]
    df = spark.createDataFrame(rows, "seq long, duration_us long, discontinuity boolean, program_us long")
    got = [(r.dseq, r.clock_us) for r in merge.live_clock(df, 2).orderBy("seq").collect()]
    assert got == [(0, None), (0, 1000), (1, 1005), (1, None), (1, 9000), (2, 9005)]


def test_expansion(spark):
    t = spark.createDataFrame([(1, 0, 2, 10), (1, 1, 0, 5), (1, 2, 3, 1)], "track long, ord long, count long, delta long")
    got = [(r.sample, r.dts, r.duration) for r in expand.sample_times(t, ["track"], "ord", F.col("count"), F.col("delta"), 1).orderBy("sample").collect()]
    assert got == [(0, 0, 10), (1, 10, 10), (2, 20, 1), (3, 21, 1), (4, 22, 1)]
    e = spark.createDataFrame([(1, 0, -1, 600), (1, 1, 50, 1200), (1, 2, 0, 600)], "track long, ord long, media_time long, duration long")
    assert [(r.dst_time, r.duration) for r in expand.edit_list(e, ["track"], "ord", 48000, 600, 1).orderBy("ord").collect()] == [(48000, 96000), (144000, 48000)]


def test_trims_and_skips(spark):
    df = spark.createDataFrame([(0, 0, 0, 10, [1.0] * 10), (0, 1, 10, 10, [2.0] * 10)], "stream_id long, idx long, pts long, duration long, data array<double>")
    assert [len(r.data) for r in P.trim_pre_skip(df, 13).collect()] == [7]
    assert [(r.idx, r.trim) for r in P.skip_to_audio(df, F.lit(4)).orderBy("idx").collect()] == [(0, 4), (1, 0)]
    assert P.skip_to_intra(df, F.lit(10)).first().idx == 1 and P.skip_to_predicted(df, F.lit(10)).first().idx == 0
    streams = spark.createDataFrame([(0, "audio"), (1, "msg")], "stream_id long, kind string")
    assert {r.stream_id: r.action for r in P.default_actions(streams).collect()} == {0: "mute", 1: "decode"}
    assert P.select_streams(df, P.default_actions(streams)).count() == 0 and P.select_streams(df, P.default_actions(streams, [0])).count() == 2


def test_rules(spark):
    df = spark.createDataFrame([(100, 1), (5000, 0), (None, 1)], "b long, o int")
    text = "#$B<200,x=1;#$B>=200||$O==1&&$O==0,x=2;x=3;"
    assert [r.v for r in df.select(rules.holding_rules(text, {"B": "b", "O": "o"}).alias("v")).collect()] == [[0, 2], [1, 2], [2]]


def test_integer_time(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2), (-8, 2), (3, 0)], "a long, b long")
    got = [(r.d, r.f) for r in df.select(div("a", "b").alias("d"), floor_div("a", F.greatest("b", F.lit(1))).alias("f")).collect()]
    assert got == [(-3, -4), (3, 3), (-4, -4), (None, 3)]
    assert [r.v for r in df.select(rescale("a", 2, 1).alias("v")).collect()] == [-3, 4, -4, 2]


def test_metadata(spark):
    e = spark.createDataFrame([(1, 0, "ARTIST", "a"), (1, 2, "ARTIST", "b"), (1, 3, "TITLE", "t"), (1, 5, "TITLE", "u")], "id long, pos long, key string, value string")
    assert {r.key: r["values"] for r in metadata.collect_tags(e, ["id"]).collect()} == {"ARTIST": ["a", "b"], "TITLE": ["t"]}
    lines = spark.createDataFrame([(1, 0, "A=b"), (1, 1, "note"), (1, 2, "more")], "id long, pos long, line string")
    assert metadata.comment_fallback(lines, ["id"]).first().comment == "note"


def test_lacing_sums_long_blocks_once(spark):
    sizes = {1: [k * 7 % 31 for k in range(5000)], 2: [4], 3: [], 4: [0, 0, 9]}
    blocks = spark.createDataFrame([(1, b, s, b * 1000) for b, s in sizes.items()], "track long, block long, sizes array<long>, position long")
    got = expand.lacing(blocks, ["track"], "block", "sizes", "position", 100)
    want = {(b, i): (x, b * 1000 + sum(s[:i])) for b, s in sizes.items() for i, x in enumerate(s)}
    assert {(r.block, r.lace): (r["size"], r.position) for r in got.collect()} == want and got.count() == len(want)
    assert "slice(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scans_keep_rows_without_key_time_or_value(spark):
    rows = [(None, 1, 5), (None, 2, None), (1, None, 7), (1, None, 7), (1, 3, None), (1, 4, 2), (None, None, 9)]
    df = spark.createDataFrame(rows, "stream_id long, idx long, v long")
    steps = {
        "sum": scan.Sum(F.col("v"), inclusive=True), "max": scan.Max(F.col("v"), inclusive=True), "last": scan.Last(F.col("v")), "next": scan.Next(F.col("v")),
        "first": scan.First(F.col("v")), "top": scan.Top(F.col("v")),
    }
    for width in (1, 100):
        got = sorted((tuple(r) for r in scan.run(df, ["stream_id"], "idx", steps, width).collect()), key=repr)
        assert got == sorted([
            (None, 1, 5, 5, 5, 5, 5, 5, 5), (None, 2, None, 5, 5, 5, None, 5, 5), (1, None, 7, *[None] * 6), (1, None, 7, *[None] * 6), (None, None, 9, *[None] * 6),
            (1, 3, None, 0, None, None, 2, 2, 2), (1, 4, 2, 2, 2, 2, 2, 2, 2),
        ], key=repr)


def test_scans_of_one_stream_without_keys(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCKS", 3)
    rows = [(i, i * 7 % 11 if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "t long, v long").repartition(3)
    steps = {"sum": scan.Sum(F.col("v")), "max": scan.Max(F.col("v")), "last": scan.Last(F.col("v")), "next": scan.Next(F.col("v"), inclusive=False), "first": scan.First(F.col("v")), "top": scan.Top(F.col("v"))}
    for r in scan.run(df, [], "t", steps, 2).collect():
        v = [x for _, x in rows]
        known = lambda xs: next((x for x in xs if x is not None), None)
        before = [x for x in v[: r.t] if x is not None]
        assert (r["sum"], r["max"], r["last"], r["next"]) == (sum(before), max(before, default=None), known(v[: r.t + 1][::-1]), known(v[r.t + 1 :]))
        assert (r["first"], r["top"]) == (7, 10)


def test_no_probe_is_lost(spark):
    packets = spark.createDataFrame([(1, 0, 10, True), (1, 1, None, True), (None, 2, 10, True), (1, 3, 30, False)], "stream_id long, idx long, pts long, keyframe boolean")
    probes = spark.createDataFrame([(1, 20), (1, None), (None, 20), (7, 20), (1, 5)], "stream_id long, t long")
    got = {(r.stream_id, r.t): r.idx for r in scan.as_of(probes, packets, ["stream_id"], "t", "pts", ["idx"], 5).collect()}
    assert got == {(1, 20): 0, (1, None): None, (None, 20): None, (7, 20): None, (1, 5): None}
    for f, want in ((lookup.keyframe_before, 0), (lookup.keyframe_after, None)):
        found = {(r.stream_id, r.t): r.key_idx for r in f(probes, packets, "t").collect()}
        assert len(found) == 5 and found[1, 20] == want and found[1, None] is None and found[None, 20] is None
    assert {r.key_idx for r in lookup.keyframe_after(probes, packets, "t").filter("t = 5").collect()} == {0}
    seeks = {(r.stream_id, r.t): (r.seek_idx, r.start_idx, r.decode_from) for r in lookup.seek_index(probes, packets, "t", 3).collect()}
    assert seeks == {(1, 20): (0, 0, 10), (1, None): (None, None, None), (None, 20): (None, None, None), (7, 20): (None, None, None), (1, 5): (0, 0, 10)}


def test_wrapped_counters(spark):
    """Against the plain loop, over counters with small and large steps, gaps and anchors."""
    rng = random.Random(3)
    rows = []
    for s in range(3):
        for i in range(200):
            rows.append((s, i, rng.choice([rng.randrange(16), rng.randrange(8), 15, 0, None]), rng.randrange(1000) if rng.random() < 0.1 else None))
    df = spark.createDataFrame(rows, "stream_id long, idx long, c long, a long").repartition(3)
    got = {(r.stream_id, r.idx): r.pts for r in P.unwrap_counter(df, F.col("c"), 4, F.col("a"), 16).collect()}
    for s in range(3):
        offset = last = 0
        for _, i, c, a in (r for r in rows if r[0] == s):
            if c is None:
                assert got[s, i] is None
                continue
            if a is not None:
                pts, offset = a, a - c
            else:
                pts = offset + c
                if pts - last < -8:
                    pts, offset = pts + 16, offset + 16
                elif pts - last > 8:
                    pts -= 16
            last = pts
            assert got[s, i] == pts


def test_chained_scans_read_their_input_twice(spark):
    """Each step reads its input for its rows and for its carries, and no more."""
    from packetloom.plans import QUERIES

    for name in ("stream_stats", "coding_type", "display_order", "playlist_window", "seek_window", "duration_fill", "sample_times", "ts_composition"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert 1 <= plan.count("FileScan") <= 2, name


def test_waiting_for_keyframes_only_where_packets_refer_to_others(spark):
    df = spark.createDataFrame([(0, 0, False, True), (0, 1, True, True), (1, 0, False, False), (1, 1, False, False), (2, 0, False, True)], "stream_id long, idx long, keyframe boolean, p boolean")
    assert sorted((r.stream_id, r.idx) for r in P.wait_for_keyframe(df, waits=F.col("p")).collect()) == [(0, 1), (1, 0), (1, 1)]
    assert [(r.stream_id, r.idx) for r in P.wait_for_keyframe(df).collect()] == [(0, 1)]


def test_reassembly_of_streams_longer_than_a_chunk(spark, tmp_path):
    """More rows a stream than a chunk has, from several files in no order."""
    from packetloom.streaming import live

    n = 25_000
    spark.range(n).selectExpr("1L as stream_id", "id as idx", "id % 1000 = 0 as start", "cast(id % 10 as string) as payload").repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, idx long, start boolean, payload string").parquet(str(tmp_path / "in"))
    got = live.run_available(live.reassemble(stream, wait_ms=None), str(tmp_path / "out"), str(tmp_path / "checkpoint")).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(0, n - 1000, 1000)) and all(r.parts == 1000 and r.payload == "0123456789" * 100 for r in got)

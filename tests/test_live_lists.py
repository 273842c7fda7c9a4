"""The live list source: parsing, where reading starts, offsets, lists that change between runs."""

import os

import pytest

from packetloom.sources import live_lists as L
from packetloom.streaming.live import run_available

MASTER = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\na.m3u8\n"


def listed(first, n, dseq=0, every=0):
    lines = ["#EXTM3U", f"#EXT-X-MEDIA-SEQUENCE:{first}", f"#EXT-X-DISCONTINUITY-SEQUENCE:{dseq}"]
    for k in range(first, first + n):
        lines += ["#EXT-X-DISCONTINUITY"] * bool(every and k % every == 0) + ["#EXTINF:2.5,", f"s{k}.ts"]
    return "\r\n".join(lines)


def test_segments():
    text = (
        "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXTINF:1.5,x\n a.ts \n#EXT-X-DISCONTINUITY\n#EXT-X-PROGRAM-DATE-TIME:2022-04-26T21:15:13.5+01:00\n#EXTINF:2,\n/b.ts\n"
        "#EXTINF:3,\nhttp://o/c.ts\nd.ts\n#EXTINF:4\ne.ts"
    )
    at = 1651004113500000
    got = [(s.seq, s.dseq, s.uri, s.clock_us, s.duration_us) for s in L.segments(text, "http://h/x/l.m3u8")]
    assert got == [
        (7, 0, "http://h/x/a.ts", None, 1500000), (8, 1, "http://h/b.ts", at, 2000000), (9, 1, "http://o/c.ts", at + 2000000, 3000000), (10, 1, "http://h/x/d.ts", at + 5000000, None),
        (11, 1, "http://h/x/e.ts", None, 4000000),
    ]
    assert L.segments(MASTER) is None and L.segments("") is None and L.segments("#EXT-X-MEDIA-SEQUENCE:3\n") == []


@pytest.mark.parametrize("rule, n, want", [("live", 10, 105), ("live", 11, 109), ("live", 1, 100), ("first", 11, 100), ("dseq:2", 11, 105), ("dseq:9", 11, 109), ("clock:5", 11, 109)])
def test_where_reading_starts(rule, n, want):
    assert L.start_of(L.segments(listed(100, n, every=5)), 100, rule) == want


def test_where_reading_starts_by_clock():
    shown = [L.Segment(k, 0, "", None if k < 2 else k * 10, 10) for k in range(6)]
    assert [L.start_of(shown, 0, f"clock:{t}") for t in (5, 20, 29, 30, 999)] == [2, 2, 2, 3, 5]
    with pytest.raises(ValueError):
        L.start_of(shown, 0, "end")


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path + ".new", "w") as f:
        f.write(text)
    os.replace(path + ".new", path)


def test_offsets(tmp_path):
    folder = str(tmp_path)
    reader = L.Reader({"path": f"{folder}/*.m3u8", "start": "first"})
    assert reader.latestOffset() == {} and reader.initialOffset() == {}
    write(folder, "a.m3u8", listed(10, 4))
    write(folder, "b.m3u8", MASTER)
    one = dict(reader.latestOffset())
    assert one == {f"{folder}/a.m3u8": {"first": 10, "start": 10, "next": 14}}
    (span,) = reader.partitions({}, one)
    assert [r[1] for r in reader.read(span)] == [10, 11, 12, 13]
    write(folder, "a.m3u8", listed(12, 4))
    two = dict(reader.latestOffset())
    (span,) = reader.partitions(one, two)
    assert [(r[1], r[6]) for r in reader.read(span)] == [(14, False), (15, False)]
    os.remove(f"{folder}/a.m3u8")  # for once not there: it keeps its end
    assert reader.latestOffset() == two and reader.partitions(two, two) == []
    write(folder, "a.m3u8", listed(30, 2))
    three = dict(reader.latestOffset())
    (span,) = reader.partitions(two, three)
    with pytest.raises(ValueError, match="14 segments from 16"):
        list(reader.read(span))
    skipping = L.Reader({"path": f"{folder}/*.m3u8", "lost": "skip"})
    assert [(r[1], r[6]) for r in skipping.read(span)] == [(30, True), (31, False)]
    write(folder, "a.m3u8", listed(1, 2))  # a list that begins anew
    (span,) = reader.partitions(three, dict(reader.latestOffset()))
    assert [r[1] for r in reader.read(span)] == [1, 2]


def test_many_lists_share_tasks(tmp_path):
    reader = L.Reader({"path": "\n".join(f"{tmp_path}/{k}" for k in range(40))})
    end = {f"{tmp_path}/{k}": {"first": 0, "start": 0, "next": 3} for k in range(40)}
    assert [len(s.parts) for s in reader.partitions({}, end)] == [16, 16, 8]
    with pytest.raises(ValueError):
        L.Reader({"path": "x", "lost": "never"})


def test_runs_go_on_from_the_checkpoint(spark, tmp_path):
    folder = str(tmp_path)
    os.mkdir(f"{folder}/lists")
    spark.dataSource.register(L.LiveLists)
    stream = spark.readStream.format("live_list").options(path=f"{folder}/lists/*.m3u8", start="live").load()

    def run():
        return sorted((os.path.basename(r.source), r.seq) for r in run_available(stream, f"{folder}/out", f"{folder}/state").collect())

    write(f"{folder}/lists", "a.m3u8", listed(0, 20))
    assert run() == [("a.m3u8", 18), ("a.m3u8", 19)]
    write(f"{folder}/lists", "a.m3u8", listed(5, 20))
    write(f"{folder}/lists", "b.m3u8", listed(100, 3))
    want = [("a.m3u8", k) for k in range(18, 25)] + [("b.m3u8", 101), ("b.m3u8", 102)]
    assert run() == want and run() == want
    write(f"{folder}/lists", "b.m3u8", listed(200, 3))
    with pytest.raises(Exception, match="have left the list"):
        run()

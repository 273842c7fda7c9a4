"""Operators on names, addresses and tables, by hand."""

from pyspark.sql import functions as F

from packetloom.functions import text as X
from packetloom.operators import expand, lookup, merge, metadata
from packetloom.sources import playlists as L


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_url_variables(spark):
    urls = ["http://h/p?a=1&b=&c&a=2#x?y=3", "http://h/p", "http://h/p?#f", None, "http://h/p?q=a=b&"]
    got = values(spark, X.url_variables("u"), [(u,) for u in urls], "u string")
    assert got == [{"b": "", "c": "", "a": "2"}, {}, {}, None, {"q": "a=b"}]
    more = F.create_map(F.lit("z"), F.lit("1"), F.lit("k"), F.lit("2"))
    assert values(spark, X.with_variables("u", more), [("h/p#f",), ("h/p?a=1#f",), ("h/p?",), (None,)], "u string") == ["h/p?k=2&z=1#f", "h/p?a=1&k=2&z=1#f", "h/p?k=2&z=1", None]
    assert values(spark, X.with_variables("u", F.create_map().cast("map<string,string>")), [("h#f",)], "u string") == ["h#f"]


def test_named_like(spark):
    names = [("A.M3U8",), ("audio/x-mpegurl",), ("b.txt",), (None,), ("",)]
    assert values(spark, X.named_like("n", ["audio/"], [".m3u8"]), names, "n string") == [True, True, False, False, False]
    assert values(spark, X.named_like("n", ["audio/"], [".m3u8"], ignore_case=False), names, "n string") == [False, True, False, False, False]
    assert values(spark, X.named_like("n"), names, "n string") == [False] * 5


def test_language(spark):
    codes = [("en",), ("DEU",), ("zh-Hant",), ("ger",), ("xx",), ("",), (None,), ("Deutsch",)]
    assert values(spark, metadata.language(F.col("c"), {"deutsch": "ger"}), codes, "c string") == ["eng", "ger", "chi", "ger", "xx", "", None, "ger"]


def test_table_of_contents(spark):
    toc = [k * 2 for k in range(100)]
    rows = [(p, toc, 2560) for p in (-5.0, 0.0, 0.5, 50.0, 98.5, 99.5, 100.0, 250.0)] + [(50.0, toc[:99], 2560), (50.0, None, 2560), (None, toc, 2560)]
    got = values(spark, lookup.table_of_contents(F.col("p"), F.col("t"), F.col("n")), rows, "p double, t array<int>, n long")
    assert got[:8] == [0, 0, 10, 1000, 1970, 2270, 2560, 2560] and got[8:10] == [None, None]


def test_nth_frame(spark):
    packets = spark.createDataFrame([(1, 0, 30), (1, 1, 10), (1, 2, 20), (1, 3, None), (2, 0, 5)], "stream_id long, idx long, pts long")
    wanted = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (1, -1), (2, 0), (3, 0), (None, 0)], "stream_id long, frame long")
    got = {(r.stream_id, r.frame): (r.idx, r.pts) for r in lookup.nth_frame(wanted, packets, "frame").collect()}
    assert got == {(1, 0): (1, 10), (1, 2): (0, 30), (1, 3): (None, None), (1, -1): (None, None), (2, 0): (0, 5), (3, 0): (None, None), (None, 0): (None, None)}


def test_clock_start(spark):
    segments = spark.createDataFrame([("a", 5, 100), ("a", 6, 200), ("a", 7, None), ("b", 1, None)], "k string, seq long, clock_us long")
    probes = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate([("a", 50), ("a", 199), ("a", 500), ("b", 9), ("c", 9), ("a", None)])], "n int, k string, t long")
    got = {r.n: (r.seq, r.t) for r in lookup.clock_start(probes, segments, ["k"], "t").collect()}
    assert got == {0: (5, 100), 1: (5, 100), 2: (6, 200), 3: (None, 9), 4: (None, 9), 5: (None, None)}


def test_counts_and_places(spark):
    files = spark.createDataFrame([("x.asx", '<asx><ref href="a"/><ENTRYREF href="b"/><Entry><REF href="c"/></Entry></asx>'), ("y.smil", '<smil><audio src="a"/><seq><video src="b"></video></seq></smil>'), ("z", ""), ("n", None)], "source string, text string")
    assert {r.source: r.urls for r in L.count_urls(files).collect()} in ({"x.asx": 2, "y.smil": 2, "z": 0, "n": -3}, {"x.asx": 2, "y.smil": 2, "z": 0, "n": None})
    table = spark.createDataFrame([("a", 3), ("a", None), ("b", None)], "k string, count long")
    assert {r.k: r.samples for r in expand.total_samples(table, ["k"]).collect()} == {"a": 3, "b": 0}
    index = spark.createDataFrame([(1, 0, 70), (2, 0, 10), (1, 1, 10), (2, 1, None)], "stream_id long, idx long, position long")
    assert {(r.stream_id, r.idx): r.place for r in merge.by_position(index).collect()} == {(1, 1): 0, (2, 0): 1, (1, 0): 2, (2, 1): None}

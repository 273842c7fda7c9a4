"""The incremental index: what is computed at which refresh."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators.index_cache import IndexCache

SOURCES = "source string, mtime long, text string"


class Build:
    """Rows of the words of a source; remembers what it was asked for."""

    def __init__(self):
        self.asked = []

    def __call__(self, changed):
        self.asked.append(sorted(r.source for r in changed.collect()))
        return changed.select("source", F.posexplode(F.split("text", " ")).alias("idx", "word"))


def rows(df):
    return sorted((r.source, r.idx, r.word) for r in df.collect())


def want(sources):
    return sorted((s, k, w) for s, _, t in sources for k, w in enumerate(t.split(" ")))


def test_only_what_changed_is_computed(spark, tmp_path):
    cache, build = IndexCache(spark, str(tmp_path), ["mtime"], max_parts=3), Build()
    with pytest.raises(ValueError):
        cache.index()
    now = [("a", 1, "x y"), ("b", None, "z"), ("c", 3, "p q r")]
    for change, asked in (
        (lambda s: s, ["a", "b", "c"]), (lambda s: s, []), (lambda s: [("a", 2, "new words here"), *s[1:]], ["a"]), (lambda s: [*s[1:], ("d", 1, "d d")], ["d"]),
        (lambda s: s, []), (lambda s: [("b", 5, "b again") if x[0] == "b" else x for x in s], ["b"]), (lambda s: [("a", 2, "new words here"), *s], ["a"]),
    ):
        now = change(now)
        assert rows(cache.refresh(spark.createDataFrame(now, SOURCES), build)) == want(now)
        assert build.asked[-1] == asked and rows(cache.index()) == want(now)
    assert len(cache._manifest().parts) <= 3  # they were merged on the way


def test_a_refresh_that_fails_changes_nothing(spark, tmp_path):
    cache = IndexCache(spark, str(tmp_path), ["mtime"])
    one = [("a", 1, "x y")]
    cache.refresh(spark.createDataFrame(one, SOURCES), Build())

    def broken(changed):
        return changed.select("source", F.raise_error(F.lit("lost")).alias("idx"), F.col("text").alias("word"))

    with pytest.raises(Exception, match="lost"):
        cache.refresh(spark.createDataFrame([("a", 2, "z")], SOURCES), broken)
    assert rows(cache.index()) == want(one)
    build = Build()
    assert rows(cache.refresh(spark.createDataFrame([("a", 2, "z")], SOURCES), build)) == [("a", 0, "z")] and build.asked == [["a"]]


def test_no_sources(spark, tmp_path):
    cache = IndexCache(spark, str(tmp_path), ["mtime"])
    assert rows(cache.refresh(spark.createDataFrame([], SOURCES), Build())) == []
    assert rows(cache.refresh(spark.createDataFrame([("a", 2, "z")], SOURCES), Build())) == [("a", 0, "z")]

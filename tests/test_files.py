"""The PCM source that reads ranges, and the sink that writes a file for each stream."""

import os
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.sources import pcm_files, stream_files
from packetloom.sources.pcm import packets
from packetloom.sources.pcm_files import PcmFiles, Ranges, ranges_of
from packetloom.sources.stream_files import StreamFiles, Writer, in_order, manifest, source_of

# --- reading --------------------------------------------------------------------------------------------------


def wav_of(samples, channels=2, extra=b""):
    data = struct.pack(f"<{len(samples)}h", *samples)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, 8000, 16000 * channels, 2 * channels, 16)
    body = b"WAVE" + extra + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.wav": wav_of(range(2001)), "b.wav": wav_of([k % 7 for k in range(30_000)], 1, b"junk" + struct.pack("<I", 5) + b"xxxxx\0"), "c.txt": b"no audio at all", "d.wav": b"",
        "e.au": struct.pack(">4s5I", b".snd", 24, 1000, 3, 8000, 1) + bytes(1000), "f.wav": wav_of([]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


COLUMNS = ["idx", "position", "size", "pts", "duration", "layout", "channels", "rate", "payload"]


def rows_of(df):
    return sorted((os.path.basename(r.source.removeprefix("file:")), *(r[c] for c in COLUMNS)) for r in df.collect())


def load(spark, folder, **options):
    spark.dataSource.register(PcmFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("pcm").options(path=folder, **options).load()


@pytest.mark.parametrize("split", [64, 1000, 1 << 24])
def test_ranges_of_a_file_join_without_loss(spark, folder, split):
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("source"), "content")
    assert rows_of(load(spark, folder, packet_bytes="100", split_bytes=str(split))) == rows_of(packets(files, 100))


def test_small_files_share_a_task_and_large_ones_are_cut():
    got = ranges_of([("a", 10), ("b", 0), ("c", 95), ("d", 250), ("e", 5)], 100)
    assert [r.parts for r in got] == [[("a", 0, 10)], [("d", 0, 100)], [("d", 100, 200)], [("d", 200, 250)], [("c", 0, 95), ("e", 0, 5)]]


@pytest.mark.parametrize("test", ["pts >= 475", "pts > 24 and pts <= 300", "idx = 3", "position < 700", "size < 100", "idx in (1, 4)", "duration >= 25 and idx > 100", "pts < 0"])
def test_filters_are_pushed_and_leave_nothing_out(spark, folder, test):
    every = load(spark, folder, packet_bytes="100", split_bytes="1000")
    kept = spark.createDataFrame(every.collect(), every.schema).filter(test)
    assert rows_of(every.filter(test)) == rows_of(kept)


def test_what_filters_leave_out_is_not_read(spark, folder, monkeypatch):
    a = f"{folder}/a.wav"
    df = load(spark, folder, packet_bytes="100").filter((F.col("source") == a) & (F.col("pts") >= 475))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.split("BatchScan")[0]  # Spark has nothing left to test
    reader = pcm_files.Reader({"path": folder, "packet_bytes": "100", "split_bytes": "1000"})
    equal, more = pcm_files.EqualTo(("source",), a), pcm_files.GreaterThanOrEqual(("pts",), 475)
    other = pcm_files.EqualTo(("layout",), "s16le")
    assert list(reader.pushFilters([equal, more, other])) == [other]
    parts = reader.partitions()
    assert {p[0] for r in parts for p in r.parts} == {a} and len(parts) == 5
    read = []
    real = pcm_files.mmap.mmap

    class Seen(real):
        def __getitem__(self, key):
            if isinstance(key, slice) and key.start and key.start >= 44:
                read.append(key.start)
            return super().__getitem__(key)

    monkeypatch.setattr(pcm_files.mmap, "mmap", Seen)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["pts"] for r in rows] == list(range(475, 1000, 25)) and min(read) >= 44 + 475 * 4
    assert list(reader.read(Ranges([]))) == []


# --- writing --------------------------------------------------------------------------------------------------


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, idx long, payload binary")


ROWS = [(f"s/{k % 5}" if k % 50 else "", k - 100, b"%d," % k) for k in range(500)]


def content(path):
    out = {}
    for f in manifest(path):
        assert source_of(f"{path}/{f['file']}") == f["source"]
        data = open(f"{path}/{f['file']}", "rb").read()
        assert len(data) == f["bytes"]
        out[f["source"]] = out.get(f["source"], b"") + data
    there = sorted(os.path.join(os.path.basename(d), n) for d, _, names in os.walk(path) for n in names if n != "_manifest.json" and not n.endswith(".crc"))
    assert there == sorted(f["file"] for f in manifest(path))
    return out


def want(rows):
    return {s: b"".join(p or b"" for t, _, p in sorted(rows, key=lambda r: (r[0], r[1])) if t == s) for s in {r[0] for r in rows}}


@pytest.mark.parametrize("parts", [1, 7])
def test_each_stream_is_in_order(spark, tmp_path, parts):
    spark.dataSource.register(StreamFiles)
    path = str(tmp_path / "out")
    write = lambda rows, mode: in_order(frame(spark, rows).repartition(9), "source", "idx", parts).write.format("stream_files").option("path", path).mode(mode).save()
    write(ROWS, "append")
    assert content(path) == want(ROWS)
    assert len(manifest(path)) == 6 if parts == 1 else len(manifest(path)) > 6
    more = [(s, i + 1000, p) for s, i, p in ROWS[:40]] + [("new", 1, None), ("new", 2, b"x")]
    write(more, "append")
    assert content(path) == want(ROWS + more)
    with pytest.raises(Exception, match="written twice"):
        write(ROWS[:3], "append")
    assert content(path) == want(ROWS + more)
    write(more, "overwrite")
    assert content(path) == want(more)
    with pytest.raises(Exception, match="no place"):
        write([("s", None, b"")], "append")
    assert content(path) == want(more)


def test_attempts_that_fail_or_lose_leave_no_row(tmp_path):
    path = str(tmp_path / "out")
    w = Writer({"path": path}, False)
    batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(("source", "idx", "payload"), r)) for r in rows], pa.schema([("source", pa.string()), ("idx", pa.int64()), ("payload", pa.binary())]))

    def broken():
        yield batch([("a", 1, b"x")])
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        w.write(broken())
    first = w.write(iter([batch([("a", 1, b"x"), ("a", 2, b"y")])]))
    w.write(iter([batch([("a", 1, b"x"), ("a", 2, b"y")])]))  # a second attempt that Spark doesn't commit
    second = w.write(iter([batch([("a", 3, b"z"), ("b", 1, b"q")])]))
    assert manifest(path) == []
    w.commit([first, second, None])
    assert content(path) == {"a": b"xyz", "b": b"q"}
    for rows in ([("a", 5, b""), ("a", 5, b"")], [("a", 5, b""), ("b", 5, b""), ("a", 6, b"")]):
        with pytest.raises(ValueError):
            Writer({"path": path}, False).write(iter([batch(rows)]))
    gone = Writer({"path": path}, False)
    gone.abort([gone.write(iter([batch([("c", 1, b"c")])]))])
    assert content(path) == {"a": b"xyz", "b": b"q"}


def test_a_retried_task_writes_once(spark, tmp_path):
    """Tasks that die at their first attempt. local[8] doesn't retry, so the attempts are two runs."""
    spark.dataSource.register(stream_files.StreamFiles)
    path, mark = str(tmp_path / "out"), str(tmp_path / "died")

    def die(batches):
        for b in batches:
            yield b
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost")

    df = in_order(frame(spark, ROWS), "source", "idx", 3).mapInArrow(die, "source string, idx long, payload binary")
    save = lambda: df.write.format("stream_files").option("path", path).mode("append").save()
    with pytest.raises(Exception, match="lost"):
        save()
    assert manifest(path) == []
    save()
    assert content(path) == want(ROWS)

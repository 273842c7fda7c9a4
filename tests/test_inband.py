"""In-band metadata: any cutting of the bytes, in any order and any number of micro-batches, gives the same rows."""

import os
import random
import time

import pytest

from packetloom.streaming import inband
from packetloom.streaming.live import run_available

INTERVAL = 40


def coded(sound, texts, interval=INTERVAL):
    """sound with a text after every interval bytes."""
    out, texts = b"", iter(texts)
    for k in range(0, len(sound), interval):
        piece = sound[k : k + interval]
        out += piece
        if len(piece) == interval:
            text = next(texts, b"")
            n = -(-len(text) // 16)
            out += bytes([n]) + text.ljust(16 * n, b"\0")
    return out


def cut(rng, data, most):
    out = []
    while data:
        n = rng.randint(1, most)
        out.append(data[:n])
        data = data[n:]
    return out


SOUND = bytes(range(256)) * 3
TEXTS = [b"StreamTitle='One';", b"", "StreamTitle='Zwölf; it's';StreamUrl='x';".encode(), b"StreamTitle='';", b"nothing", b"StreamTitle='" + b"long " * 700 + b"';", b"StreamTitle='open"]
WANT = [(40, "One"), (120, "Zwölf; it's"), (160, None), (200, None), (240, "long " * 700), (280, "open")]


def test_a_text_is_read_however_it_is_cut():
    rng = random.Random(1)
    data = coded(SOUND, TEXTS)
    for most in (1, 2, 15, 41, 500, 10_000):
        cycle, texts, sound = inband.Cycle(INTERVAL), [], []
        for chunk in cut(rng, data, most):
            cycle = inband.Cycle(INTERVAL, cycle.state())  # as if each came in a micro-batch of its own
            found, heard = cycle.take(chunk)
            texts += [(p, inband.title(t)) for p, t in found]
            sound += heard
            assert len(cycle.held) <= 4080
        assert texts == WANT and b"".join(sound) == SOUND


SCHEMA = "stream_id string, idx long, payload binary"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("most", [30, 700])
def test_streams_in_micro_batches(spark, tmp_path, most):
    rng = random.Random(most)
    rows = [(s, k, c) for s in ("a", "b", None) for k, c in enumerate(cut(rng, coded(SOUND, TEXTS), most))]
    rng.shuffle(rows)
    rows += rows[: len(rows) // 3]  # some come again
    parts = [rows[k::3] for k in range(3)]
    folder = str(tmp_path)
    for k, part in enumerate(parts):
        write(spark, f"{folder}/in", part)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        got = run_available(inband.split(stream, INTERVAL, sound=True), f"{folder}/out", f"{folder}/state").collect()  # restarted each time
    for s in ("a", "b", None):
        own = [r for r in got if r.stream_id == s]
        assert sorted((r.position, r.title) for r in own if r.sound is None) == WANT
        assert b"".join(r.sound for r in sorted((r for r in own if r.sound is not None), key=lambda r: r.position)) == SOUND
        assert not any(r.lost for r in own)


def test_a_chunk_that_never_comes_is_given_up(spark, tmp_path):
    """Timers need a query that goes on, so this one runs until it has said what is expected."""
    folder, data = str(tmp_path), coded(SOUND, TEXTS)
    heard = inband.Cycle(INTERVAL)
    heard.take(data[:100])
    write(spark, f"{folder}/in", [("a", 0, data[:100]), ("a", 2, coded(b"x" * 45, [b"StreamTitle='New';"]))])
    found = inband.split(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), INTERVAL, wait_ms=1)
    writer = found.writeStream.option("checkpointLocation", f"{folder}/state").trigger(processingTime="100 milliseconds")
    query = writer.format("parquet").outputMode("append").start(f"{folder}/out")
    want = [(40, "One", False), (heard.position, None, True), (heard.position + 40, "New", False)]
    try:
        until = time.time() + 60
        got = []
        while len(got) < len(want) and time.time() < until:
            time.sleep(1)
            if os.path.isdir(f"{folder}/out/_spark_metadata"):
                got = [(r.position, r.title, r.lost) for r in spark.read.schema(found.schema).parquet(f"{folder}/out").collect()]
    finally:
        query.stop()
    assert sorted(got, key=lambda x: x[0]) == want

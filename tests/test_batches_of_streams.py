"""Streams cut into micro-batches give the rows that they give at once, by tables and state as by the streaming operators."""

from __future__ import annotations

import random

import pytest

from packetloom.streaming import live


def rows_of(seed: int) -> list[tuple]:
    """(stream_id, idx, start, payload, value), idx rising in each stream; stream 1 has most of the rows."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.random() < 0.2, rng.choice("abc") if k % 17 else None, rng.choice(["x", "x", "y", None])) for k in range(300)]
    return [*rows, (4, 301, False, "lost", "z")]


def fed(spark, tmp_path, batches: list, schema: str, part):
    """What part finds in the batches, each a micro-batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.tee(stream, lambda batch, before: (lambda f, s: ({"found": f}, s))(*part(batch, before)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return spark.read.parquet(str(tmp_path / "out" / "found")).drop("batch").collect()


SCHEMA = "stream_id long, idx long, start boolean, payload string, value string"


@pytest.mark.parametrize("cuts", [[301], [1, 150, 301]])
def test_changes_by_batches(spark, tmp_path, cuts):
    rows = rows_of(1)
    batches = [rows[a:b] for a, b in zip([0, *cuts], cuts)]
    got = fed(spark, tmp_path, batches, SCHEMA, lambda b, s: live.changes_in(b, s, width=50))
    last, want = {}, []
    for stream, idx, _, _, value in rows[: cuts[-1]]:
        if stream not in last or last[stream] != value:
            want.append((stream, idx, value))
        last[stream] = value
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("cuts", [[301], [1, 150, 301]])
def test_packets_by_batches(spark, tmp_path, cuts):
    rows = rows_of(2)
    batches = [rows[a:b] for a, b in zip([0, *cuts], cuts)]
    got = fed(spark, tmp_path, batches, SCHEMA, lambda b, s: live.packets_in(b, s, width=50))
    held, want = {}, []
    for stream, idx, start, payload, _ in rows[: cuts[-1]]:
        if start:
            want += [held[stream]] if stream in held else []
            held[stream] = (stream, idx, 1, payload or "")
        elif stream in held:
            s, i, n, text = held[stream]
            held[stream] = (s, i, n + 1, text + (payload or ""))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_segments_by_batches(spark, tmp_path):
    """Lists that move on, jump, stand still and start anew, in three micro-batches, as the streaming operator has them."""
    shown = {"a": [range(0, 4), range(2, 6), range(9, 12), range(9, 12), range(0, 3), range(1, 5)], "b": [range(5, 6), range(6, 7), range(8, 9), range(8, 10), range(3, 5), range(3, 6)]}
    rows = [(s, poll, seq, f"{s}{seq}") for s, polls in shown.items() for poll, own in enumerate(polls) for seq in own]
    batches = [[r for r in rows if r[1] // 2 == k] for k in range(3)]
    schema = "source string, poll long, seq long, uri string"
    got = fed(spark, tmp_path, batches, schema, lambda b, s: live.segments_in(b, s, width=2))
    want = []
    for s, polls in shown.items():
        seen = None
        for poll, own in enumerate(polls):
            anew = seen is None or max(own) < seen
            new = [q for q in own if anew or q > seen]
            want += [(s, poll, q, f"{s}{q}", k == 0 and not anew and q > seen + 1) for k, q in enumerate(new)]
            seen = max(own)
    assert sorted(tuple(r) for r in got) == sorted(want)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    other = live.run_available(live.new_segments(stream), str(tmp_path / "by_stream"), str(tmp_path / "its_checkpoint")).collect()
    assert sorted(tuple(r) for r in other) == sorted(want)


def test_batches_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    polls = spark.createDataFrame([], "source string, poll long, seq long, uri string")
    for found, state in (live.changes_in(none, None), live.packets_in(none, None), live.segments_in(polls, None)):
        assert found.count() == 0 and state.count() == 0

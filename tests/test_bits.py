"""Numbers of variable length against plain readers, and laces of blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.functions import bits


def packed(text):
    text += "0" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def golomb(n):
    b = bin(n + 1)[2:]
    return "0" * (len(b) - 1) + b


def test_exp_golomb():
    rng = random.Random(2)
    rows = [[rng.randint(0, rng.choice([1, 5, 300, 1 << 24])) for _ in range(rng.randint(1, 30))] for _ in range(200)]
    coded = [packed("".join(map(golomb, r))) for r in rows]
    c = bits.Cursor(pa.array(coded + [None, b""], pa.binary()).slice(3))
    rows = rows[3:] + [[], []]
    for k in range(30):
        asked = np.array([k < len(r) for r in rows])
        got = c.exp_golomb(asked)
        assert got.tolist() == [r[k] if k < len(r) else 0 for r in rows]
    assert c.valid.tolist() == [True] * 197 + [False, True]
    signed = bits.Cursor(pa.array([packed("".join(map(golomb, range(7))))]))
    assert [int(signed.signed_exp_golomb()[0]) for _ in range(7)] == [0, 1, -1, 2, -2, 3, -3]
    short = bits.Cursor(pa.array([b"\x00\x00\x00\x00", b"\x01"]))
    short.exp_golomb()
    assert short.valid.tolist() == [False, False]


def test_bits_and_bytes():
    c = bits.Cursor(pa.array([b"\xa5\xff", b"\x0f", b""]))
    assert c.bits(3).tolist() == [5, 0, 0] and c.valid.tolist() == [True, True, False]
    assert c.bits(np.array([1, 5, 1])).tolist() == [0, 15, 0]
    assert c.bits(12).tolist() == [0x5FF, 0, 0] and c.valid.tolist() == [True, False, False]
    e = bits.Cursor(pa.array([b"\x81", b"\x40\x7f", b"\x10\x00\x01\x00", b"\x40", b"\x00" * 9, b"\xff\xff\xff\x00\x07"]))
    assert e.ebml().tolist() == [1, 127, 256, 0, 0, 127] and e.valid.tolist() == [True, True, True, False, False, True]
    s = bits.Cursor(pa.array([b"\xbf", b"\x80", b"\x5f\xff", b"\x60\x00"]))
    assert s.ebml(signed=True).tolist() == [0, -63, 0, 1]
    r = bits.Cursor(pa.array([b"\xff\xff\x00", b"\x07", b"\xff\xff", b"\xff\xfe\x01"]))
    assert r.runs().tolist() == [510, 7, 0, 509] and r.valid.tolist() == [True, True, False, True]


def plain_head(sizes, kind):
    out = [] if kind == 0 else [len(sizes) - 1]
    if kind == 1:
        for s in sizes[:-1]:
            out += [255] * (s // 255) + [s % 255]
    if kind == 3:
        last = None
        for s in sizes[:-1]:
            v, lo = (s, 0) if last is None else (s - last, 1)
            n = next(n for n in range(1, 7) if (v < (1 << 7 * n) - 1 if not lo else abs(v) <= (1 << (7 * n - 1)) - 1))
            v = v + (1 << 7 * n) + (((1 << (7 * n - 1)) - 1) if lo else 0)
            out += list(v.to_bytes(n, "big"))
            last = s
    return bytes(out)


def test_laces(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        kind, n = k % 4, rng.choice([1, 2, 3, 10, 256])
        sizes = [rng.choice([0, 1, 254, 255, 256, 700, 70_000 if n < 4 else 9]) for _ in range(n)]
        sizes = [sum(sizes)] if kind == 0 else [sizes[0]] * n if kind == 2 else sizes
        rows.append((k, kind, sizes, plain_head(sizes, kind) + bytes(sum(sizes))))
    df = spark.createDataFrame(rows, "n int, kind int, sizes array<long>, payload binary")
    got = df.select("n", bits.lace_sizes(F.col("payload"), F.col("kind")).alias("l"), bits.write_laces(F.col("sizes"), F.col("kind")).alias("w")).collect()
    for r, (_, kind, sizes, payload) in zip(sorted(got), rows):
        assert list(r.l.sizes) == sizes and r.l.head == len(plain_head(sizes, kind)) and r.w == plain_head(sizes, kind).hex().upper()


@pytest.mark.parametrize("payload, kind", [(b"", 1), (b"\x02\xff", 1), (b"\x01\x05abc", 1), (b"\x02\x40", 3), (b"\x02\x81\x80", 3), (b"x", 7), (b"x", None), (None, 0)])
def test_broken_blocks(payload, kind):
    assert bits._laces(pa.array([payload], pa.binary()), pa.array([kind], pa.int32())).to_pylist() == [None]

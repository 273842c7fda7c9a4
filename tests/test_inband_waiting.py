"""Chunks that wait: more than a stream's own entry holds, and no call to the store for each."""

import random

import pytest
from pyspark.sql import Row

from packetloom.streaming import inband

INTERVAL = 50


class Store:
    """A value and a map that count calls."""

    def __init__(self):
        self.value, self.held, self.calls = None, {}, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def exists(self):
        return bool(self.held) if self.value is None else True

    def keys(self):
        return iter(list(self.held))

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]


@pytest.mark.parametrize("chunks, most", [(40, 8), (3000, 1500)])
def test_chunks_in_any_order(chunks, most):
    draw = random.Random(3)
    said, coded = [], b""
    while len(coded) < chunks * 30:
        coded += bytes(draw.randrange(256) for _ in range(INTERVAL))
        text = f"StreamTitle='{len(said)}';".encode()
        coded += bytes([-(-len(text) // 16)]) + text.ljust(-(-len(text) // 16) * 16, b"\0")
        said.append(str(len(said)))
    rows = [Row(idx=k, payload=coded[at : at + 30]) for k, at in enumerate(range(0, len(coded), 30))]
    rows += rows[::7]  # some come again
    draw.shuffle(rows)
    p = inband._Processor(INTERVAL, False, None)
    p.at, p.waiting = Store(), Store()
    got = []
    for part in range(3):
        got += [r.title for r in p.handleInputRows((1,), iter(rows[part::3]), None)]
    assert got == said and not p.waiting.held
    assert p.at.calls + p.waiting.calls <= most

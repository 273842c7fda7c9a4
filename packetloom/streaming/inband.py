"""Metadata inside a byte stream: after every `interval` bytes of sound comes a length byte, and 16 times as many bytes of text, `StreamTitle='...';`, padded with NUL.

The bytes come in chunks, cut anywhere and numbered from 0. What has to be known of a stream between micro-batches is where in this cycle it stands, and the part of a text that has come: 4,080 bytes
at most, however much is read. Chunks that come before their turn wait in the state store, on disk, and those that come again are dropped. A chunk that doesn't come for `wait_ms` while others wait is
given up: the stream counts as connected anew, as it does for a server, so the next chunk begins a cycle, and a row says that something was lost."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetloom.streaming.live import with_rocksdb

#: What a stream stands at before its first chunk: next chunk, bytes of sound so far, bytes up to the next length byte, bytes that a text still lacks, and what has come of it; last, in
#: how many groups chunks wait, and those that wait here.
STATE = "next long, position long, left int, lacks int, held binary, groups long, near binary"
UNIT = 16
#: Chunks that are taken at once, numbers of a group of waiting ones, and what stands before each of these: its number and length.
PART, GROUP, HEAD = 256, 64, struct.Struct("<qI")


class Cycle:
    """Where a stream stands."""

    def __init__(self, interval: int, state: tuple | None = None):
        self.interval = interval
        self.next, self.position, self.left, self.lacks, self.held = state or (0, 0, interval, 0, b"")

    def state(self) -> tuple:
        return self.next, self.position, self.left, self.lacks, bytes(self.held)

    def again(self, idx: int) -> None:
        self.next, self.left, self.lacks, self.held = idx, self.interval, 0, b""

    def take(self, chunk: bytes) -> tuple[list[tuple[int, bytes]], list[bytes]]:
        """(position, text) of the texts that end in the chunk, and the pieces of sound in it."""
        at, texts, sound = 0, [], []
        while at < len(chunk):
            if self.lacks:
                piece = chunk[at : at + self.lacks]
                self.held, self.lacks = self.held + piece, self.lacks - len(piece)
                at += len(piece)
                if not self.lacks:
                    texts.append((self.position, self.held))
                    self.left, self.held = self.interval, b""
            elif self.left:
                piece = chunk[at : at + self.left]
                sound.append(piece)
                at, self.left, self.position = at + len(piece), self.left - len(piece), self.position + len(piece)
            else:
                self.lacks = chunk[at] * UNIT
                at += 1
                if not self.lacks:
                    self.left = self.interval
        self.next += 1
        return texts, sound


def _packed(chunks: dict[int, bytes]) -> bytes:
    return b"".join(HEAD.pack(idx, len(payload)) + payload for idx, payload in chunks.items())


def _unpacked(packed: bytes) -> dict[int, bytes]:
    out, at, packed = {}, 0, bytes(packed)
    while at < len(packed):
        idx, n = HEAD.unpack_from(packed, at)
        at += HEAD.size
        out[idx] = packed[at : at + n]
        at += n
    return out


def title(text: bytes) -> str | None:
    """The value of StreamTitle, up to the last quote before a semicolon or the end; None if there is none."""
    said = text.rstrip(b"\0").decode("utf-8", "replace")
    _, found, rest = said.partition("StreamTitle='")
    end = rest.find("';")
    return (rest[:end] if end >= 0 else rest.rstrip("'")) or None if found else None


class _Processor(StatefulProcessor):
    """Chunks are taken PART at a time. Up to GROUP of those before their turn are kept in the stream's own entry; more, in groups of GROUP numbers, an entry each, and the stream's own tells how many of
    these there are: a call to the store costs far more than a chunk, so none is made for each."""

    def __init__(self, interval: int, sound: bool, wait_ms: int | None):
        self.interval, self.sound, self.wait_ms = interval, sound, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", STATE)
        self.waiting = handle.getMapState("waiting", "part long", "chunks binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cycle = self._open()
        while part := list(islice(rows, PART)):
            fresh: dict[int, bytes] = {}
            for r in part:
                if r.idx is not None:
                    fresh.setdefault(r.idx, bytes(r.payload or b""))
            yield from self._go(key, cycle, fresh)
        self._close(cycle)
        if self.wait_ms is not None and (self.groups or self.near):
            self._set_timer(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cycle = self._open()
        if not self.groups and not self.near:
            return
        known = list(self.near)
        if self.groups:
            known += _unpacked(self.waiting.getValue((min(k[0] for k in self.waiting.keys()),))[0])
        cycle.again(min(known))
        yield self._row(key, cycle.position, lost=True)
        yield from self._go(key, cycle, {})
        self._close(cycle)
        if self.groups or self.near:
            self._set_timer(timerValues)

    def _open(self) -> Cycle:
        state = self.at.get()
        self.groups, self.near = (state[5], _unpacked(state[6])) if state else (0, {})
        return Cycle(self.interval, state[:5] if state else None)

    def _close(self, cycle: Cycle) -> None:
        self.at.update((*cycle.state(), self.groups, _packed(self.near)))

    def _set_timer(self, timerValues) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def _go(self, key, cycle: Cycle, ahead: dict[int, bytes]) -> Iterator[Row]:
        """Take what follows without a gap, of these chunks and of those that wait, and keep the rest."""
        ahead, self.near, looked = {**ahead, **self.near}, {}, None
        while True:
            if self.groups and looked != cycle.next // GROUP:
                looked = cycle.next // GROUP
                if held := self.waiting.getValue((looked,)):
                    self.waiting.removeKey((looked,))
                    self.groups -= 1
                    ahead = {**ahead, **_unpacked(held[0])}
            if cycle.next not in ahead:
                break
            yield from self._rows(key, cycle, ahead.pop(cycle.next))
        ahead = {idx: payload for idx, payload in ahead.items() if idx > cycle.next}
        if len(ahead) <= GROUP:
            self.near = ahead
            return
        rest: dict[int, dict[int, bytes]] = {}
        for idx, payload in ahead.items():
            rest.setdefault(idx // GROUP, {})[idx] = payload
        for group, chunks in rest.items():
            held = self.waiting.getValue((group,)) if self.groups else None
            self.groups += held is None
            self.waiting.updateValue((group,), (_packed({**chunks, **_unpacked(held[0])} if held else chunks),))

    def _row(self, key, position: int, title: str | None = None, sound: bytes | None = None, lost: bool = False) -> Row:
        return Row(stream_id=key[0], position=position, title=title, sound=sound, lost=lost)

    def _rows(self, key, cycle: Cycle, payload: bytes) -> Iterator[Row]:
        before = cycle.position
        texts, sound = cycle.take(payload)
        for position, text in texts:
            yield self._row(key, position, title(text))
        if self.sound and sound:
            yield self._row(key, before, sound=b"".join(sound))

    def close(self) -> None:
        pass


def split(chunks: DataFrame, interval: int, sound: bool = False, wait_ms: int | None = None) -> DataFrame:
    """chunks: a stream of stream_id, idx, payload. Returns stream_id, position (bytes of sound before it), title (NULL if a text has none), sound and lost: a row for each text; if `sound`, also the
    bytes of sound of each chunk. With wait_ms the query runs on for its timers, so it must not be triggered by availableNow."""
    with_rocksdb(chunks.sparkSession)
    kind = chunks.schema["stream_id"].dataType.simpleString()
    plain = chunks.select("stream_id", "idx", "payload")
    mode = "None" if wait_ms is None else "ProcessingTime"
    out = f"stream_id {kind}, position long, title string, sound binary, lost boolean"
    return plain.groupBy("stream_id").transformWithState(_Processor(interval, sound, wait_ms), out, "Append", mode)

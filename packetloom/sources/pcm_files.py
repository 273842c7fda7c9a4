"""Uncompressed audio files as a batch source that reads by byte ranges.

    spark.dataSource.register(PcmFiles)
    spark.read.format("pcm").option("path", "/media/*.wav").load().filter("source = '/media/a.wav' and pts >= 48000")

Rows are those of `pcm.packets`: source, idx, position, size, pts, duration, layout, channels, rate, payload. Files are on a path that all machines mount; only their sizes are looked at
by the driver. Large files are cut into ranges of `split_bytes`, and a packet belongs to the range that its first byte is in; small ones share a task up to that
size. A task maps the file, so it reads the header's pages and those of its packets.

With spark.sql.python.filterPushdown.enabled, filters on `source` choose files before any is opened, and filters on idx, pts, duration, position and size are arithmetic on a packet's
place: what they leave out (muted files, what lies before a seek or behind an end) is not read. Files that are no audio, or of no known layout, give no rows."""

from __future__ import annotations

import glob
import mmap
import operator
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from . import pcm

SCHEMA = "source string, idx long, position long, size long, pts long, duration long, layout string, channels int, rate int, payload binary"
_ARROW = pa.schema([
    ("source", pa.string()), *((c, pa.int64()) for c in ("idx", "position", "size", "pts", "duration")), ("layout", pa.string()), ("channels", pa.int32()), ("rate", pa.int32()), ("payload", pa.binary()),
])
LEAST, SPLIT, BATCH = 1024, 16 << 20, 4 << 20
PLACES = ("idx", "position", "size", "pts", "duration")
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class Ranges(InputPartition):
    """Files, with the bytes in which a packet begins."""

    parts: list[tuple[str, int, int]]


def files_of(path: str) -> list[tuple[str, int]]:
    """Files and sizes of a pattern, a folder or a file; several, a line each."""
    out = []
    for one in filter(None, map(str.strip, path.split("\n"))):
        one = re.sub(r"^file:(//)?", "", one)
        for name in sorted(glob.glob(one)) if glob.has_magic(one) else [one]:
            inside = sorted(os.path.join(d, f) for d, _, names in os.walk(name) for f in names if not f.startswith((".", "_"))) if os.path.isdir(name) else [name]
            out += [(f, os.path.getsize(f)) for f in inside]
    return out


def ranges_of(files: list[tuple[str, int]], split: int) -> list[Ranges]:
    out, held, room = [], [], split
    for name, size in files:
        if size > split:
            out += [Ranges([(name, at, min(at + split, size))]) for at in range(0, size, split)]
        elif size:
            if size > room and held:
                out.append(Ranges(held))
                held, room = [], split
            held.append((name, 0, size))
            room -= size
    return out + [Ranges(held)] * bool(held)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.least, self.split = options["path"], int(options.get("packet_bytes", LEAST)), int(options.get("split_bytes", SPLIT))
        self.sources: list[Callable[[str], bool]] = []
        self.places: list[tuple[str, Callable, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, IsNotNull) and column in ("source", *PLACES):
                continue  # they never are
            if column == "source" and isinstance(f, EqualTo | In):
                wanted = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.sources.append(wanted.__contains__)
            elif column in PLACES and type(f) in COMPARE and isinstance(f.value, int):
                self.places.append((column, COMPARE[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        files = [(f, n) for f, n in files_of(self.path) if all(test(f) for test in self.sources)]
        return ranges_of(files, self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for name, low, high in partition.parts:
            with open(name, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                yield from self._packets(name, data, low, high)

    def _first(self, start: int, step: int, low: int, each: int, blocks: int, high: int) -> tuple[int, int]:
        """The packets, from and up to which the range and the lower and upper filters reach."""
        n = -(-blocks // each)
        begin, end = max(0, -(-(low - start) // step)), min(n, max(0, -(-(high - start) // step)))
        for column, test, value in self.places:
            unit, base = {"idx": (1, 0), "pts": (each, 0), "position": (step, start)}.get(column, (0, 0))
            if unit and test in (operator.ge, operator.gt, operator.eq):
                begin = max(begin, (value - base) // unit)
            if unit and test in (operator.le, operator.lt, operator.eq):
                end = min(end, (value - base) // unit + 1)
        return begin, end

    def _packets(self, name: str, data, low: int, high: int) -> Iterator[pa.RecordBatch]:
        h = next((h for h in (p(data) for p in (pcm.wav, pcm.au, pcm.aiff)) if h), None)
        if not h or not h["layout"] or h["block"] <= 0:
            return
        each = max(1, -(-self.least // h["block"]))
        step, blocks = each * h["block"], h["data_size"] // h["block"]
        held, size = [], 0
        for idx in range(*self._first(h["data_start"], step, low, each, blocks, high)):
            n = min(each, blocks - idx * each)
            row = {"source": name, "idx": idx, "position": h["data_start"] + idx * step, "size": n * h["block"], "pts": idx * each, "duration": n}
            if all(test(row[column], value) for column, test, value in self.places):
                held.append(row | {"layout": h["layout"], "channels": h["channels"], "rate": h["rate"], "payload": data[row["position"] : row["position"] + row["size"]]})
                size += row["size"]
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(held, _ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class PcmFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

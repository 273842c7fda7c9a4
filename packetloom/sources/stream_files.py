"""A sink that writes each stream's payloads to files, in order.

    spark.dataSource.register(StreamFiles)
    in_order(packets, "source", "idx").write.format("stream_files").option("path", "/media/out").mode("append").save()

Rows are source (string), idx (long), payload (binary), in order in each partition (`in_order` sees to that). A stream is a folder under `path`, named as its
source, percent-coded; its files, named by their first and last idx, follow each other by name. A stream whose rows are in one partition is one file; a large one is several, each by a task of its own.

Nothing is seen before the commit: a task writes to a folder of its own, so an attempt that fails, or a second one of the same task, leaves no row. The driver gets the names, not the data; it moves
the files of the attempts that Spark committed, refuses rows of a stream that overlap, and at last puts the manifest in its place, which alone says what belongs to a run. A run that fails
removes what it wrote. Overwriting replaces the manifest and then removes the files that it no longer names."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: source, first and last idx, rows, bytes, and where it is."""

    files: list[tuple[str, int, int, int, int, str]] = field(default_factory=list)


def in_order(packets: DataFrame, source: str, idx: str, parts: int | None = None, whole: bool = False) -> DataFrame:
    """packets sorted by source and idx over the whole table, so that neighbours share a task and a large stream is cut into ranges. whole: no stream is cut, so each is one file, as readers of headers
    need it; for streams that one task can write."""
    by = [source] if whole else [source, idx]
    spread = packets.repartitionByRange(*by) if parts is None else packets.repartitionByRange(parts, *by)
    return spread.sortWithinPartitions(source, idx)


def manifest(path: str) -> list[dict]:
    """What is there, by source and first idx: source, first, last, rows, bytes, file."""
    try:
        with open(os.path.join(path, MANIFEST)) as f:
            return json.load(f)
    except FileNotFoundError:
        return []


class Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"].removeprefix("file://").removeprefix("file:"), overwrite, f"_run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = os.path.join(self.path, self.run, uuid.uuid4().hex)
        out, done, now, f = Written(), set(), None, None
        try:
            for batch in iterator:
                names = [batch.schema.get_field_index(c) for c in ("source", "idx", "payload")]
                for source, idx, payload in zip(*(batch.column(i) for i in names)):
                    source, idx, payload = source.as_py(), idx.as_py(), payload.as_py()
                    if source is None or idx is None:
                        raise ValueError("a row without source or idx has no place in a file")
                    if now is None or now[0] != source:
                        if now:
                            f.close()
                            out.files.append((*now, f.name))
                        if source in done:
                            raise ValueError(f"rows of {source} don't follow each other")
                        done.add(source)
                        os.makedirs(folder, exist_ok=True)
                        now, f = [source, idx, idx, 0, 0], open(os.path.join(folder, f"{len(done)}"), "wb")
                    elif idx <= now[2]:
                        raise ValueError(f"{source}: {idx} comes after {now[2]}")
                    f.write(payload or b"")
                    now = [source, now[1], idx, now[3] + 1, now[4] + len(payload or b"")]
            if now:
                f.close()
                out.files.append((*now, f.name))
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return out

    def commit(self, messages: list[Written]) -> None:
        new = sorted(f for m in messages if m for f in m.files)
        old = [] if self.overwrite else manifest(self.path)
        every = sorted([(f["source"], f["first"], f["last"]) for f in old] + [f[:3] for f in new])
        for (a, _, last), (b, first, _) in zip(every, every[1:]):
            if a == b and first <= last:
                shutil.rmtree(os.path.join(self.path, self.run), ignore_errors=True)
                raise ValueError(f"{a}: {first} is written twice, or out of order")
        listed, before = list(old), [f["file"] for f in manifest(self.path)]
        for source, first, last, rows, size, at in new:
            folder = quote(source, safe="") or "%"
            os.makedirs(os.path.join(self.path, folder), exist_ok=True)
            file = os.path.join(folder, f"{first + (1 << 63):020d}-{last + (1 << 63):020d}-{self.run[5:13]}")  # idx may be negative
            os.replace(at, os.path.join(self.path, file))
            listed.append({"source": source, "first": first, "last": last, "rows": rows, "bytes": size, "file": file})
        os.makedirs(self.path, exist_ok=True)
        fresh = os.path.join(self.path, f"{self.run}.json")
        with open(fresh, "w") as f:
            json.dump(sorted(listed, key=lambda x: (x["source"], x["first"])), f)
        os.replace(fresh, os.path.join(self.path, MANIFEST))
        for file in before if self.overwrite else []:
            os.remove(os.path.join(self.path, file))
        shutil.rmtree(os.path.join(self.path, self.run), ignore_errors=True)

    def abort(self, messages: list[Written]) -> None:
        shutil.rmtree(os.path.join(self.path, self.run), ignore_errors=True)


class StreamFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stream_files"

    def schema(self) -> str:
        return "source string, idx long, payload binary"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def source_of(file: str) -> str:
    """The source whose file this is."""
    folder = os.path.basename(os.path.dirname(file))
    return "" if folder == "%" else unquote(folder)

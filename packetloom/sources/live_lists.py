"""Live playlists as a streaming source.

    spark.dataSource.register(LiveLists)
    spark.readStream.format("live_list").option("path", "https://host/a.m3u8").option("start", "clock:1651000000000000").load()

A list is a URL, or a file on a path that all machines mount; `path` may be a pattern, which is expanded anew at every trigger, or several URLs, a line each. A folder counts as the file
that its parts make, in the order of their names. The offset holds, for each list, its media sequence: the first number it shows, where reading starts if the list is new, and
the number behind its last. So a query that is restarted from its checkpoint goes on where it stopped, and a list that joins later starts by the same rule.
The driver reads the lists to know their ends; a task reads those it is given, LISTS_A_TASK at most, and returns the segments in between.

`start`: `live` (the middle of a list of up to 10 segments, else the last but one), `first`, `clock:MICROSECONDS` (the last segment that starts then or before; the
first if all start later) or `dseq:N` (the first segment of a discontinuity). What no segment fulfils is read as `live`. `lost`: if segments have left a list before they were read, the query ends with an
error (`fail`), or goes on with the first one there is, marked `late` (`skip`). A list whose numbers fall behind what was read begins anew."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import urljoin
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, seq long, dseq long, uri string, clock_us long, duration_us long, late boolean"
SHORT, LISTS_A_TASK, AT_ONCE, TIMEOUT = 10, 16, 16, 30


@dataclass(frozen=True)
class Segment:
    seq: int
    dseq: int
    uri: str
    clock_us: int | None
    duration_us: int | None


def _clock(text: str) -> int | None:
    try:
        at = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    gone = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (gone.days * 86_400 + gone.seconds) * 1_000_000 + gone.microseconds


def segments(text: str, base: str = "") -> list[Segment] | None:
    """The segments that a list shows; None for a text without a media sequence, which is no live list."""
    numbers = {k: int(v) for k, v in re.findall(r"(?m)^#EXT-X-(MEDIA|DISCONTINUITY)-SEQUENCE:\s*(\d+)", text)}
    if "MEDIA" not in numbers:
        return None
    out: list[Segment] = []
    dseq, clock, duration = numbers.get("DISCONTINUITY", 0), None, None
    for line in map(str.strip, text.splitlines()):
        tag, _, value = line.partition(":")
        if tag == "#EXT-X-DISCONTINUITY":
            dseq += 1
        elif tag == "#EXT-X-PROGRAM-DATE-TIME":
            clock = _clock(value)
        elif tag == "#EXTINF":
            seconds = re.match(r"\s*(\d+(?:\.\d+)?)", value)
            duration = round(float(seconds[1]) * 1_000_000) if seconds else None
        elif line and not line.startswith("#"):
            out.append(Segment(numbers["MEDIA"] + len(out), dseq, urljoin(base, line) if base else line, clock, duration or None))
            clock = clock + duration if clock is not None and duration else None  # of a segment without a duration nothing follows
            duration = None
    return out


def start_of(shown: list[Segment], first: int, rule: str) -> int:
    """The number of the segment that a new reader begins with."""
    kind, _, value = rule.partition(":")
    if kind == "first":
        return first
    if kind == "clock":
        known = [s for s in shown if s.clock_us is not None]
        if known:
            return max((s.seq for s in known if s.clock_us <= int(value)), default=known[0].seq)
    elif kind == "dseq":
        if (found := next((s.seq for s in shown if s.dseq == int(value)), None)) is not None:
            return found
    elif kind != "live":
        raise ValueError(f"start: {rule}")
    return first + (len(shown) // 2 if len(shown) <= SHORT else len(shown) - 2)


def _local(url: str) -> str | None:
    if "://" in url and not url.startswith("file:"):
        return None
    return re.sub(r"^file:(//)?", "", url)


def fetch(url: str) -> str | None:
    """The text of a list, None if it isn't there just now."""
    try:
        if (path := _local(url)) is None:
            with urlopen(url, timeout=TIMEOUT) as answer:
                return answer.read().decode("utf-8", "replace")
        names = [path] if not os.path.isdir(path) else sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_")))
        parts = []
        for name in names:
            with open(name, encoding="utf-8", errors="replace") as f:
                parts.append(f.read())
        return "".join(parts)
    except OSError:
        return None


def _names(path: str) -> list[str]:
    out = []
    for one in filter(None, map(str.strip, path.split("\n"))):
        local = _local(one)
        out += [one] if local is None or not glob.has_magic(local) else sorted(glob.glob(local))
    return out


@dataclass
class Span(InputPartition):
    """Lists, with the numbers from which and up to which they are read."""

    parts: list[tuple[str, int, int]]


class Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.rule, self.lost = options["path"], options.get("start", "live"), options.get("lost", "fail")
        if self.lost not in ("fail", "skip"):
            raise ValueError(f"lost: {self.lost}")
        start_of([], 0, self.rule)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        names = _names(self.path)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            texts = list(pool.map(fetch, names))
        out = {}
        for name, text in zip(names, texts):
            shown = None if text is None else segments(text)
            if shown:  # a list that shows nothing has no end yet
                first = shown[0].seq
                out[name] = {"first": first, "start": start_of(shown, first, self.rule), "next": first + len(shown)}
        self.known = {**getattr(self, "known", {}), **out}  # a list that can't be reached for once keeps its end
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Span]:
        todo = []
        for name, now in sorted(end.items()):
            seen = start.get(name)
            begin = now["start"] if seen is None else seen["next"] if seen["next"] <= now["next"] else now["first"]
            if begin < now["next"]:
                todo.append((name, begin, now["next"]))
        self.known = {**end, **getattr(self, "known", {})}
        return [Span(todo[k : k + LISTS_A_TASK]) for k in range(0, len(todo), LISTS_A_TASK)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for name, begin, behind in partition.parts:
            shown = [s for s in segments(fetch(name) or "", "" if _local(name) else name) or [] if begin <= s.seq < behind]
            gone = (shown[0].seq if shown else behind) - begin
            if gone and self.lost == "fail":
                raise ValueError(f"{name}: {gone} segments from {begin} on have left the list before they were read")
            for k, s in enumerate(shown):
                yield name, s.seq, s.dseq, s.uri, s.clock_us, s.duration_us, bool(gone and k == 0)


class LiveLists(DataSource):
    """Rows source, seq, dseq (its discontinuity), uri, clock_us, duration_us, late."""

    @classmethod
    def name(cls) -> str:
        return "live_list"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)

"""Uncompressed audio files: headers by a small parser in tasks, packets by expressions on the file's bytes.

Input is source, content (binary), as `spark.read.format("binaryFile")` gives it."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.samples import decode_pcm
from packetloom.functions.timebase import div

HEADER = "struct<layout: string, channels: int, rate: int, block: int, data_start: bigint, data_size: bigint, tags: map<string,string>>"
_ARROW = pa.struct([
    ("layout", pa.string()), ("channels", pa.int32()), ("rate", pa.int32()), ("block", pa.int32()), ("data_start", pa.int64()), ("data_size", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())),
])
#: Tags of INFO and AIFF chunks.
INFO = {b"INAM": "Title", b"IART": "Artist", b"IPRD": "Album", b"IGNR": "Genre", b"ICRD": "Date", b"ICMT": "Comment", b"ICOP": "Copyright", b"ISFT": "Software", b"ITRK": "Track"}
AIFF = {b"NAME": "Title", b"AUTH": "Author", b"(c) ": "Copyright", b"ANNO": "Comment"}
WAV_LAYOUTS = {(1, 8): "u8", (1, 16): "s16le", (1, 24): "s24le", (1, 32): "s32le", (3, 32): "f32le", (3, 64): "f64le", (6, 8): "alaw", (7, 8): "ulaw"}
AU_LAYOUTS = {1: ("ulaw", 1), 2: ("s8", 1), 3: ("s16be", 2), 27: ("alaw", 1)}


def _chunks(data: bytes, at: int, end: int, order: str):
    """id, first byte and size of each chunk; a size that reaches beyond the end is cut there."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from(f"{order}I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def _text(b: bytes) -> str:
    return b.split(b"\0")[0].decode("latin-1").strip()


def wav(data: bytes) -> dict | None:
    """RIFF WAVE: fmt and data chunks, and INFO tags wherever they stand."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    out: dict = {"tags": {}}
    for name, at, size in _chunks(data, 12, len(data), "<"):
        if name == b"fmt " and size >= 16:
            code, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", data, at)
            if code == 0xFFFE and size >= 26:
                code = struct.unpack_from("<H", data, at + 24)[0]
            out |= {"layout": WAV_LAYOUTS.get((code, bits)), "channels": channels, "rate": rate, "block": block}
        elif name == b"data" and "data_start" not in out:
            out |= {"data_start": at, "data_size": size}
        elif name == b"LIST" and data[at : at + 4] == b"INFO":
            out["tags"] |= {INFO[n]: _text(data[a : a + s]) for n, a, s in _chunks(data, at + 4, at + size, "<") if n in INFO}
    return out if "layout" in out and "data_start" in out else None


def au(data: bytes) -> dict | None:
    if data[:4] != b".snd" or len(data) < 24:
        return None
    start, size, code, rate, channels = struct.unpack_from(">5I", data, 4)
    if code not in AU_LAYOUTS:
        return None
    layout, width = AU_LAYOUTS[code]
    comment = _text(data[24:start])
    return {"layout": layout, "channels": channels, "rate": rate, "block": width * channels, "data_start": start, "data_size": min(size, len(data) - start), "tags": {"Comment": comment} if comment else {}}


def _extended(b: bytes) -> int:
    """An 80-bit float as an integer."""
    exponent, mantissa = struct.unpack(">HQ", b)
    return mantissa >> (16383 + 63 - (exponent & 0x7FFF)) if 16383 <= exponent & 0x7FFF <= 16446 else 0


def aiff(data: bytes) -> dict | None:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        return None
    out: dict = {"tags": {}}
    for name, at, size in _chunks(data, 12, len(data), ">"):
        if name == b"COMM" and size >= 18:
            channels, _, bits = struct.unpack_from(">hIh", data, at)
            kind = data[at + 18 : at + 22] if data[8:12] == b"AIFC" else b"NONE"
            layout = {b"NONE": {8: "s8", 16: "s16be", 24: "s24be", 32: "s32be"}.get(bits), b"sowt": "s16le", b"fl32": "f32be", b"FL32": "f32be", b"fl64": "f64be", b"ulaw": "ulaw", b"alaw": "alaw"}.get(kind)
            width = {"ulaw": 1, "alaw": 1}.get(layout, (bits + 7) // 8)
            out |= {"layout": layout, "channels": channels, "rate": _extended(data[at + 8 : at + 18]), "block": width * channels}
        elif name == b"SSND" and size >= 8:
            out |= {"data_start": at + 8, "data_size": size - 8}
        elif name in AIFF:
            out["tags"][AIFF[name]] = _text(data[at : at + size])
    return out if "layout" in out and "data_start" in out else None


def header(content: Column) -> Column:
    """The header of a WAV, AU or AIFF file as a struct; NULL for anything else. The layout is NULL if it isn't known."""

    @F.arrow_udf(HEADER)
    def read(files: pa.Array) -> pa.Array:
        rows = []
        for f in files:
            data = f.as_py() or b""
            found = next((h for h in (p(data) for p in (wav, au, aiff)) if h), None)
            rows.append(found and found | {"tags": list(found["tags"].items())})
        return pa.array(rows, _ARROW)

    return read(content)


def packets(files: DataFrame, least: int = 1024) -> DataFrame:
    """source, idx, position, size, pts, duration, layout, channels, rate, payload: data in packets of `least` bytes, rounded to
    whole blocks; what is less than a block at the end is left out."""
    h = files.select("source", "content", header(F.col("content")).alias("h")).filter("h is not null and h.block > 0 and h.layout is not null")
    blocks = div("h.data_size", "h.block")
    each = F.greatest(div(F.lit(least) + F.col("h.block") - 1, "h.block"), F.lit(1))
    cut_ = h.withColumns({"__n": blocks, "__e": each}).filter("__n > 0")
    cut_ = cut_.withColumn("idx", F.explode(F.expr("sequence(0L, (__n - 1) div __e)")))
    pts = F.col("idx") * F.col("__e")
    duration = F.least(F.col("__e"), F.col("__n") - pts)
    position, size = F.col("h.data_start") + pts * F.col("h.block"), duration * F.col("h.block")
    payload = F.substring("content", (position + 1).cast("int"), size.cast("int"))
    return cut_.select("source", "idx", position.alias("position"), size.alias("size"), pts.alias("pts"), duration.alias("duration"), "h.layout", "h.channels", "h.rate", payload.alias("payload"))


def samples(packets_: DataFrame) -> DataFrame:
    """With `data`, the packet's samples as array<double>, channels interleaved; NULL for a layout that isn't known. Each row is decoded
    by the expression of its layout, so files are read once."""
    layouts = ("u8", "s8", "s16le", "s16be", "s24le", "s24be", "s32le", "s32be", "f32le", "f32be", "f64le", "f64be", "alaw", "ulaw")
    data = F.lit(None).cast("array<double>")
    for name in layouts:
        data = F.when(F.col("layout") == name, decode_pcm(F.col("payload"), name)).otherwise(data)
    return packets_.withColumn("data", data)


def write_wav(data: Column, channels: int, rate: int, bits: int) -> Column:
    """A WAV file around little-endian integer samples."""
    little = lambda c, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c.cast("long")), 2 * n, "0"), 2 * (n - i) - 1, 2) for i in range(n)]))
    block = channels * bits // 8
    size = F.octet_length(data)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * block, block, bits).hex()
    return F.concat(F.encode(F.lit("RIFF"), "UTF-8"), little(size + 36, 4), F.encode(F.lit("WAVE"), "UTF-8"), F.unhex(F.lit(fmt)), F.encode(F.lit("data"), "UTF-8"), little(size, 4), data)

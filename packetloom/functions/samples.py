"""Samples and pixels: PCM layouts to numbers, companding laws, colours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def g711_a(code: np.ndarray) -> np.ndarray:
    """A-law to 16 bits, by ITU-T G.711: sign, three bits of exponent, four of mantissa, even bits inverted."""
    x = code.astype(np.int32) ^ 0x55
    exponent, mantissa = (x >> 4) & 7, x & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(x & 0x80, size, -size).astype(np.int32)


def g711_mu(code: np.ndarray) -> np.ndarray:
    """µ-law to 16 bits, by ITU-T G.711: all bits inverted, a bias of 33 in 14 bits."""
    x = ~code.astype(np.int32) & 0xFF
    exponent, mantissa = (x >> 4) & 7, x & 15
    size = ((mantissa << 3) + 0x84 << exponent) - 0x84
    return np.where(x & 0x80, -size, size).astype(np.int32)


def _wide(data: bytes, little: bool) -> np.ndarray:
    """24 bits, left-justified in 32."""
    b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
    low, mid, high = (b[:, i].astype(np.uint32) for i in ((0, 1, 2) if little else (2, 1, 0)))
    return (low << 8 | mid << 16 | high << 24).view(np.int32)


def _fixed(kind: str):
    size = np.dtype(kind).itemsize
    return lambda d: np.frombuffer(d[: len(d) // size * size], kind)


#: Layout to numpy array: integers as they are, 8 bits unsigned around 128, 24 bits left-justified, floats as they are.
LAYOUTS = {
    "u8": lambda d: np.frombuffer(d, np.uint8).astype(np.int32) - 128,
    "s8": lambda d: np.frombuffer(d, np.int8).astype(np.int32),
    "s16le": _fixed("<i2"),
    "s16be": _fixed(">i2"),
    "s24le": lambda d: _wide(d, True),
    "s24be": lambda d: _wide(d, False),
    "s32le": _fixed("<i4"),
    "s32be": _fixed(">i4"),
    "f32le": _fixed("<f4"),
    "f32be": _fixed(">f4"),
    "f64le": _fixed("<f8"),
    "f64be": _fixed(">f8"),
    "alaw": lambda d: g711_a(np.frombuffer(d, np.uint8)),
    "ulaw": lambda d: g711_mu(np.frombuffer(d, np.uint8)),
}


def decode_pcm(data: Column, layout: str) -> Column:
    """array<double> of a binary column, channels interleaved as they are; a part of a sample at the end is dropped."""
    read = LAYOUTS[layout]

    @F.arrow_udf("array<double>")
    def decoded(blocks: pa.Array) -> pa.Array:
        rows = [None if b.as_py() is None else read(b.as_py()).astype(np.float64) for b in blocks]
        offsets = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0), *[r for r in rows if r is not None]])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([r is None for r in rows], pa.bool_()))

    return decoded(data)


def to_int16(samples: Column) -> Column:
    """Floats in -1 to 1 as 16 bits: times 32767, rounded half up, clipped."""
    return F.transform(samples, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 32767 + 0.5), F.lit(32767)), F.lit(-32768)).cast("int"))


def channel(samples: Column, channels: int, number: int) -> Column:
    """One channel of interleaved samples."""
    return F.filter(samples, lambda _, i: i % channels == number)


#: The weights of r, g, b in y, u and v, and what is added.
YUV = {"y": (0.257, 0.504, 0.098, 16), "u": (-0.148, -0.291, 0.439, 128), "v": (0.439, -0.368, -0.071, 128)}


def palette_yuv(r: Column, g: Column, b: Column) -> Column:
    """Struct y, u, v of 8-bit colours, cut to integers."""
    return F.struct(*[(r * wr + g * wg + b * wb + base).cast("long").alias(n) for n, (wr, wg, wb, base) in YUV.items()])

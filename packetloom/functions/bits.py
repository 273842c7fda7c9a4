"""Numbers of variable length in binary columns, read in all rows of a batch at once.

A Cursor holds a bit position in each row's bytes; each read moves it, by as much as the row's own number takes. Rows whose bytes end before their number does become invalid, and stay so."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LACES = "struct<head: int, sizes: array<bigint>>"
NONE, XIPH, FIXED, EBML = range(4)


class Cursor:
    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.at, self.end = offsets[:-1] * 8, offsets[1:] * 8
        self.valid = np.array(column.is_valid())

    def bytes_left(self) -> np.ndarray:
        return (self.end - self.at) >> 3

    def peek(self, n: int | np.ndarray) -> np.ndarray:
        """n bits, 56 at most, of every row, as int64; bits behind its end are what follows in memory, so they don't count."""
        first = np.minimum(self.at >> 3, len(self.data) - 9)
        word = np.zeros(len(first), np.uint64)
        for k in range(8):
            word = word << np.uint64(8) | self.data[first + k]
        n = np.broadcast_to(np.asarray(n, np.int64), word.shape)
        word = word << (self.at & 7).astype(np.uint64)
        return np.where(n > 0, word >> np.minimum(64 - n, 63).astype(np.uint64), 0).astype(np.int64)

    def bits(self, n: int | np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The next n bits; 0 in rows that aren't asked (a mask), or are invalid."""
        rows = self.valid if rows is None else rows & self.valid
        n = np.broadcast_to(np.asarray(n, np.int64), self.at.shape)
        fits = self.at + n <= self.end
        self.valid &= fits | ~rows
        rows = rows & fits
        out = np.where(rows, self.peek(n), 0)
        self.at = np.where(rows, self.at + n, self.at)
        return out

    def _zeros(self, n: int) -> np.ndarray:
        """How many of the next n bits (32 at most) are zero before the first one."""
        return n - np.frexp(self.peek(n).astype(float))[1]

    def exp_golomb(self, rows: np.ndarray | None = None) -> np.ndarray:
        """As many zeros as bits follow the first one; less 1. More than 24 zeros are no number."""
        rows = self.valid if rows is None else rows & self.valid
        zeros = self._zeros(25)
        self.valid &= (zeros < 25) | ~rows
        return np.where(rows & self.valid, self.bits(2 * np.minimum(zeros, 24) + 1, rows) - 1, 0)

    def signed_exp_golomb(self, rows: np.ndarray | None = None) -> np.ndarray:
        """1, -1, 2, -2 and so on."""
        n = self.exp_golomb(rows)
        return np.where(n & 1, (n + 1) >> 1, -(n >> 1))

    def ebml(self, rows: np.ndarray | None = None, signed: bool = False) -> np.ndarray:
        """Zeros before the first one of the first byte tell how many bytes follow it, six at most; signed: less the middle of the range."""
        rows = self.valid if rows is None else rows & self.valid
        more = self._zeros(8)
        self.valid &= (more < 7) | ~rows
        size = np.minimum(more, 6) + 1
        n = self.bits(8 * size, rows) - (np.int64(1) << (7 * size))
        return np.where(rows & self.valid, n - ((np.int64(1) << (7 * size - 1)) - 1 if signed else 0), 0)

    def runs(self, rows: np.ndarray | None = None) -> np.ndarray:
        """Bytes of 255 and one below, summed."""
        rows = self.valid if rows is None else rows & self.valid
        out = np.zeros(len(self.at), np.int64)
        while rows.any():
            n = self.bits(8, rows)
            out += n
            rows = rows & self.valid & (n == 255)
        return np.where(self.valid, out, 0)


def _laces(payload: pa.Array, kind: pa.Array) -> pa.Array:
    c = Cursor(payload)
    total, kind = c.bytes_left(), np.array(kind.fill_null(-1))
    c.valid &= (kind >= NONE) & (kind <= EBML)
    laced = kind != NONE
    count = np.where(laced, c.bits(8, laced) + 1, 1)
    coded = c.valid & ((kind == XIPH) | (kind == EBML))
    most = int(count[coded].max(initial=1))
    sizes = np.zeros((len(count), most), np.int64)  # 256 columns at most
    for k in range(most - 1):
        asked = coded & (k < count - 1)
        now = c.runs(asked & (kind == XIPH))
        if k == 0:
            now = now + c.ebml(asked & (kind == EBML))
        else:
            now = now + np.where(asked & (kind == EBML), sizes[:, k - 1] + c.ebml(asked & (kind == EBML), signed=True), 0)
        sizes[:, k] = now
    head = total - c.bytes_left()
    rest = c.bytes_left() - sizes.sum(axis=1)
    c.valid &= (rest >= 0) & (sizes.min(axis=1) >= 0)
    out = []
    for valid, own, n, what, left, h, size in zip(c.valid.tolist(), sizes, count.tolist(), kind.tolist(), rest.tolist(), head.tolist(), c.bytes_left().tolist()):
        if not valid:
            out.append(None)
        elif what == FIXED:
            out.append({"head": h, "sizes": [size // n] * n})
        else:
            out.append({"head": h, "sizes": [*own[: n - 1].tolist(), left]})
    return pa.array(out, pa.struct([("head", pa.int32()), ("sizes", pa.list_(pa.int64()))]))


def lace_sizes(payload: Column, kind: Column) -> Column:
    """How a block is laced: kind 0 one frame, 1 runs of 255, 2 frames of one size, 3 a variable-length number and differences to it. A struct of the bytes before the frames and the
    frames' sizes; NULL for a block whose sizes end too early or are more than it has."""

    @F.arrow_udf(LACES)
    def of(payload: pa.Array, kind: pa.Array) -> pa.Array:
        return _laces(payload, kind)

    return of(payload, kind.cast("int"))


def sums_before(values: Column) -> Column:
    """Of an array of bigint, for each element the sum of those before it; NULL counts as 0, a NULL array stays."""

    @F.arrow_udf("array<bigint>")
    def of(lists: pa.Array) -> pa.Array:
        own = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        before = np.cumsum(own) - own  # of the whole batch, then less what stood before the row
        starts = np.concatenate([[0], ends[:-1]])
        first = np.append(before, 0)[starts]
        before -= np.repeat(first, ends - starts)
        offsets = pa.array(np.concatenate([starts, ends[-1:]]).astype(np.int32), mask=np.append(np.array(lists.is_null()), False))
        return pa.ListArray.from_arrays(offsets, pa.array(before, pa.int64()))

    return of(values)


def write_laces(sizes: Column, kind: Column) -> Column:
    """The bytes before the frames, in hexadecimal; sizes is an array of bigint of 1 to 256."""
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    runs = lambda x: F.concat(F.repeat(F.lit("FF"), F.floor(x / 255).cast("int")), byte(x % 255))

    def ebml(x: Column, signed: bool) -> Column:
        out = None
        for n in range(1, 7):
            bias = (1 << (7 * n - 1)) - 1 if signed else 0
            coded = F.lpad(F.hex(x + bias + (1 << 7 * n)), 2 * n, "0")
            fits = (x >= -bias) & (x <= (1 << (7 * n - 1)) - 1) if signed else x < (1 << 7 * n) - 1
            out = F.when(fits, coded) if out is None else out.when(fits, coded)
        return out

    most = F.slice(sizes, 1, F.size(sizes) - 1)
    moved = F.transform(most, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(sizes, i - 1)))  # of sizes itself: a slice in a lambda would be cut anew for each element
    steps = F.transform(moved, lambda x, i: F.when(i == 0, ebml(x, False)).otherwise(ebml(x, True)))
    head = byte(F.size(sizes) - 1)
    return F.when(kind == NONE, "").when(kind == FIXED, head).when(kind == XIPH, F.concat(head, F.array_join(F.transform(most, runs), ""))).otherwise(F.concat(head, F.array_join(steps, "")))

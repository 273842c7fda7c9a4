"""Byte-level BPE encoding and decoding, on padded numpy matrices.

A text is split by a pattern into pieces. The distinct new pieces of a batch are sorted into length buckets, each a
padded matrix with a piece a row. In every round each row merges its leftmost pair of least rank; pairs are looked up
in a hash table, only the pairs beside a merge are looked up anew, rows close the gap, and rows without a pair leave
the matrix. Pieces of more than LONG bytes, on which rounds would be quadratic, are merged by a heap to the same ids.
Pieces met before are remembered up to a bound.

Ids are those that the tiktoken library gives without special tokens. Ranks are a file of base64 tokens and ranks, whose
path is a parameter; each Python worker reads it once, so it must be there on every machine.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body

NONE = np.int32(2**31 - 1)
LONG, CACHE, ROWS = 512, 150_000, 8192
_coders: dict[tuple[str, str], Coder] = {}


class Coder:
    """The tables of one rank file, and the pieces met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.token = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    out.append(rank)
        self._hash_pairs(np.array(left, np.int64), np.array(right, np.int64), np.array(out, np.int32))
        self.known: dict[str, tuple[int, ...]] = {}
        self.text_of = {r: str(r) for r in self.token}

    def _hash_pairs(self, left, right, out):
        """Open addressing: a pair sits at most `self.tries - 1` places after its own."""
        self.size = 1 << max(4, int(4 * len(out)).bit_length())
        key = left << 32 | right
        self.keys, self.values = np.full(self.size, -1, np.int64), np.full(self.size, NONE, np.int32)
        place, todo, self.tries = self._place(key), np.arange(len(key)), 0
        while len(todo):
            free = todo[self.keys[place[todo]] < 0]
            _, first = np.unique(place[free], return_index=True)
            set_ = free[first]
            self.keys[place[set_]], self.values[place[set_]] = key[set_], out[set_]
            todo = np.setdiff1d(todo, set_, assume_unique=True)
            place[todo] = (place[todo] + 1) & (self.size - 1)
            self.tries += 1

    def _place(self, key):
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - self.size.bit_length())).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none. Negative ids are padding."""
        key = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        key[(a < 0) | (b < 0)] = -2
        place = self._place(key)
        out = np.where(self.keys[place] == key, self.values[place], NONE)
        open_ = (self.keys[place] != key) & (self.keys[place] >= 0)
        for _ in range(self.tries - 1):
            if not open_.any():
                break
            place = (place + 1) & (self.size - 1)
            hit = open_ & (self.keys[place] == key)
            out[hit] = self.values[place[hit]]
            open_ &= ~hit & (self.keys[place] >= 0)
        return out

    def matrix(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Of pieces of like length."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lens.max())
        inside = np.arange(width) < lens[:, None]
        ids = np.full(inside.shape, -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1) if width > 1 else np.full((len(ids), 1), NONE, np.int32)
        out: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = rank.argmin(axis=1)  # the first of equals: the leftmost
            low = rank[np.arange(len(rank)), at]
            done = low == NONE
            if done.any():
                for i, x in zip(row[done].tolist(), ids[done].tolist()):
                    out[i] = tuple(v for v in x if v >= 0)
                row, ids, rank, at, low = row[~done], ids[~done], rank[~done], at[~done], low[~done]
                if not len(row):
                    break
            n = np.arange(len(row))
            ids[n, at] = low
            keep = np.ones(ids.shape, bool)
            keep[n, at + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            if ids.shape[1] == 1:
                rank = np.full((len(row), 1), NONE, np.int32)
                continue
            keep = np.ones(rank.shape, bool)
            keep[n, at] = False
            rank = rank[keep].reshape(len(row), -1)
            right = at < rank.shape[1]
            rank[n[right], at[right]] = self.pairs(ids[n[right], at[right]], ids[n[right], at[right] + 1])
            left = at > 0
            rank[n[left], at[left] - 1] = self.pairs(ids[n[left], at[left] - 1], ids[n[left], at[left]])
        return out

    def long(self, piece: bytes) -> tuple[int, ...]:
        """By a heap of (rank, place) over a linked list."""
        ids: list = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        token, ranks = self.token, self.ranks()
        heap = []

        def put(i):
            if i >= 0 and after[i] < n and (r := ranks.get(token[ids[i]] + token[ids[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            put(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(before[i])
            put(i)
        return tuple(x for x in ids if x is not None)

    def ranks(self) -> dict[bytes, int]:
        if not hasattr(self, "_ranks"):
            self._ranks = {t: r for r, t in self.token.items()}
        return self._ranks

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > CACHE:
            self.known = {}
        by_length: dict[int, list[str]] = {}
        for p in pieces:
            n = len(p.encode())
            if n > LONG:
                self.known[p] = self.long(p.encode())
            else:
                by_length.setdefault(n if n <= 16 else -(-n // 16) * 16, []).append(p)
        for same in by_length.values():
            for i in range(0, len(same), ROWS):
                part = same[i : i + ROWS]
                self.known.update(zip(part, self.matrix([p.encode() for p in part])))

    def encode(self, texts: list[str]):
        """The ids of each text, as a list."""
        split = [self.split(t) for t in texts]
        new = {p for p in set(chain.from_iterable(split)) if p not in self.known}
        if new:
            if len(self.known) + len(new) > CACHE:
                new = set(chain.from_iterable(split))
            self.learn(new)
        get = self.known.__getitem__
        for pieces in split:
            yield list(chain.from_iterable(map(get, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(read_ranks(path), pattern)
    return _coders[path, pattern]


#: Characters of the texts that are encoded at once.
AT_ONCE = 1 << 20


def _in_parts(texts):
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= AT_ONCE:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_column(text_col: str, path: str, pattern: str):
    """array<int> of ids; null counts as an empty text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        c = coder(path, pattern)
        rows = [np.array(x, np.int32) for part in _in_parts(t.as_py() for t in texts) for x in c.encode(part)]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))

    return ids(body(text_col))


def decode_column(ids_col: str, path: str, pattern: str):
    """binary: the bytes of array<int> ids; null for null."""

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        c = coder(path, pattern)
        return pa.array([None if (x := v.as_py()) is None else c.decode(x) for v in ids], pa.binary())

    return decoded(F.col(ids_col))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: id_col, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the
    bytes that the ids decode to). Null and empty texts have no token. Rows may repeat; other columns are not read."""

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digests(texts: pa.Array) -> pa.Array:
        c = coder(path, pattern)
        sha, said = hashlib.sha256, None
        n, a, b = [], [], []
        for part in _in_parts(t.as_py() for t in texts):
            said = c.text_of.__getitem__
            for ids in c.encode(part):
                n.append(len(ids))
                a.append(sha(" ".join(map(said, ids)).encode()).hexdigest())
                b.append(sha(c.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digests(body(text_col)).alias("d")).select(id_col, "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")

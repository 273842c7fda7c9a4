"""Ranked lexical search over bit-sliced Bloom signatures.

The index. A document's signature is a Bloom filter of its terms, and of how often it has them: a term that occurs tf times is put in
once for each of LEVELS up to tf. Documents of like size share a block, whose signatures have the same width and are stored by bit: a
slice is one bit of every document, as a bitmap, so the documents that may hold a term at a level are the AND of HASHES bitmaps. Bits are never lost, so presence
is overestimated and never missed. Beside the signatures the index has each document's number of terms, and how many documents hold a term,
by a 64-bit hash of the term; different terms of the same hash would count together.

The search. For a block, the slices of an item's terms, each weighted by what its level can add to the score of each document, sum to an upper
bound of every document's score. A first pass over the blocks finds the `seeds` documents with the highest bounds of each item; their exact scores set the item's bar,
the k-th of them. A second pass keeps every document whose bound reaches the bar; no other can be among the k best. What it keeps is scored exactly from its text,
and ranked; equal scores by id, nulls last, then by row. Items are searched in batches of at most ITEMS, so what tasks are sent is bounded; the index is built once.

Terms are the maximal runs of characters that are no ASCII control, blank or punctuation; only A-Z are lower-cased. A null text has none.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, cut

#: Numbers of occurrences that are marked, and the greatest a document has that reaches one and not the next.
LEVELS = [1, 2, 3, 4, 6, 8, 12, *(v for k in range(4, 31) for v in (1 << k, 3 << (k - 1)))]
MOST = [*(x - 1 for x in LEVELS[1:]), None]
#: Bits of a signature for each mark, hashes of a mark, documents of a block at most, and bits of a block while it is made.
BITS, HASHES, DOCS, CELLS = 16, 3, 2048, 1 << 24
#: Items of a batch and bytes of their texts; columns of a block that are summed at a time; (document, item) pairs sent to all tasks at most; hashes held before they are counted.
ITEMS, ITEM_BYTES, COLUMNS, FEW, HELD = 1024, 32 << 20, 512, 500_000, 2_000_000

#: What is no part of a term becomes a blank, A-Z become a-z; bytes of other characters stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def counts_of(text: str | None) -> Counter:
    """The terms of a text, in UTF-8, and how often it has them."""
    return Counter(text.encode("utf-8", "surrogatepass").translate(FOLD).split()) if text else Counter()


class Hashes(dict):
    """64-bit hashes of terms, remembered up to a bound."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        h = self[term] = xxhash.xxh64_intdigest(term)
        return h


def marks(h: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the terms at a level."""
    x = h ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cells(mark: np.ndarray, width: int) -> np.ndarray:
    """HASHES bits of a mark, a column each; width is a power of two."""
    a, b = mark >> np.uint64(32), (mark & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) & np.uint64(width - 1)).astype(np.int64)


# --- the index --------------------------------------------------------------------------------------------


def _width(n_marks: int) -> int:
    return 1 << max(8, (n_marks * BITS - 1).bit_length())


def _block(width: int, docs: list[tuple]) -> dict:
    """docs: (id, row, key, n_terms, marks)."""
    bits = np.zeros((width, -(-len(docs) // 8) * 8), bool)
    own = np.concatenate([d[4] for d in docs])
    at = np.repeat(np.arange(len(docs)), [len(d[4]) for d in docs])
    for column in cells(own, width).T:
        bits[column, at] = True
    ids, rows, keys, n, _ = zip(*docs)
    return {"width": width, "ids": ids, "rows": rows, "keys": keys, "n": n, "bits": np.packbits(bits, axis=1).tobytes(), "hashes": None, "dfs": None}


def _indexer(id_type: pa.DataType):
    schema = pa.schema([
        ("width", pa.int32()), ("ids", pa.list_(id_type)), ("rows", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
        ("bits", pa.binary()), ("hashes", pa.binary()), ("dfs", pa.binary()),
    ])

    def run(batches):
        known, waiting, seen, held = Hashes(), {}, [], 0
        one = lambda row: pa.RecordBatch.from_pylist([row], schema)

        def dictionary():
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            return one(dict.fromkeys(schema.names) | {"hashes": h.tobytes(), "dfs": n.astype(np.int64).tobytes()})

        for batch in batches:
            for i, row, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not (c := counts_of(text)):
                    continue
                h = np.fromiter(map(known.__getitem__, c), np.uint64, len(c))
                tf = np.fromiter(c.values(), np.int64, len(c))
                seen.append(h)
                held += len(h)
                own, most = [], int(tf.max())
                for level, least in enumerate(LEVELS):
                    if least > most:
                        break
                    own.append(marks(h if level == 0 else h[tf >= least], level))
                own = np.concatenate(own)
                width = _width(len(own))
                group = waiting.setdefault(width, [])
                group.append((i, row, key, int(tf.sum()), own))
                if len(group) >= min(DOCS, max(8, CELLS // width)):
                    yield one(_block(width, waiting.pop(width)))
                if held >= HELD:
                    yield dictionary()
                    seen, held = [], 0
        for width, group in waiting.items():
            yield one(_block(width, group))
        if seen:
            yield dictionary()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of docs that have a term, written to the shared folder; other columns are not read. Rows with the same id are rows of their own. An
    empty table gives an index without blocks, in which nothing is found."""
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), _key(id_col, text_col), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType
    schema = f"width int, ids array<{kind.simpleString()}>, rows array<long>, keys array<long>, n array<long>, bits binary, hashes binary, dfs binary"
    return cut(rows.mapInArrow(_indexer(_arrow(kind)), schema))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), body(text_col)).alias("key")


# --- the search -------------------------------------------------------------------------------------------


class Batch:
    """Items as arrays over the batch's terms; weights once the counts are known."""

    def __init__(self, items: list[tuple]):
        """items: (item_id, text)."""
        self.ids = [i for i, _ in items]
        self.term: dict[bytes, int] = {}
        self.of: list[tuple[np.ndarray, np.ndarray]] = []
        for _, text in items:
            c = counts_of(text)
            at = [self.term.setdefault(t, len(self.term)) for t in c]
            self.of.append((np.array(at, np.int64), np.array(list(c.values()), np.int64)))
        self.hash = np.array([xxhash.xxh64_intdigest(t) for t in self.term], np.uint64)

    def weigh(self, df: dict[int, int], docs: int, terms: int) -> None:
        self.docs, self.terms = docs, terms
        w = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.term))], np.int64)
        there = np.array([df.get(t, 0) > 0 for t in range(len(self.term))], bool)  # no document has the others
        self.of = [(at[there[at]], (n * w[at])[there[at]]) for at, n in self.of]

    def length(self, n: list[int]) -> np.ndarray:
        return np.array([75 + 25 * x * self.docs // self.terms for x in n], np.int64)


def factor(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _steps(m: np.ndarray, levels: int) -> list[np.ndarray]:
    """What each level adds to the most that a term can give to documents of length m."""
    upto = [np.full(len(m), 1_000_000, np.int64) if MOST[k] is None else factor(MOST[k], m) for k in range(levels)]
    return [b - a for a, b in zip([np.zeros(len(m), np.int64), *upto], upto)]


def bounds(batch: Batch, width: int, bits: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores, an item a row and a document a column. bits: slices of these documents."""
    n = len(m)
    alive, present = np.arange(len(batch.hash)), None
    sums, place = np.zeros((0, n)), np.full(len(batch.hash), -1)
    for level, step in enumerate(_steps(m, len(LEVELS))):
        at = cells(marks(batch.hash[alive], level), width)
        now = np.bitwise_and.reduce(bits[at], axis=1)
        if present is not None:
            now &= present
        some = now.any(axis=1)
        alive, present = alive[some], now[some]
        if not len(alive):
            break
        if level == 0:
            place[alive] = np.arange(len(alive))
            sums = np.zeros((len(alive), n))
        sums[place[alive]] += np.unpackbits(present, axis=1, count=n) * step.astype(float)
    out = np.zeros((len(batch.of), n))
    for i, (at, weight) in enumerate(batch.of):
        rows = place[at]
        own = rows >= 0
        if own.any():
            out[i] = weight[own].astype(float) @ sums[rows[own]]
    return out * (1 + 1e-9)  # the sums are whole numbers, exact below 2 ** 53


def _searcher(held, id_type: pa.DataType, seeds: int | None, bars: list[int] | None):
    """(item, bound, id, row, key) of documents that may count: the `seeds` best of an item so far in a task, or all that reach the bars."""
    schema = pa.schema([("item", pa.int32()), ("bound", pa.float64()), ("id", id_type), ("row", pa.int64()), ("key", pa.int64())])

    def run(batches):
        batch: Batch = held.value
        least = np.ones(len(batch.of)) if bars is None else np.array(bars, float)
        best = [np.zeros(0)] * len(batch.of)
        for part in batches:
            for r in range(part.num_rows):
                width, ids, rows, keys, n, bits = (part.column(c)[r] for c in ("width", "ids", "rows", "keys", "n", "bits"))
                width, m = width.as_py(), batch.length(n.as_py())
                slices = np.frombuffer(bits.as_buffer(), np.uint8).reshape(width, -1)
                for k in range(0, len(m), COLUMNS):
                    upper = bounds(batch, width, slices[:, k // 8 : (k + COLUMNS) // 8], m[k : k + COLUMNS])
                    items, columns = [], []
                    for i in np.flatnonzero(upper.max(axis=1) >= least):
                        at = np.flatnonzero(upper[i] >= least[i])
                        if bars is None:
                            if len(at) > seeds:
                                at = at[np.argpartition(upper[i, at], -seeds)[-seeds:]]
                            best[i] = np.sort(np.concatenate([best[i], upper[i, at]]))[-seeds:]
                            if len(best[i]) == seeds:
                                least[i] = best[i][0]
                        items += [i] * len(at)
                        columns += at.tolist()
                    if items:
                        take = pa.array(np.array(columns) + k)
                        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(upper[items, columns]), *(x.values.take(take) for x in (ids, rows, keys))], schema=schema)

    return run


def _counter(held):
    """How often the batch's terms and (as -1 and -2) documents and terms occur."""

    def run(batches):
        h = held.value.hash
        order = np.argsort(h)
        df, docs, terms = np.zeros(len(h), np.int64), 0, 0
        for part in batches:
            for r in range(part.num_rows):
                if part.column("n")[r].is_valid:
                    n = part.column("n")[r].values
                    docs, terms = docs + len(n), terms + sum(n.to_pylist())
                else:
                    own, n = np.frombuffer(part.column("hashes")[r].as_buffer(), np.uint64), np.frombuffer(part.column("dfs")[r].as_buffer(), np.int64)
                    at = np.minimum(np.searchsorted(own, h[order]), len(own) - 1)
                    hit = own[at] == h[order]
                    df[order[hit]] += n[at[hit]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int64()), pa.array([*df[some].tolist(), docs, terms], pa.int64())], ["term", "n"])

    return run


def _scorer(held, id_type: pa.DataType):
    schema = pa.schema([("key", pa.int64()), ("id", id_type), ("item", pa.int32()), ("score", pa.int64())])

    def run(batches):
        batch: Batch = held.value
        for part in batches:
            keys, ids, items, scores = [], [], [], []
            for key, i, text, asked in zip(*(c.to_pylist() for c in part.columns)):
                c = counts_of(text)
                m = int(batch.length([c.total()])[0])
                f = np.zeros(len(batch.term), np.int64)
                for t in c.keys() & batch.term.keys():
                    f[batch.term[t]] = factor(c[t], m)
                keys += [key] * len(asked)
                ids += [i] * len(asked)
                items += asked
                scores += [int((batch.of[q][1] * f[batch.of[q][0]]).sum()) for q in asked]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, id_type), pa.array(items, pa.int32()), pa.array(scores, pa.int64())], schema=schema)

    return run


def _exact(found: DataFrame, docs: DataFrame, held, id_col: str, text_col: str) -> DataFrame:
    """item, id, row, score of found (item, id, row, key), which is written. Texts are read once; they shuffle only if more than FEW are asked for."""
    kind = docs.schema[id_col].dataType
    wanted = found.groupBy("key", "id").agg(F.collect_set("item").alias("asked")).withColumnRenamed("id", "own")
    wanted = F.broadcast(wanted) if found.limit(FEW + 1).count() <= FEW else wanted
    texts = docs.select(_key(id_col, text_col), F.col(id_col).alias("id"), body(text_col).alias("text")).join(wanted, "key").filter(F.col("id").eqNullSafe(F.col("own")))
    scored = texts.select("key", "id", "text", "asked").mapInArrow(_scorer(held, _arrow(kind)), f"key long, id {kind.simpleString()}, item int, score long")
    scored = scored.groupBy("key", "item", "id").agg(F.max("score").alias("score")).withColumnRenamed("id", "own")  # rows of the same id and text have one score
    return found.join(scored, ["key", "item"]).filter(F.col("id").eqNullSafe(F.col("own")) & (F.col("score") > 0)).select("item", "id", "row", "score")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with their rank. Spark keeps the k best of a task before it shuffles."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(index: DataFrame, docs: DataFrame, items: list[tuple], k: int, seeds: int, id_col: str, text_col: str) -> DataFrame:
    """item (its number in the batch), rank, id, score."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    schema = f"item int, bound double, id {kind.simpleString()}, row long, key long"
    batch = Batch(items)
    counts = index.select("n", "hashes", "dfs").mapInArrow(_counter(spark.sparkContext.broadcast(batch)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r.term: r.n for r in counts.collect()}  # a row a term of the batch
    docs_n, terms_n = df.pop(-1, 0), df.pop(-2, 0)
    batch.weigh(df, docs_n, max(1, terms_n))
    held = spark.sparkContext.broadcast(batch)
    blocks = index.filter(F.col("width").isNotNull())
    first = blocks.mapInArrow(_searcher(held, _arrow(kind), seeds, None), schema)
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "row")
    first = cut(first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= seeds).drop("place"))
    bars = [1] * len(items)
    for r in _best(_exact(first, docs, held, id_col, text_col), k).filter(F.col("rank") == k).select("item", "score").collect():  # a row an item
        bars[r["item"]] = r.score
    found = cut(blocks.mapInArrow(_searcher(held, _arrow(kind), None, bars), schema))
    return cut(_best(_exact(found, docs, held, id_col, text_col), k).select("item", "rank", "id", "score"))


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, index: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", seeds: int | None = None,
) -> DataFrame:
    """item_col, rank (from 1), id_col, score: the k rows of docs with the highest score above 0 of each row of items.

    Items without terms, and with none that a document has, give no row, nor do empty tables. Rows of items with the same id are searched each for itself. `index` is what
    build_index gave for the same docs."""
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col) if index is None else index
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    batches = max(1, -(-size.n // ITEMS), -(-size.bytes // ITEM_BYTES))
    if batches > 1:
        asked = cut(asked.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2 * batches))))
    out = []
    for b in range(1 if batches == 1 else 2 * batches):
        own = [(r.id, r.text) for r in (asked if batches == 1 else asked.filter(F.col("batch") == b)).collect()]
        if not own and out:
            continue
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(own)], f"item int, {item_col} {items.schema[item_col].dataType.simpleString()}")
        found = _search(index, docs, own, k, seeds or 2 * k, id_col, text_col)
        out.append(found.join(F.broadcast(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result

"""Exact dedup by two-pass Bloom filtering.

The first pass puts a 64-bit hash of every normalised text into a blocked Bloom filter whose cells count
none, one, or more. A text that occurs twice has no cell below two, so the cells at two, as bits, tell
which rows may repeat and never miss one. The second pass asks these bits: rows that can't repeat go
straight through, and only the others are shuffled, to be grouped exactly by SHA-256.

Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts as empty. Of equal
texts the one with the most code points stays, then the one with the smallest id (null ids last), then the
first as read.

The filter takes 16 bits a row. What would be more than `max_filter_bytes` is cut into shards by ranges of the hash, one filter after another: the hashes
are written in order, so each shard reads its own part of every file, and only one filter is held at a time. So as many rows go straight
through however many there are. Where whole rows are to be told apart, a second filter, of the texts that the shards found repeated, does that in one pass
over them; it has 32 bits for each of these, and only where that is more than `max_filter_bytes` more rows are shuffled; the result stays the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, body, cut, fresh, lookup_join

#: A block is 2 ** 16 cells; a hash sets two of them, and its top bits choose the block.
BLOCK = 1 << 16
BITS_A_ROW = 16


def _normal(text: str) -> Column:
    return F.regexp_replace(body(text), BLANKS, "")


def _blocks(rows: int, max_filter_bytes: int) -> int:
    """Power of two."""
    most = max(1, max_filter_bytes * 8 // BLOCK)
    return 1 << min(max(0, (rows * BITS_A_ROW // BLOCK).bit_length()), most.bit_length() - 1)


def _place(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, and the two cells in it."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(40)) & np.uint64(blocks - 1)
    return block.astype(np.int64), (h & np.uint64(0xFFFF)).astype(np.int64), ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)


def _sketch(blocks: int):
    """The hashes of a task by block, as packed low halves; of equal ones two suffice."""

    def run(batches):
        for batch in batches:
            h = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
            if len(h) > 2:
                h = h[np.concatenate([[True, True], h[2:] != h[:-2]])]
            block, _, _ = _place(h, blocks)
            order = np.argsort(block, kind="stable")
            block, low = block[order], (h.view(np.uint64)[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(starts[1:], len(block))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[starts], pa.int64()), pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["block", "low"]
            )

    return run


def _merge(batches):
    """Blocks arrive sorted, so one is open at a time. Returns its cells that count two or more, as bits."""
    at, count = None, np.zeros(BLOCK, np.int64)

    def closed():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(count >= 2).tobytes()], pa.binary())], ["block", "twice"])

    for batch in batches:
        for block, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block != at:
                if at is not None:
                    yield closed()
                at, count = block, np.zeros(BLOCK, np.int64)
            x = np.frombuffer(low, np.uint32)
            count += np.bincount(x & 0xFFFF, minlength=BLOCK) + np.bincount(x >> 16, minlength=BLOCK)
    if at is not None:
        yield closed()


def may_repeat(hashes: DataFrame, rows: int, max_filter_bytes: int = 32 << 20):
    """From a one-column DataFrame of 64-bit hashes, a function of a hash column that is true for all
    hashes that occur more than once, and for few others. At most max_filter_bytes reach the driver."""
    spark = hashes.sparkSession
    blocks = _blocks(rows, max_filter_bytes)
    sparse = hashes.mapInArrow(_sketch(blocks), "block long, low binary")
    parts = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = sparse.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_merge, "block long, twice binary")
    bits = bytearray(blocks * BLOCK // 8)
    for row in merged.collect():
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = row.twice
    held = spark.sparkContext.broadcast(bytes(bits))

    @F.arrow_udf("boolean")
    def probe(h: pa.Array) -> pa.Array:
        twice = np.frombuffer(held.value, np.uint8)
        block, a, b = _place(h.to_numpy(zero_copy_only=False).astype(np.int64), blocks)
        hit = lambda cell: (twice[(block * BLOCK + cell) >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
        return pa.array((hit(a) & hit(b)).astype(bool))

    return probe


def _shards(rows: int, max_filter_bytes: int) -> int:
    """Ranges of the hash whose filters fit, a power of two."""
    return 1 << max(0, -(-rows * BITS_A_ROW // (8 * max(max_filter_bytes, BLOCK // 8))) - 1).bit_length()


def _asked(known: DataFrame, rows: int, max_filter_bytes: int) -> DataFrame:
    """known, a written table with `h`, with `again`: whether a hash may repeat."""
    shards = _shards(rows, max_filter_bytes)
    if shards == 1:
        return known.withColumn("again", may_repeat(known.select("h"), rows, max_filter_bytes)(F.col("h")))
    step, out = (1 << 64) // shards, None
    for k in range(shards):
        low = k * step - (1 << 63)
        own = known.filter((F.col("h") >= low) & (F.col("h") <= low + step - 1))
        own = cut(own.withColumn("again", may_repeat(own.select("h"), -(-rows // shards), max_filter_bytes)(F.col("h"))))
        out = own if out is None else out.unionByName(own)
    return out


def _known(digests: DataFrame, rows: int, max_filter_bytes: int) -> DataFrame:
    """digests, written; in the order of their hashes if there are several shards, so that a range of them is a few pages of each file."""
    return cut(digests if _shards(rows, max_filter_bytes) == 1 else digests.sortWithinPartitions("h"))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = _normal(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(norm, 256)).alias("sha"),
        F.xxhash64(norm).alias("h"),
        F.length(body(text_col)).cast("long").alias("n_chars"),
    )


def _groups(repeated: DataFrame, *last: str, h: bool = False) -> DataFrame:
    """One row for each text: its row that stays, the size of its group, and if wanted its hash. Groups are summed before they are shuffled."""
    order = F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), *last)
    return repeated.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"), *[F.min("h").alias("h")] * h)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 32 << 20) -> DataFrame:
    """One row for each of docs: id_col, keep_id, group_size, kept, text_sha256. Other columns are not read.

    Null and empty texts are equal texts. Rows with the same id are rows of their own; exactly one row of a
    group is kept. An empty table gives an empty result."""
    rows = docs.count()
    known = _known(_digests(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), rows, max_filter_bytes)
    asked = _asked(known, rows, max_filter_bytes)
    alone = asked.filter(~F.col("again")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    repeated = asked.filter(F.col("again")).drop("again", "h")
    groups = _groups(repeated, "rid")  # read thrice below, from one exchange
    joined = lookup_join(repeated, groups, "sha", "group_size", rows).select(
        "id", F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "sha"
    )
    return alone.unionByName(joined).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 32 << 20) -> DataFrame:
    """docs without the repeats of a text: the rows that assign() keeps, with all their columns and no other.

    Null and empty texts are equal texts. Of equal texts the longest stays, then the one with the smallest id (null ids last); of rows that are alike in text, length and id, any one. An
    empty table gives an empty result."""
    sha, h, chars, again, first, weight = fresh(docs, "sha", "h", "n_text_chars", "again", "first", "group_size")
    norm = _normal(text_col)
    rows = docs.count()
    known = _known(_digests(docs, id_col, text_col), rows, max_filter_bytes)
    if _shards(rows, max_filter_bytes) == 1:
        probe = may_repeat(known.select("h"), rows, max_filter_bytes)
        groups = _groups(known.filter(probe(F.col("h"))))
    else:
        groups = cut(_groups(_asked(known, rows, max_filter_bytes).filter("again"), h=True).filter("group_size > 1"))
        twice = groups.select(F.explode(F.array("h", "h")).alias("h"))
        probe = may_repeat(twice, 2 * groups.count(), max_filter_bytes)
    groups = groups.select(F.col("sha").alias(sha), F.col("first").alias(first), F.col("group_size").alias(weight))
    wide = docs.withColumns({sha: F.unhex(F.sha2(norm, 256)), h: F.xxhash64(norm), chars: F.length(body(text_col)).cast("long")})
    wide = wide.withColumn(again, probe(F.col(h)))
    alone = wide.filter(~F.col(again)).select(docs.columns)
    best = lookup_join(wide.filter(F.col(again)), groups, sha, weight, rows).filter(
        (F.col(chars) == -F.col(f"{first}.less")) & F.col(id_col).eqNullSafe(F.col(f"{first}.id"))
    )
    return alone.unionByName(best.dropDuplicates([sha]).select(docs.columns))

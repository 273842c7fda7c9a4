"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of racks, racks of regions; any depth will do. A row descends from the root: at each node every child draws
-ln(u) / weight, u a hash of the row's key and the child's path, and the least draw wins, so children get rows in
proportion to their weights (a node's weight is the sum of its leaves'). A draw depends on the key, the path and the weight of the child alone. So when
a weight changes, rows go only from or to the subtrees whose weights changed: a shard that joins as a region of its own takes rows
only into itself; one that joins a rack also brings its region and its rack some rows for their other shards.

The law is `key`: the key and the tree decide, nothing else; rows with the same key go to the same shard. A null key counts as
the empty text. Slots number the rows of a shard from 0, without gaps, in the order of another hash of the key, then of key, size and
checksum (nulls first). They are counted in buckets of the hash, so no task sees a whole shard. Only in a bucket that holds more than
HOT times its share (a key that repeats as often), the parts in which rows were read come first in the order; identical rows
are interchangeable.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT as FEW
from .common import body, cut, fresh

#: Rows of a bucket, all shards together, and how many times as many make it a hot one.
ROWS, HOT = 1 << 18, 4
#: Bits of a draw, as hexadecimal digits of an MD5 digest.
DIGITS = 12


@dataclass(frozen=True)
class Leaf:
    """A shard, the names of the nodes above it and its own, and its weight."""

    shard: int
    path: tuple[str, ...]
    weight: float = 1.0


def tree_of(n: int, regions: int = 2, racks: int = 2, shards: int = 2) -> list[Leaf]:
    """A tree of n shards of weight 1: the first ones fill a grid of regions, racks and shards, each further one is a region of its
    own, so one more shard takes rows only into itself."""
    out = []
    for i in range(n):
        grid = i < regions * racks * shards
        region, rack = (i // (racks * shards), i // shards % racks) if grid else (regions + i - regions * racks * shards, 0)
        out.append(Leaf(i, (f"region{region}", f"rack{rack}", f"shard{i}")))
    return out


def _nodes(tree: list[Leaf]) -> tuple[list[list[tuple[int, str, float]]], list[int | None], int]:
    """Children of each node (number, path, weight), the shard of each leaf, and the depth. Node 0 is the root."""
    if not tree or len({x.path for x in tree}) < len(tree) or any(not x.path or not x.weight > 0 or math.isinf(x.weight) for x in tree):
        raise ValueError("a tree has leaves of different paths and positive, finite weights")
    number, weight, shard = {(): 0}, {}, {}
    for leaf in tree:
        for k in range(1, len(leaf.path) + 1):
            number.setdefault(leaf.path[:k], len(number))
            weight[leaf.path[:k]] = weight.get(leaf.path[:k], 0.0) + leaf.weight
        shard[leaf.path] = leaf.shard
    if any(leaf.path[:k] in shard for leaf in tree for k in range(1, len(leaf.path))):
        raise ValueError("a shard has no nodes below it")
    kids: list[list[tuple[int, str, float]]] = [[] for _ in number]
    for path, n in number.items():
        if path:
            kids[number[path[:-1]]].append((n, "/".join(path), weight[path]))
    return kids, [shard.get(path) for path in number], max(len(x.path) for x in tree)


def _draw(key: Column, label: Column | str) -> Column:
    """DIGITS hexadecimal digits of the hash of key and label, as a number."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), label).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def shard_of(key: str | Column, tree: list[Leaf]) -> Column:
    """The shard of a key, an int: one draw for each child on the way down."""
    key = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    kids, shard, depth = _nodes(tree)
    row = lambda n, label, w: F.struct(F.lit(n).alias("node"), F.lit(label).alias("label"), F.lit(w).alias("weight"))
    below = F.array(*[F.array(*[row(*k) for k in own or [(n, "", 1.0)]]) for n, own in enumerate(kids)])  # a leaf leads to itself
    at = F.lit(0)
    for _ in range(depth):
        drawn = lambda k: F.struct((-F.ln((_draw(key, k["label"]) + 0.5) / 16.0**DIGITS) / k["weight"]).alias("draw"), k["node"].alias("node"))
        at = F.array_min(F.transform(F.element_at(below, at + 1), drawn))["node"]
    return F.element_at(F.array(*[F.lit(s).cast("int") for s in shard]), at + 1)


def _bits(rows: int) -> int:
    return max(0, (rows // ROWS).bit_length())


def assign(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: id_col, size (UTF-8 bytes of the text and 1), text_crc32 (unsigned), law, shard, slot, and grown_shard, the shard in
    the tree `grown`, null if there is none.

    Null and empty texts have the size 1 and the checksum 0. Rows with the same id share a shard and get slots of their own. Other columns are not
    read. An empty table gives an empty result."""
    text = body(text_col)
    known = cut(docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        shard_of(id_col, tree).alias("shard"),
        (shard_of(id_col, grown) if grown else F.lit(None).cast("int")).alias("grown"),
        _draw(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "slot").alias("h"),
        F.spark_partition_id().alias("part"),
    ))
    known = known.withColumn("bucket", F.shiftright("h", 4 * DIGITS - _bits(known.count())))
    hot = known.groupBy("shard", "bucket").count().filter(F.col("count") > HOT * ROWS).select("shard", "bucket", F.lit(True).alias("hot"))
    several = hot.limit(FEW + 1).count()
    if several:
        known = known.join(F.broadcast(hot) if several <= FEW else hot, ["shard", "bucket"], "left")
        known = known.withColumn("piece", F.when(F.col("hot"), F.col("part")).otherwise(0)).drop("hot")
    else:
        known = known.withColumn("piece", F.lit(0))
    by = ["shard", "bucket", "piece"]
    before = Window.partitionBy("shard").orderBy("bucket", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    counts = known.groupBy(*by).count()
    first = counts.select(*by, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy(*by).orderBy("h", "id", "size", "crc")
    return known.join(first, by).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("first") + F.row_number().over(own) - 1).alias("slot"), F.col("grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, tree: list[Leaf], path: str, id_col: str = "doc_id", rows_a_file: int = 1 << 20) -> None:
    """docs as Parquet, a folder shard=k for each shard that has rows; in a file rows follow the hash that orders slots. Files of a shard are buckets
    of the hash, rows_a_file rows at most; Spark splits a bucket that repeats of one key make large. Null ids, ties and repeated rows stay; an empty table writes no shard."""
    shard, h, bucket = fresh(docs, "shard", "h", "bucket")
    n = docs.count()
    files = max(1, -(-n // rows_a_file))
    wide = docs.withColumns({shard: shard_of(id_col, tree), h: _draw(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "slot")})
    wide = wide.withColumn(bucket, F.floor(F.col(h) / 16.0**DIGITS * files))
    wide.hint("rebalance", shard, bucket).sortWithinPartitions(shard, h).drop(h, bucket).write.partitionBy(shard).option("maxRecordsPerFile", rows_a_file).parquet(path)


def movement(docs: DataFrame, before: list[Leaf], after: list[Leaf], id_col: str = "doc_id") -> DataFrame:
    """How many rows go from each shard of one tree to each of another: from_shard, to_shard, n. An empty table gives an empty result."""
    return docs.groupBy(shard_of(id_col, before).alias("from_shard"), shard_of(id_col, after).alias("to_shard")).agg(F.count(F.lit(1)).alias("n"))

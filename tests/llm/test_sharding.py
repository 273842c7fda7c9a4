"""The hash tree against the same draws in plain Python, and its law."""

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from packetloom.llm import sharding
from packetloom.llm.common import shared_dir
from packetloom.llm.sharding import Leaf

from ..conftest import SMALLEST


def draw(key, label):
    return int(hashlib.md5(f"{key}/{label}".encode()).hexdigest()[:12], 16)


def plain_shard(key, tree):
    key, at = "" if key is None else str(key), ()
    while not any(x.path == at for x in tree):
        weight = collections.Counter()
        for x in tree:
            if x.path[: len(at)] == at:
                weight[x.path[: len(at) + 1]] += x.weight
        at = min(weight, key=lambda p: -math.log((draw(key, "/".join(p)) + 0.5) / 16**12) / weight[p])
    return next(x.shard for x in tree if x.path == at)


def check_rows(got, rows, tree, grown=None):
    assert len(got) == len(rows)
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_shard(i, tree), grown and plain_shard(i, grown)) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and {r.law for r in got} <= {"key"}


def test_shards_of_odd_rows(odd, odd_rows):
    tree, grown = sharding.tree_of(8), sharding.tree_of(9)
    got = sharding.assign(odd, tree, grown).collect()
    check_rows(got, [r[:2] for r in odd_rows], tree, grown)
    again = sharding.assign(odd.repartition(7), tree, grown).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


@pytest.mark.parametrize("few", [1000, 0])
def test_a_key_of_half_the_rows(spark, monkeypatch, few):
    """Buckets of a few rows, one key that repeats; hot buckets by broadcast and by a shuffled join."""
    monkeypatch.setattr(sharding, "ROWS", 16)
    monkeypatch.setattr(sharding, "FEW", few)
    rows = [(7 if i % 2 else i, f"t{i % 5}" if i % 3 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check_rows(sharding.assign(docs, sharding.tree_of(5)).collect(), rows, sharding.tree_of(5))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"))
    for n in (8, 9, 14):
        moves = sharding.movement(docs, sharding.tree_of(n), sharding.tree_of(n + 1)).collect()
        assert {r.to_shard for r in moves if r.from_shard != r.to_shard} == {n}
        assert abs(sum(r.n for r in moves if r.to_shard == n) - 20_000 / (n + 1)) < 5 * math.sqrt(20_000 / (n + 1))


def test_shares_follow_weights_and_movement_stays_in_what_changed(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"))
    old = [Leaf(i, (f"r{i // 4}", f"k{i // 2}", f"s{i}"), 1.0 + i % 3) for i in range(8)]
    new = [Leaf(x.shard, x.path, x.weight * 2 if x.shard == 5 else x.weight) for x in old]
    total = sum(x.weight for x in old)
    held = {r.from_shard: r["sum(n)"] for r in sharding.movement(docs, old, new).groupBy("from_shard").sum("n").collect()}
    for x in old:
        share = 30_000 * x.weight / total
        assert abs(held[x.shard] - share) < 5 * math.sqrt(share)
    for r in sharding.movement(docs, old, new).collect():
        if r.from_shard != r.to_shard:  # shard 5 grew, and with it rack k2 (4, 5) and region r1 (4 to 7)
            inside = lambda s, lo, hi: lo <= s < hi
            assert inside(r.to_shard, 4, 8) and (not inside(r.from_shard, 4, 8) or inside(r.to_shard, 4, 6))
            assert not inside(r.from_shard, 4, 6) or r.to_shard == 5


def test_written_shards_hold_all_rows(spark, odd):
    path = f"{shared_dir(spark)}/shards"
    tree = sharding.tree_of(3)
    sharding.write_shards(odd, tree, path, rows_a_file=4)
    got = spark.read.schema(odd.schema).parquet(path).select(odd.columns)  # without the folder's shard
    assert sorted(map(repr, got.collect())) == sorted(map(repr, odd.collect()))
    for s in range(3):
        own = spark.read.parquet(f"{path}/shard={s}").select("doc_id").collect()
        assert {plain_shard(r.doc_id, tree) for r in own} <= {s}


def test_refused_trees():
    for tree in ([], [Leaf(0, ("a",)), Leaf(1, ("a",))], [Leaf(0, ("a",), 0.0)], [Leaf(0, ("a",)), Leaf(1, ("a", "b"))]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.lit(1), tree)


def test_no_rows(spark, none):
    assert sharding.assign(none, sharding.tree_of(8), sharding.tree_of(9)).collect() == []


def test_given_rows(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    check_rows(sharding.assign(docs, sharding.tree_of(8), sharding.tree_of(9)).collect(), [(r.doc_id, r.text) for r in docs.collect()], sharding.tree_of(8), sharding.tree_of(9))

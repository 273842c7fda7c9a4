"""Each operator against brute force, on the odd rows and on the smallest tables."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from packetloom.llm import bpe, components, exact_dedup, ftrl, html_text, langid, mixing, simhash, substring_dedup, topk, toxicity, warc
from packetloom.llm.common import shared_dir, split_of

from ..conftest import SMALLEST
from .conftest import words

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts_of(rows):
    return [(r[0], r[1] or "") for r in rows]


def sorted_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 10 -------------------------------------------------------------------------------------------------------


def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def test_exact_dedup(odd, odd_rows):
    rows = texts_of(odd_rows)
    want = brute_dedup(rows)
    got = exact_dedup.assign(odd).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}
    by_sha = collections.defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    assert len(by_sha) == len(want)
    for norm, (keep, n) in want.items():
        own = by_sha[hashlib.sha256(norm.encode()).hexdigest()]
        assert len(own) == n and {r.keep_id for r in own} == {keep} and {r.group_size for r in own} == {n}
        assert [r.doc_id for r in own if r.kept] == [keep]


def test_drop_repeats_keeps_columns_and_one_row_a_text(odd, odd_rows):
    got = exact_dedup.drop_repeats(odd)
    assert got.columns == odd.columns
    want = brute_dedup(texts_of(odd_rows))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted((k is None, k or 0) for k, _ in want.values())


def test_filters_of_many_shards_let_single_rows_through(spark, monkeypatch):
    """The filter of a shard is as full as that of a small table: few single rows are shuffled, and none of the repeated ones is missed."""
    n, few = 60_000, 8192
    texts = F.when(F.col("id") % 20 == 0, F.concat(F.lit("again "), (F.col("id") % 2000).cast("string"))).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), texts.alias("text")).repartition(4)
    assert exact_dedup._shards(n, few) == 16 and exact_dedup._shards(n, 32 << 20) == 1 and exact_dedup._shards(0, few) == 1
    asked = exact_dedup._asked(exact_dedup._known(exact_dedup._digests(docs, "doc_id", "text"), n, few), n, few)
    got = {r.again: r["count"] for r in asked.groupBy("again").count().collect()}
    assert n // 20 <= got[True] < n // 20 + 0.1 * n and sum(got.values()) == n
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert exact_dedup.assign(docs, max_filter_bytes=few).exceptAll(exact_dedup.assign(docs)).count() == 0
    kept = exact_dedup.drop_repeats(docs, max_filter_bytes=few)
    assert kept.count() == n - n // 20 + 100 and kept.filter("text like 'again%' and doc_id >= 2000").count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, max_bits):
    ids = [i for i in prints if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= max_bits:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("shingle, bits", [(3, 3), (1, 6), (3, 0)])
def test_simhash_components(odd, odd_rows, shingle, bits):
    prints = {i: plain_fingerprint(t, shingle) for i, t in texts_of(odd_rows)}
    want = brute_components(prints, bits)
    got = simhash.near_components(odd, shingle=shingle, max_bits=bits).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], want[r.doc_id])


@pytest.mark.parametrize("bits, bucket_rows", [(3, 20000), (3, 40), (8, 20000), (8, 60)])
def test_links_span_all_pairs(spark, bits, bucket_rows):
    """Random fingerprints with clusters, dense ones among them, and buckets that are cut into blocks."""
    rng = random.Random(bits)
    prints = {}
    for c in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30, 150])):
            f = base
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            prints[len(prints)] = f
    first = {}
    for i, f in prints.items():
        first.setdefault(f, i)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in first.items()], "fp long, node long").repartition(3)
    want = brute_components({i: f for f, i in first.items()}, bits)
    found = {r.node: r.component for r in components.components(simhash.link(nodes, bits, bucket_rows=bucket_rows)).collect()}
    assert {i: found.get(i, i) for i in want} == want


def test_a_key_that_many_ask_for_is_split(spark, monkeypatch):
    """One entry, and very many fingerprints near it in the part: only those that ask make the bucket large."""
    rng = random.Random(3)
    low = (1 << 32) - 1
    prints = {0: 0}
    while len(prints) < 400:  # all differ from the entry's part by one bit
        prints[len(prints)] = (1 << 32 + rng.randrange(32)) | (rng.getrandbits(32) & rng.getrandbits(32) & rng.getrandbits(32))
    first = {}
    for i, f in prints.items():
        first.setdefault(f, i)
    monkeypatch.setattr(simhash, "plan", lambda *_: [(low << 32, 1), (low, 1)])
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in first.items()], "fp long, node long").repartition(3)
    want = brute_components({i: f for f, i in first.items()}, 3)
    for rows in (20000, 50, 7):
        found = {r.node: r.component for r in components.components(simhash.link(nodes, 3, bucket_rows=rows)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 500)
    both = np.full((64, 64), 125.0) + np.eye(64) * 125
    for n, bits in ((1000, 3), (10**9, 3), (10**6, 8)):
        parts = simhash.plan(n, np.asarray(both), sample, bits)
        assert sum(t + 1 for _, t in parts) == bits + 1
        assert all(a & b == 0 for k, (a, _) in enumerate(parts) for b, _ in parts[:k])


def test_near_dedup(spark):
    rng = random.Random(9)
    base = [words(rng, 200) for _ in range(30)]
    rows, original = [], {}
    for i, t in enumerate(base):
        rows.append((i, t))
        w = t.split()
        w[100] = "other"
        rows.append((100 + i, " ".join(w)))
        original[100 + i] = i
    docs = spark.createDataFrame([*rows, (None, base[0])], "doc_id long, text string")
    got = [r.doc_id for r in simhash.near_dedup(docs).collect()]
    assert sorted(x for x in got if x is not None) == list(range(30)) and got.count(None) == 1


def shingle_similarity(a, b):
    a, b = (set(simhash._grams(t.encode(), 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def near_copies(rng, low, high):
    """Texts of new words, each with a copy of a similarity from low to high, by kind of copy."""
    fresh = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]
    out = []
    for kind in ("appended", "cut", "edited"):
        while sum(k == kind for k, _, _ in out) < 60:
            w = fresh(rng.randint(60, 200))
            v = list(w)
            if kind == "appended":
                v += fresh(rng.randint(1, len(w) // 2))
            elif kind == "cut":
                at, n = rng.randrange(len(w) // 2), rng.randint(1, len(w) // 3)
                v = w[:at] + w[at + n :]
            else:
                for i in rng.sample(range(len(w)), rng.randint(1, len(w) // 15)):
                    v[i] = fresh(1)[0]
            if low <= shingle_similarity(" ".join(w), " ".join(v)) < high:
                out.append((kind, " ".join(w), " ".join(v)))
    return out


@pytest.mark.parametrize("low, high", [(0.8, 0.85), (0.85, 0.9)])
def test_near_dedup_finds_appended_cut_and_edited_copies(spark, low, high):
    pairs = near_copies(random.Random(17), low, high)
    rows = [(i, a) for i, (_, a, _) in enumerate(pairs)] + [(1000 + i, b) for i, (_, _, b) in enumerate(pairs)]
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [pairs[i - 1000][0] for i in sorted(got) if i >= 1000] == [] and len(got) == len(pairs)


def test_near_dedup_keeps_what_is_below_the_similarity(spark):
    pairs = near_copies(random.Random(18), 0.68, 0.8)
    rows = [(i, a) for i, (_, a, _) in enumerate(pairs)] + [(1000 + i, b) for i, (_, _, b) in enumerate(pairs)]
    assert simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count() == len(rows)


def test_near_dedup_of_dense_groups_equals_all_pairs(spark):
    """Groups of copies of one text, near to it but many not to each other, the text itself last; buckets far larger than FIRST."""
    rng = random.Random(4)
    rows = []
    for c in range(4):
        w = words(rng, 150).split()
        for i in range(40):
            v = list(w)
            for at in rng.sample(range(len(v)), 5 if i < 39 else 0):
                v[at] = f"w{c}x{i}x{at}"
            rows.append((c * 100 + i, " ".join(v)))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and shingle_similarity(a, b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = sorted(r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted({root(i) for i in parent})


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + k) for k in range(300)] + [(5000, 5000)] + [(b, a) for a, b in ((rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60))]
    got = {r.node: (r.component, r["size"]) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    size = collections.Counter(root(x) for x in parent)
    assert got == {x: (root(x), size[root(x)]) for x in parent if size[root(x)] > 1}


# --- 9 --------------------------------------------------------------------------------------------------------


def brute_substrings(rows, window):
    split = [(i, t.encode().split()) for i, t in rows]
    first = {}
    last = 1 << 62
    for i, w in split:
        for p in range(len(w) - window + 1):
            s = b" ".join(w[p : p + window])
            first[s] = min(first.get(s, last), last if i is None else i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[b" ".join(w[p : p + window])] < (last if i is None else i):
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [50, 10])
def test_substring_dedup(odd, odd_rows, window):
    got = sorted_rows(substring_dedup.assign(odd, window=window), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(texts_of(odd_rows), window)


def test_substring_dedup_hot_windows_and_a_full_sketch(spark):
    rng = random.Random(4)
    passage = words(rng, 60)
    rows = [(i, words(rng, 20) + " " + passage + " " + words(rng, 20)) for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_substrings(rows, 50)
    for cells in (1 << 26, 1 << 16):
        assert sorted_rows(substring_dedup.assign(docs, max_cells=cells, hot_docs=20), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize(("hot_docs", "part"), [(10_000, 1 << 16), (2, 1 << 16), (20, 50)])
def test_substring_dedup_by_ranges(spark, odd, odd_rows, monkeypatch, hot_docs, part):
    """The way of texts whose sketch is too large to broadcast gives the same rows: odd texts, hot windows, ranges dealt to several tasks, no rows."""
    monkeypatch.setattr(substring_dedup, "PART", part)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    run = lambda docs, **more: sorted_rows(substring_dedup.assign(docs, max_cells=0, hot_docs=hot_docs, **more), *columns)
    assert run(odd, window=10) == brute_substrings(texts_of(odd_rows), 10)
    rng = random.Random(4)
    passage, other = words(rng, 60), words(rng, 55)
    rows = [(i, words(rng, 20) + " " + (passage if i % 3 else other) + " " + words(rng, 20)) for i in range(260)]
    rows += [(1000, "x " * 5_000), (1001, "x " * 80), (1002, "a b " * 200), (1003, "b a " * 150 + "c"), (1004, None), (1005, ""), (None, passage), (3, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(docs) == brute_substrings([(i, t or "") for i, t in rows], 50)
    assert run(docs.limit(0)) == []


def test_substring_sketches_of_ranges_stay_as_empty_at_any_size():
    """128 ranges as full as texts make them: of anchors that occur once at most a tenth pass, none that repeats is lost, and hot ones are told."""
    ranges = 128
    rng = np.random.default_rng(7)
    n = ranges * substring_dedup.BLOCK // substring_dedup.ROWS * 40 // 130
    single, twice, often = (rng.integers(-(1 << 63), 1 << 63, k) for k in (n, 5_000, 3))
    anchors = rng.permutation(np.concatenate([single, twice, twice, np.repeat(often, 500)]))
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["anchor"]) for x in np.array_split(anchors, 7)]
    counted = pa.Table.from_batches(substring_dedup._count_ranges(ranges)(batches)).sort_by("block").to_batches()
    bits = pa.Table.from_batches(substring_dedup._merge(400)(counted)).sort_by("block")
    assert bits.num_rows == ranges and sum(bits["total"].to_pylist()) == substring_dedup.ROWS * len(anchors)
    block = substring_dedup._cells_of_ranges(anchors.view(np.uint64), ranges)[0] >> 16
    kind = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("id", pa.int64()), ("tag", pa.int64()), ("anchor", pa.int64()), ("two", pa.binary()), ("hot", pa.binary())])
    asked = []
    for k, two, hot in zip(bits["block"].to_pylist(), bits["two"].to_pylist(), bits["hot"].to_pylist()):
        own = anchors[block == k]
        nothing = [None] * len(own)
        rows = [[k] * (len(own) + 1), [0] * (len(own) + 1), [None, *range(len(own))], [None, *[0] * len(own)], [None, *own.tolist()], [two, *nothing], [hot, *nothing]]
        asked += pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(rows, kind)], schema=kind).to_batches(max_chunksize=4_000)
    met = pa.Table.from_batches(substring_dedup._meet(ranges)(asked))
    passed = met["anchor"].to_numpy()
    assert np.isin(twice, passed).all() and np.isin(single, passed).mean() < 0.1
    assert set(often.tolist()) <= set(met.filter(met["hot"])["anchor"].to_pylist()) and sum(met["hot"].to_pylist()) < 3_000


@pytest.mark.parametrize("hot_docs", [2, 10_000])
def test_substring_dedup_of_windows_that_a_text_repeats(spark, hot_docs):
    """A window 10^5 times in one text is one row of it; texts of few different windows, in hot groups and others."""
    rows = [(0, "x " * 100_000), (1, "x " * 80), (2, "a b " * 200), (3, "b a " * 150 + "c"), (4, "y " * 49), (5, "a b " * 30 + "z " + "x " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted_rows(substring_dedup.assign(docs, hot_docs=hot_docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(rows, 50)
    held, _ = substring_dedup._sketch(docs.select("text"), 1 << 16, 50, 10_000)
    sent = docs.selectExpr("doc_id as id", "0L as tag", "text").mapInArrow(substring_dedup._candidates(held, 1 << 16, 50, False), "h1 long, h2 long, id long, place long, more binary")
    assert sent.filter("id = 0").count() <= 1


def test_remove_repeats_keeps_columns(odd):
    got = substring_dedup.remove_repeats(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert got.filter("doc_id = 10").first().text.split() != odd.filter("doc_id = 10").first().text.split()
    assert got.filter("doc_id = 8").first().text == odd.filter("doc_id = 8").first().text


# --- 5 --------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(odd, odd_rows):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    want = []
    for i, t in texts_of(odd_rows):
        ids = own.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = bpe.round_trip(odd, PATH, public_tokenizers.PATTERN)
    assert sorted_rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_columns_round_trip(odd):
    coded = odd.select("text", bpe.encode_column("text", PATH, public_tokenizers.PATTERN).alias("ids"))
    back = coded.withColumn("back", bpe.decode_column("ids", PATH, public_tokenizers.PATTERN).cast("string"))
    assert back.filter(F.coalesce("text", F.lit("")) != F.col("back")).count() == 0


def test_bpe_random_pieces_and_a_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    coder = bpe.Coder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abetionsing éß😀\n  123!") for _ in range(rng.choice([0, 1, 5, 40, 700, 3000]))) for _ in range(200)]
    assert list(coder.encode(texts)) == [own.encode_ordinary(t) for t in texts]


# --- 6 --------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        out = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_targets():
    sizes = {"a": 100, "b": 1, "c": 50, "d": 0, None: 40}
    assert mixing.targets(sizes) == pytest.approx(plain_targets(sizes))
    assert mixing.targets({"a": 5}) == {"a": 5.0} and mixing.targets({}) == {}


def test_route_is_optimal():
    """Against all ways to take words: first the most that the quotas hold, then the least repetition."""
    assert mixing.route({("a",): 10}, {"a": 100}) == {("a",): 30}
    rng = random.Random(5)
    for _ in range(25):
        patterns = {("a",): rng.randint(1, 3), ("a", "b"): rng.randint(1, 3), ("b",): rng.randint(1, 3)}
        quotas = {"a": rng.randint(0, 8), "b": rng.randint(0, 8)}
        cost = lambda n, size: sum((2 * k + 1) * min(size, max(0, n - k * size)) for k in range(3))
        best = None
        for a in range(3 * patterns["a",] + 1):
            for b in range(3 * patterns["b",] + 1):
                for both in range(3 * patterns["a", "b"] + 1):
                    room_a, room_b = quotas["a"] - a, quotas["b"] - b
                    if room_a < 0 or room_b < 0 or both > room_a + room_b:
                        continue
                    rank = (-(a + b + both), cost(a, patterns["a",]) + cost(b, patterns["b",]) + cost(both, patterns["a", "b"]))
                    best = rank if best is None else min(best, rank)
        got = mixing.route(patterns, quotas)
        assert best == (-sum(got.values()), sum(cost(n, patterns[p]) for p, n in got.items()))


def test_mixing(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet").withColumn("source", F.when(F.col("source") == "src3", None).otherwise(F.col("source")))
    got = {r.doc_id: r for r in mixing.assign(docs).collect()}
    again = {r.doc_id: r for r in mixing.assign(docs.repartition(5)).collect()}
    assert got == again
    sizes, taken = collections.Counter(), collections.Counter()
    rows = docs.collect()
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert got[r.doc_id]["size"] == n and got[r.doc_id].taken <= 3 * n and got[r.doc_id].taken % max(n, 1) == 0
        sizes[r.source] += n
        taken[r.source] += got[r.doc_id].taken
    want = plain_targets(sizes)
    largest = max(r["size"] for r in got.values())
    for r in rows:
        assert got[r.doc_id].source_size == sizes[r.source] and got[r.doc_id].target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], largest)


def test_mix_gives_what_assign_takes(odd):
    taken = collections.Counter()
    for r in mixing.assign(odd).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    got = collections.Counter()
    for r in mixed.select("doc_id", mixing.n_words("text").alias("n")).collect():
        got[r.doc_id] += r.n
    assert got == +taken


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 2 else ["a", "b"]) for i in range(40)] + [(99, "w", None), (98, "w", [])]
    got = mixing.assign(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"))
    assert got.count() == 42 and got.filter("taken > 3 * size").count() == 0


# --- 1, 8 -----------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.classify(docs, labels, split_of("doc_id", 3) == 1)
    rows = got.join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert {0, 1} == {r.predicted for r in rows} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    clean, toxic = [r for r in rows if not r.toxic], [r for r in rows if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_toxicity_without_labels_and_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.classify(odd, labels, split_of("doc_id", 3) == 1)
    assert got.count() == odd.count() and got.filter("score <> 0 or predicted <> 0").count() == 0
    some = spark.createDataFrame([(i, i % 2) for i in (0, 3, 5, 7, 8, 9, 20, 21)], "doc_id long, toxic int")
    assert toxicity.classify(odd, some, split_of("doc_id", 3) == 1).filter("score between 0 and 1").count() == odd.count()
    kept = toxicity.drop_toxic(odd, some, split_of("doc_id", 3) == 1)
    assert kept.columns == odd.columns


def test_label_model_finds_planted_rates_and_dependences():
    """Four voters of known rates, of which two copy each other more than the classes explain; noise that three voters share; noisy labels."""
    rng = np.random.default_rng(0)
    truth = rng.random(6000) < 0.3
    good = [np.where(truth, rng.random(6000) < r, rng.random(6000) < f) for r, f in ((0.8, 0.05), (0.6, 0.02), (0.7, 0.1))]
    copy = np.where(rng.random(6000) < 0.9, good[2], rng.random(6000) < 0.3)
    noise = rng.random(6000) < 0.1
    votes = np.stack([*good, copy, noise, noise, noise], axis=1)
    given = np.where(rng.random(6000) < 0.05, ~truth, truth)
    m = toxicity.label_model(votes, given, kinds=3, start=np.array([0, 1]))
    assert ((m["posterior"] > 0.5) == truth).mean() > 0.94 and ((m["posterior"] > 0.5) == truth).mean() > (given == truth).mean()
    for j, (r, f) in enumerate(((0.8, 0.05), (0.6, 0.02), (0.7, 0.1))):
        assert abs(m["rates"][1, j] - r) < 0.1 and abs(m["rates"][0, j] - f) < 0.1
    assert abs(m["rates"][1, -1] - 0.95) < 0.06 and abs(m["rates"][0, -1] - 0.05) < 0.06  # the given label, a voter like others
    tied = {frozenset((j, int(p))) for j, p in enumerate(m["parent"]) if p >= 0}
    assert frozenset((2, 3)) in tied and len(tied & {frozenset((4, 5)), frozenset((5, 6)), frozenset((4, 6))}) == 2
    assert m["correlations"][4, 5] > 0.95 and abs(m["correlations"][0, 4]) < 0.1


def test_posterior_is_that_of_the_tables():
    """Against Bayes' rule, vote by vote."""
    rng = np.random.default_rng(1)
    votes, given = rng.random((300, 5)) < 0.3, rng.random(300) < 0.4
    votes[:, 4] = votes[:, 3] ^ (rng.random(300) < 0.1)
    m = toxicity.label_model(votes, given, kinds=3, rounds=200)
    v = np.concatenate([votes, given[:, None]], axis=1).astype(int)
    for i in range(0, 300, 17):
        like = []
        for k in range(len(m["share"])):
            x = m["share"][k]
            for j, p in enumerate(m["parent"]):
                x *= m["tables"][k, j, v[i, p] if p >= 0 else 0, v[i, j]]
            like.append(x)
        assert m["posterior"][i] == pytest.approx(np.dot(like, m["toxic"]) / sum(like), abs=0.02)


def test_lexicons_are_mined_from_other_rows_than_those_they_vote_on():
    """A feature that only one row has never speaks up in it; one of many rows speaks up in the others."""
    truth = np.array([1, 1, 0, 0] * 50)
    features = [np.unique(np.array([1000 + i, 7] if t else [1000 + i], np.uint32)) for i, t in enumerate(truth)]
    votes = toxicity._votes(truth, features)
    assert votes.shape == (200, toxicity.DEALT) and (votes.any(axis=1) == (truth == 1)).all() and votes.any(axis=0).sum() == 1


def test_ftrl_learns_sparse_weights():
    rng = np.random.default_rng(0)
    rows, wanted = [], []
    for _ in range(400):
        y = rng.integers(2)
        at = np.unique(np.append(rng.integers(10, 200, 20), y))
        rows.append((at, np.ones(len(at))))
        wanted.append(np.eye(2)[y])
    w, b = ftrl.fit(rows, np.array(wanted), 200, l1=1.0, l2=0.01)
    assert w[0, 0] > 1 and w[1, 1] > 1 and (np.abs(w[10:]).max(axis=1) < 0.2).mean() > 0.95


def test_temperature_cools_overconfidence():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 500)
    logits = np.eye(3)[np.where(rng.random(500) < 0.7, truth, rng.integers(0, 3, 500))] * 20
    assert ftrl.temperature(logits, truth) > 2 and ftrl.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_langid_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, split_of("doc_id", 5) == 0).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_odd_rows(odd, odd_rows):
    got = langid.predict(odd, split_of("doc_id", 5) == 0).collect()
    assert len(got) == len(odd_rows)
    text = dict(texts_of(odd_rows))
    for r in got:
        letters = any(c.isalpha() for c in text.get(r.doc_id, ""))
        assert (r.lang_pred == "und") == (not letters) or r.doc_id is None


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "hello there, my friend", "en"), (2, "½ ²", "en"), (3, "Ⅳ 12", "en"), (6, "½ é", "en"), (4, "how are you", "en"), (7, "guten tag", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, F.lit(False)).collect()}
    assert got[2] == got[3] == "und" and got[6] != "und" and got[1] != "und"
    with pytest.raises(ValueError):
        langid.fit(docs, F.lit(False), max_languages=1)


def test_ngram_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Ein Text, äöü. " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert (langid.counts(text) == whole).all()


# --- 2 --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_pages(spark):
    rng = random.Random(3)
    big, small = "<p>" + words(rng, 400), "<p>tiny"
    rows = [(1, "http://a/ b\r\nX: 1", big), (2, "http://b/é", big), (7, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "u", big), (8, "u", "é" * 600), (8, "u", "é" * 600), (9, "u", words(rng, 30000))]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard int")


def test_warc_round_trip(spark, odd_pages):
    rows, pages = odd_pages
    out = f"{shared_dir(spark)}/warc-test"
    got = sorted_rows(warc.round_trip(pages, out, shard_bytes=20_000, file_bytes=3_000), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        last = max((j for j, _, x in rows if j is not None and (x or "").encode() == b), default=None)
        revisit = len(b) >= 1000 and i != last and last is not None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=repr)
    again = warc.write(pages.repartition(4), out + "2", shard_bytes=20_000, file_bytes=3_000)
    first = spark.read.parquet(f"{out}/_manifest")
    assert sorted_rows(first, "file", "records", "bytes", "sha256") == sorted_rows(again, "file", "records", "bytes", "sha256") and first.count() > 2
    payloads = {r.page_id: r.payload for r in warc.read(spark, out).filter("record_type = 'response'").collect()}
    assert payloads[9].decode() == rows[-1][2] and payloads[5] == b""


def test_warc_shards_are_even_though_an_id_is_far(spark):
    rng = random.Random(1)
    rows = [(i, "u", words(rng, 30)) for i in range(2000)] + [(10**12, "u", "x"), (-(2**62), "u", "y"), (None, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    size = sum(len(h) for _, _, h in rows)
    out = f"{shared_dir(spark)}/warc-far"
    manifest = warc.write(pages, out, shard_bytes=size // 20, file_bytes=2_000).collect()
    shards = collections.Counter()
    for r in manifest:
        shards[r.file.split("-")[0]] += r.records
    assert len(shards) >= 15 and max(shards.values()) < 300 and len(manifest) > 2 * len(shards)
    assert {r.page_id for r in warc.read(spark, out).collect()} == {i for i, _, _ in rows}


@pytest.mark.parametrize("gap", [1, 2, 1000])
def test_warc_counts_slots_by_shards_not_by_rows(spark, gap):
    """Dense and gapped ids, and one far away: what the driver holds depends on the shards alone."""
    for n in (4_000, 40_000):
        known = spark.range(n).select((F.col("id") * gap).alias("page_id"), F.lit(10).cast("long").alias("size"))
        for rows in (known, known.unionByName(spark.createDataFrame([(10**15, 10), (None, 10)], "page_id long, size long"))):
            total = rows.agg(F.sum("size").alias("size"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
            starts, most = warc._starts(rows, total, 20)
            assert most <= 20 * (warc.SLOTS + 2 * warc.FINER) and 15 <= len(starts) <= 21
            sizes = rows.groupBy(warc._index_in(starts, spark)("page_id")).sum("size").collect()
            assert max(r["sum(size)"] for r in sizes) < 2 * total["size"] / 20


def test_warc_rolls_by_default(spark):
    rng = random.Random(2)
    rows = [(i, "u", "".join(rng.choice("abcdefghijklmnop") for _ in range(200_000))) for i in range(60)]
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{shared_dir(spark)}/warc-roll").collect()
    assert len(manifest) > 1 and sum(r.records for r in manifest) == 60 and all(r.bytes <= 1 << 20 for r in manifest)


def test_warc_of_no_pages(spark, odd_pages):
    assert warc.round_trip(odd_pages[1].limit(0), f"{shared_dir(spark)}/warc-none").count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dim, scale", [(64, 64.0), (3, 64.0), (20, 1e9)])
def test_topk(spark, dim, scale):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, dim)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 380)]  # ties
    bad = [(1000, None), (1020, [float("nan")] * dim), (1040, [None] * dim), (1060, [float("inf")] * dim), (None, rows[1][1]), (1080, [])]
    got = topk.top_k(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 7, scale)
    v = {i: [int(x) for x in np.floor(scale * np.array(x))] for i, x in rows}
    want = []
    for q in v:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:7]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted_rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


@pytest.mark.parametrize("clustered", [True, False])
def test_topk_of_several_blocks(spark, monkeypatch, clustered):
    """Many blocks of rows, pages of envelopes and blocks of queries; equal vectors that fill whole blocks."""
    for name, value in (("BLOCK", 256 * 16), ("ASKING", 256 * 16), ("PAGE", 3), ("STEP", 5000)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (12, 16))
    m = centres[rng.integers(0, 12, 6000)] + rng.normal(0, 0.05, (6000, 16)) if clustered else rng.normal(0, 0.3, (6000, 16))
    m[2000:4000] = m[1]
    rows = [(i, x) for i, x in enumerate(m.tolist())]
    df = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 20)
    v = np.floor(64 * m).astype(np.int64)
    score = v[::10] @ v.T
    score[np.arange(600), np.arange(600) * 10] = -(1 << 60)
    best = np.lexsort((np.broadcast_to(np.arange(6000), score.shape), -score), axis=1)[:, :20]
    want = sorted((q * 10, n + 1, int(i), int(score[q, i])) for q in range(600) for n, i in enumerate(best[q]))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want


def test_envelopes_keep_queries_from_far_blocks(spark, monkeypatch):
    """Of clusters far apart, a query is sent to few blocks."""
    for name, value in (("BLOCK", 256 * 16), ("ASKING", 256 * 16)):
        monkeypatch.setattr(topk, name, value)
    met, searched = [], topk._searched
    monkeypatch.setattr(topk, "_searched", lambda meetings, *rest: met.append(meetings) or searched(meetings, *rest))
    rng = np.random.default_rng(8)
    m = rng.normal(0, 1, (16, 16))[rng.integers(0, 16, 6000)] + rng.normal(0, 0.02, (6000, 16))
    topk.top_k(spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 20).count()
    sent = sum(r.n for m in met for r in m.select(F.size("which").alias("n")).collect())
    assert 600 * topk.SEEDS <= sent < 600 * 23 / 2


def test_a_block_that_many_ask_for_is_met_by_several_tasks(spark, monkeypatch):
    """The join deals by block and salt, without a second exchange by the block alone, and finds the same."""
    for name, value in (("BLOCK", 256 * 16), ("ASKING", 256 * 2), ("ASKERS", 2)):
        monkeypatch.setattr(topk, name, value)
    plans, searched = [], topk._searched

    def seen(*args):
        out = searched(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(topk, "_searched", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = np.random.default_rng(9)
        m = np.floor(64 * rng.normal(0, 0.3, (1500, 16))).astype(np.int64)
        rows = [(i, (x / 64).tolist()) for i, x in enumerate(m)]
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 3).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    score = m[::5] @ m.T
    score[np.arange(300), np.arange(300) * 5] = -(1 << 60)
    best = np.lexsort((np.broadcast_to(np.arange(1500), score.shape), -score), axis=1)[:, :3]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted((q * 5, n + 1, int(i), int(score[q, i])) for q in range(300) for n, i in enumerate(best[q]))
    assert all("hashpartitioning(block#" in p and p.count("salt#") > 3 for p in plans)
    assert not any("hashpartitioning(block#" in line and "q_block" in line for p in plans for line in p.splitlines())


def test_topk_leaves_other_columns_alone(spark):
    """Columns with the names that the search uses inside."""
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0], "a", "b", "c", None) for i in range(30)], "vec_id long, embedding array<double>, id string, v string, block string, dim string")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 2, 1.0)
    assert sorted_rows(got, "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 14), (0, 2, 2, 14), (20, 1, 29, 594), (20, 2, 28, 574)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(20, 37)), rng.normal(size=(30, 37))
    for n in topk._levels(37):
        assert (topk._statistics(q, n) @ topk._statistics(x, n).T >= q @ x.T - 1e-9).all()


def test_topk_other_lengths_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [0.5, 0.5]), (20, [3.0])], "vec_id long, embedding array<double>")
    assert sorted_rows(topk.top_k(df, F.col("vec_id") % 20 == 0), "query_id", "rank", "vec_id", "score") == [(0, 1, 2, 64 * 32 + 128 * 32), (20, 1, 1, 192 * 64)]


# --- 4 --------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><h1>Title <b>one</b></h1><p>first   para<p>second &amp; third<br>line two<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td rowspan=2>pear<td>10<tr><td>20</table><div hidden>no</div><div style="display:none">no</div>after<pre>a
  b</pre><blockquote>q</blockquote><script>var t="</p>";</script>y</body>"""
TEXT = """Title one

first para

second & third
line two

- a
- b
  3. x
  4. y

Cap
Name      | Qty
apple pie | 3
pear      | 10
          | 20

after

a
  b

> q

y"""


def test_html_layout():
    assert html_text.render(PAGE) == TEXT


@pytest.mark.parametrize("page, text", [("", ""), ("<", "<"), ("a < b", "a < b"), ("<p", "<p"), ("<!-- x", ""), ("</p>a</div>", "a"), ("<td>alone", "alone"), ("<li>x", "- x"), ("<table></table>z", "z"), ("<textarea><b>", "<b>")])
def test_html_odd_pages(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("page, text", [
    ("<dialog open>hi</dialog><dialog>no</dialog>", "hi"), ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>!", "yes\n!"),
    ("<svg><title>t</title><text>drawn</text><desc>d</desc></svg>", "drawn"), ("<math><mi>x</mi><annotation>y</annotation></math>", "x"),
    ("<input type=email value=a@b><input type=checkbox value=1><input value=v>", "a@bv"), ("<div style='display:none'><b style='visibility:visible'>no</b></div>x", "x"),
    ("<p hidden>a<p>b", "b"), ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
])
def test_html_visibility(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("page, text", [
    ("<details>body<summary>head</summary>more<summary>second</summary><p>x</details>y", "head\ny"), ("<details open><summary>head</summary>body</details>", "head\nbody"),
    ("<details><details open>in</details></details>z", "z"), ("<details><div><summary>s</summary></div>x</details>", ""), ("<details><summary>a<details><summary>b</summary>c</details></summary>d</details>", "a\nb"),
    ("<ol><li>a<li value=9>b<li>c<li value=x>d</ol>", "1. a\n9. b\n10. c\n11. d"), ("<ol start=-1><li>a<li>b<li>c</ol>", "-1. a\n0. b\n1. c"), ("<ol reversed><li>a<li hidden>no<li>b</ol>", "2. a\n1. b"),
    ("<ol reversed start=7><li>a<li value=3>b<li>c</ol>", "7. a\n3. b\n2. c"), ("<ol><li>a<ol reversed><li>x<li>y</ol><li>b</ol>", "1. a\n   2. x\n   1. y\n2. b"), ("<ul><li value=4>a</ul>", "- a"),
])
def test_html_details_and_numbers(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("seed", range(8))
def test_html_tables_of_any_width_with_spans_and_lists(seed):
    """Against a plain layout: a grid that spans and lists take their places in, every column as wide as its widest line."""
    rng = random.Random(seed)
    for _ in range(20):
        n, m = rng.randint(1, 5), rng.randint(2, 4)
        free, grid, page = [[True] * m for _ in range(n)], [], "<table>"
        for r in range(n):
            page += "<tr>"
            grid.append([])
            for c in range(m):
                if not free[r][c]:
                    continue
                wide = rng.choice([1, 1, 1, 2]) if c + 1 < m and free[r][c + 1] else 1
                high = rng.choice([1, 1, 1, 2]) if r + 1 < n else 1
                for y in range(r, r + high):
                    for x in range(c, c + wide):
                        free[y][x] = False
                kind = rng.choice(["text", "list", "long", "none"])
                items = [rng.choice(["a", "bb", "ccc ccc"]) for _ in range(rng.randint(1, 3))]
                lines = {"text": [items[0]], "list": [f"{k}. {x}" for k, x in enumerate(items, 1)], "long": ["w" * rng.randint(61, 90)], "none": []}[kind]
                inner = {"text": items[0], "list": "<ol><li>" + "<li>".join(items) + "</ol>", "long": "".join(lines), "none": ""}[kind]
                page += f"<td colspan={wide} rowspan={high}>{inner}"
                grid[-1].append((c, wide, lines))
        widths = {c: max(len(x) for row in grid for at, wide, lines in row if at == c and wide == 1 for x in ["", *lines]) for c in {at for row in grid for at, wide, _ in row if wide == 1}}
        want = []
        for row in grid:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for c, _, lines in row:
                    if c:
                        line = line.ljust(sum(widths.get(x, -3) + 3 for x in range(c)) - 3) + " | "
                    line += lines[k] if k < len(lines) else ""
                want.append(line.rstrip(" "))
        assert html_text.render(page).split("\n") == ("\n".join(want).strip("\n") or "").split("\n")


def test_html_padding_stays_in_proportion():
    """One very long line widens the rows near it, not all."""
    page = "<table>" + "<tr><td>a<td>b" * 3000 + "<tr><td>" + "y" * 50_000 + "<td>z" + "<tr><td>a<td>b" * 3000 + "</table>"
    lines = html_text.render(page).split("\n")
    assert len(lines) == 6001 and sum(map(len, lines)) < 4 * len(page) and lines[0] == "a | b" == lines[-1]
    near = "<table><tr><td>" + "x" * 70 + "<td>b<tr><td>y<td>c</table>"
    assert html_text.render(near).split("\n") == ["x" * 70 + " | b", "y" + " " * 69 + " | c"]


def test_html_costs_grow_with_the_page():
    """Deep pages, wide spans and long cells."""
    import time

    began = time.perf_counter()
    assert html_text.render("<div>" * 200_000 + "x") == "x"
    assert html_text.render("<div>" * 50_000 + "<p>x</b>" * 50_000).count("x") == 50_000
    assert html_text.render("<table>" + "<tr><td rowspan=60000 colspan=1000>a<td>b" * 3_000 + "</table>").count("b") == 3_000
    wide = "<table><tr><td>" + "y" * 20_000 + "<td>z" + "<tr><td>a<td>b" * 2_000 + "</table>"
    assert len(html_text.render(wide)) < 3 * len(wide)
    assert time.perf_counter() - began < 20


def test_html_tables_keep_their_columns():
    """Against the plainest reading: cells in a grid, padded to the longest of their column."""
    rng = random.Random(6)
    for _ in range(50):
        grid = [[rng.choice(["", "a", "bb bb", "ccc", "dddddddd"]) for _ in range(4)] for _ in range(rng.randint(1, 6))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) + "</tr>" for row in grid) + "</table>"
        widths = [max(len(row[c]) for row in grid) for c in range(4)]
        want = [" | ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in grid if any(row)]
        assert [x for x in html_text.render(page).split("\n") if x.strip(" |")] == want


def test_html_deep_and_long():
    assert html_text.render("<div>" * 20000 + "x") == "x"
    assert html_text.render("<table><tr><td>" * 300 + "x").endswith("x")


def test_html_keeps_all_visible_words(spark):
    """Against the plainest reading: all text outside hidden elements."""
    pages = spark.read.parquet(f"{SMALLEST}/pages.parquet")
    import html as H

    for r, got in zip(pages.orderBy("page_id").collect(), html_text.extract(pages).orderBy("page_id").collect()):
        plain = re.sub(r"(?is)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", r.html or "")
        plain = H.unescape(re.sub(r"<[^>]+>", " ", plain)).split()
        have = [w for w in got.text.split() if w != "-"]
        assert "".join(have) == "".join(w for w in plain if w != "-")


# --- all ------------------------------------------------------------------------------------------------------


def test_html_leaves_other_columns_alone(spark):
    """Columns with the names that the extraction uses or returns."""
    rows = [(1, "<p>a<p>b", "x", None, "y"), (1, "<p>a<p>b", "x", None, "y"), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, url string, n_chars string")
    got = html_text.extract(pages)
    alone = html_text.extract(pages.select("page_id", "html"))
    assert got.columns == alone.columns and sorted(map(repr, got.collect())) == sorted(map(repr, alone.collect())) and got.count() == 3


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    held = split_of("doc_id", 3) == 1
    for got in (
        exact_dedup.assign(none), exact_dedup.drop_repeats(none), simhash.near_components(none), simhash.near_dedup(none), substring_dedup.assign(none),
        bpe.round_trip(none, PATH, public_tokenizers.PATTERN), mixing.assign(none), mixing.mix(none), toxicity.classify(none, labels, held), langid.predict(none, held),
        toxicity.drop_toxic(none, labels, held), substring_dedup.remove_repeats(none), html_text.extract(none, "doc_id", "text"), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0),
    ):
        assert got.collect() == []

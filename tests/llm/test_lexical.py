"""Lexical search against plain scoring of every document."""

import collections
import math
import re

import numpy as np
import pytest

from packetloom.llm import lexical
from packetloom.llm.common import table

from ..conftest import SMALLEST
from .conftest import words

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain_search(docs, items, k):
    """docs: (id, text). Returns (item_id, rank, score) and, where no other row ties at the end, ids."""
    counts = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + 25 * c.total() * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_items(spark, odd_rows):
    texts = [odd_rows[0][1][:400], None, "", "same same SAME end", "é ß 😀 x X", "wort", "no such term at all zzz", odd_rows[7][1][:2000], "...", "same same SAME end", "a" * 5000]
    return [(None if k == 5 else k % 9, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("k, docs", [(3, 2048), (20, 8)])
def test_search_of_odd_rows(spark, odd, odd_rows, odd_items, monkeypatch, k, docs):
    monkeypatch.setattr(lexical, "DOCS", docs)
    items = spark.createDataFrame(odd_items, "item_id int, text string")
    got = lexical.search(odd, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == sorted(plain_search([r[:2] for r in odd_rows], odd_items, k), key=repr)


def test_several_batches_and_shuffled_texts(spark, odd, odd_rows, odd_items, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 4)
    monkeypatch.setattr(lexical, "FEW", 1)
    items = spark.createDataFrame(odd_items, "item_id int, text string")
    assert found(lexical.search(odd, items, 2)) == sorted(plain_search([r[:2] for r in odd_rows], odd_items, 2), key=repr)


def test_search_of_given_rows(spark):
    docs, items = table(spark, SMALLEST, "documents"), table(spark, SMALLEST, "benchmark")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 20)
    index = lexical.build_index(docs)
    assert found(lexical.search(docs, items, 20, index)) == sorted(want, key=repr)


def test_bounds_hold_and_are_near():
    import random

    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 400)) for _ in range(300)]
    batch = lexical.Batch([(i, words(rng, 30)) for i in range(20)] + [(99, texts[5])])
    counts = [lexical.counts_of(t) for t in texts]
    df = {k: n for t, k in batch.term.items() if (n := sum(t in c for c in counts))}
    batch.weigh(df, len(texts), sum(c.total() for c in counts))
    docs, known = [], lexical.Hashes()
    for i, c in enumerate(counts):
        h, tf = np.array([known[t] for t in c], np.uint64), np.array(list(c.values()))
        docs.append((i, i, i, int(tf.sum()), np.concatenate([lexical.marks(h[tf >= x], k) for k, x in enumerate(lexical.LEVELS) if x <= tf.max()])))
    width = lexical._width(max(len(d[4]) for d in docs))
    block = lexical._block(width, docs)
    bits = np.frombuffer(block["bits"], np.uint8).reshape(width, -1)
    m = batch.length(block["n"])
    upper = lexical.bounds(batch, width, bits, m)
    exact = np.zeros_like(upper)
    for q, (at, weight) in enumerate(batch.of):
        terms = list(batch.term)
        for d, c in enumerate(counts):
            exact[q, d] = sum(int(w) * lexical.factor(c[terms[t]], int(m[d])) for t, w in zip(at, weight) if c[terms[t]])
    assert (upper >= exact).all() and upper.sum() < 1.1 * exact.sum()


def test_most_documents_are_excluded(spark, monkeypatch):
    """Of items whose words few documents have, what is scored exactly doesn't grow with the rest."""
    import random

    rng = random.Random(4)
    docs = [(i, words(rng, 60)) for i in range(3000)]
    items = [(q, " ".join(docs[q * 100][1].split()[5:45])) for q in range(10)]
    asked = []
    real = lexical._exact
    monkeypatch.setattr(lexical, "_exact", lambda found, *a: (asked.append(found.count()), real(found, *a))[1])
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = found(lexical.search(d, spark.createDataFrame(items, "item_id long, text string"), 5))
    assert got == sorted(plain_search(docs, items, 5), key=repr)
    assert asked[0] == 100 and asked[1] < 10 * 3000 / 20


def test_empty_tables(spark, none, odd):
    items = spark.createDataFrame([], "item_id long, text string")
    assert found(lexical.search(odd, items)) == []
    assert found(lexical.search(none, spark.createDataFrame([(1, "wort")], items.schema))) == []

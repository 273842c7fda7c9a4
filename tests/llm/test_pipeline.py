"""The stages in order, each on what the one before kept: planted cases, all pairs of texts, the mix that assign() plans, and tiktoken."""

import collections
import hashlib
import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import bpe, mixing, simhash
from packetloom.llm.common import cut, split_of

from ..conftest import SMALLEST


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    first = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 9000)  # planted copies
    labels = spark.read.parquet(f"{SMALLEST}/labels.parquet").filter("toxic = 1")
    insult = docs.join(labels.filter(split_of("doc_id", 3) != 1).select("doc_id"), "doc_id", "left_semi").limit(3).withColumn("doc_id", F.col("doc_id") + 9500)
    insult = cut(insult.withColumn("text", F.concat_ws(" ", "text", "text")))  # more of what was toxic
    insults = {r.doc_id for r in insult.collect()}
    docs = docs.unionByName(first).unionByName(insult)
    columns = docs.columns
    (_, toxic), (_, copies), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    a = cut(toxic(spark, docs, SMALLEST))
    kept = {r.doc_id for r in a.collect()}
    assert a.columns == columns and insults and not kept & insults and len(kept) > 0.7 * docs.count()
    b = cut(copies(spark, a, SMALLEST))
    norm = lambda rows: {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows}
    rows = b.collect()
    assert b.columns == columns and norm(rows) == norm(a.collect()) and len(norm(rows)) == len(rows)
    c = cut(near(spark, b, SMALLEST))
    ids = {r.doc_id for r in c.collect()}
    assert c.columns == columns and ids <= {r.doc_id for r in rows} and len(ids) == c.count()
    shingles = {r.doc_id: set(simhash._grams((r.text or "").encode(), 5)) for r in rows}
    for i in shingles:
        close = [j for j in shingles if j != i and shingles[i] | shingles[j] and len(shingles[i] & shingles[j]) >= 0.9 * len(shingles[i] | shingles[j])]
        if i not in ids:
            assert any(len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in shingles if j != i)
        else:
            assert not any(j in ids for j in close)
    d = cut(mix(spark, c, SMALLEST))
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.assign(c).filter("taken > 0").collect()}
    assert d.columns == columns and collections.Counter(r.doc_id for r in d.collect()) == taken
    e = encode(spark, d, SMALLEST)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = collections.Counter((r.doc_id, hashlib.sha256(" ".join(map(str, own.encode_ordinary(r.text or ""))).encode()).hexdigest()) for r in d.collect())
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in e.collect()) == want


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALLEST).count() > 0


def test_stages_of_no_rows(spark):
    """Each stage of an empty table gives one with the same columns, the last one the encoder's."""
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SMALLEST)
        assert got.collect() == [] and (got.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0])


def test_stages_of_odd_rows(spark, odd):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with names that stages use inside."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = cut(stage(spark, docs, SMALLEST))
        assert got.columns == docs.columns and {r.doc_id for r in got.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = got
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALLEST).count() == docs.count() > 0

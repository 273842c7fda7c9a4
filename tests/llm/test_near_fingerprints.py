"""The pipeline's near dedup goes through the fingerprints of its operator; they are enough where keys of minima find nothing."""

import random

from packetloom.llm import simhash

import corpus_pipeline


def test_fingerprints_propose_near_pairs(spark, monkeypatch):
    draw = random.Random(5)
    texts = {i: [f"w{draw.randrange(100_000)}" for _ in range(600)] for i in range(1, 30)}
    near = {}
    for i in range(1, 30):  # copies with a changed last word whose fingerprints are within the bits
        copy = " ".join([*texts[i][:-1], "other"])
        if (simhash.fingerprint(" ".join(texts[i]).encode(), 3) ^ simhash.fingerprint(copy.encode(), 3)).bit_count() <= 3:
            near[100 + i] = copy
    assert len(near) > 10
    monkeypatch.setattr(simhash, "_first_pairs", lambda similarity: lambda batches: iter(()))
    docs = spark.createDataFrame([*((i, " ".join(t)) for i, t in texts.items()), *near.items(), (500, ""), (501, None)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [*range(1, 30), 500]

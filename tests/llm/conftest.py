import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("fp", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("size", T.StringType()), T.StructField("pattern", T.StringType()),
    T.StructField("h", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("id", T.StringType()), T.StructField("starts", T.StringType()),
])


def words(rng, n, stems=("the", "of", "ation", "er", "ing", "ble", "th", "on", "ea", "st")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank and very long texts, copies, near copies, shared passages, repeated rows and ids."""
    rng = random.Random(5)
    passage = words(rng, 70)
    base = words(rng, 300)
    near = base.split()
    near[150] = "changed"
    texts = {
        0: base, 1: base, 2: base + " ", 3: " ".join(near), 4: None, 5: "", 6: " \t\n", 7: words(rng, 60000), 8: passage, 9: words(rng, 30) + " " + passage + " " + words(rng, 30),
        10: passage + "\n" + words(rng, 20), 11: "x", 12: "X", 13: "é ß 😀", 14: words(rng, 49), 15: words(rng, 50), 16: "same " * 400, 17: "same " * 400 + "end",
        20: words(rng, 120), 21: words(rng, 90), 22: "wort " * 3, 23: "a" * 5000,
    }
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], len(t or "")) for i, t in texts.items()]
    rows += [(20, texts[20], "en", "a", None), (20, texts[20], "en", "a", None), (None, passage, "en", None, None), (None, None, None, None, None)]
    return [(*r, "x", None, "y", "z", None, "k", "i", "s") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)

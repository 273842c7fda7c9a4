"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to four characters of the lower-cased text are hashed into WIDTH columns; a text's vector is log(1 + count)
times the inverse document frequency, scaled to length one. Document frequencies count all training rows. The weights are
trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample: `sample_rows` rows shared evenly
by the languages (at least 50 a language), in the order of a hash of the id. A part of the sample is held back from
training, and the temperature that divides the logits is set on it. Predictions read whole texts, and nothing else.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .common import body, few_of_each

WIDTH, ORDERS, CHUNK = 1 << 15, 4, 1 << 19
ASCII_LETTER = re.compile("[A-Za-z]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    """Numbers that Unicode counts as word characters, such as ½ or Ⅳ, are no letters."""
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each column occurs in a text, which is read in chunks that overlap by ORDERS - 1 characters."""
    text = text.lower()
    out = np.zeros(WIDTH, np.int64)
    for at in range(0, max(1, len(text)), CHUNK):
        a = np.frombuffer(text[at : at + CHUNK + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        own, h = min(CHUNK, len(a)), np.zeros(len(a), np.uint64)
        for n in range(1, ORDERS + 1):
            if len(a) < n:
                break
            h = (h[: len(a) - n + 1] + a[n - 1 :]) * _MIX
            h ^= h >> np.uint64(29)
            out += np.bincount((h[:own] * _MIX >> np.uint64(49)).astype(np.int64), minlength=WIDTH)
    return out


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = counts(text)
    at = np.flatnonzero(c)
    x = np.log1p(c[at]) * idf[at]
    return at, x / max(1e-12, float(np.sqrt(x @ x)))


def _document_counts(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and rows with each column. A task sums its own rows; WIDTH + 1 sums reach the driver."""

    def run(batches):
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total += counts(t.as_py()) > 0
                n += 1
        at = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total[at[:-1]], n))], ["at", "n"])

    got = {r["at"]: r["n"] for r in texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    out = np.zeros(WIDTH)
    for k, v in got.items():
        if k >= 0:
            out[k] = v
    return got.get(-1, 0), out


def fit(
    docs: DataFrame, held_out: Column, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = 1000
) -> dict | None:
    """None if no row teaches anything. The weights, WIDTH numbers a language, are on the driver and in every task, so more than
    max_languages are refused."""
    teaching = docs.filter(~held_out & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    names = sorted(r[0] for r in teaching.select(lang_col).distinct().limit(max_languages + 1).collect())
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if driver and tasks have the memory")
    if not names:
        return None
    each = max(50, sample_rows // len(names))
    keys = teaching.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    chosen = few_of_each(keys, "id", "lang", each, max_languages).withColumn("h", F.xxhash64("id"))
    n, df = _document_counts(teaching.select(body(text_col).alias("text")))
    idf = np.log((n + 1) / (df + 1)) + 0.1
    held = docs.sparkSession.sparkContext.broadcast(idf)

    @F.arrow_udf("struct<at: binary, x: binary>")
    def vectors(texts: pa.Array) -> pa.Array:
        both = [_vector(t.as_py(), held.value) for t in texts]
        columns = [pa.array([v.astype(kind).tobytes() for v in col], pa.binary()) for col, kind in zip(zip(*both), (np.int32, np.float32))] if both else [pa.array([], pa.binary())] * 2
        return pa.StructArray.from_arrays(columns, ["at", "x"])

    taught = teaching.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), body(text_col).alias("text")).join(F.broadcast(chosen), ["id", "lang"])
    rows = taught.filter("text <> ''").select("h", "id", "lang", vectors("text").alias("v")).select("h", "id", "lang", "v.*").collect()
    rows.sort(key=lambda r: (r.h, r.id, r.lang, r.at))
    number = {s: i for i, s in enumerate(names)}
    x = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32).astype(np.float64)) for r in rows]
    y = np.array([number[r.lang] for r in rows], np.int64)
    aside = np.array([r.h % 5 == 0 for r in rows], bool)
    use = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(rows))
    weights, bias = ftrl.fit([x[i] for i in use], np.eye(len(names))[y[use]], WIDTH, l1=0.02, l2=0.01, epochs=3, alpha=1.0)
    check = np.flatnonzero(aside)
    logits = np.array([v @ weights[at] + bias for at, v in (x[i] for i in check)]).reshape(len(check), len(names))
    return {"names": names, "idf": idf, "weights": weights, "bias": bias, "temperature": ftrl.temperature(logits, y[check])}


def predict(docs: DataFrame, held_out: Column, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each of docs: id_col, held_out, lang_pred, score (its probability, 0 to 1). held_out: from the id column,
    true for rows that must not be learned from. Texts that are null or have no letter get und with score 0, and so do all if
    nothing could be learned; rows may repeat; other columns are not read."""
    model = fit(docs, held_out, sample_rows, id_col, text_col, lang_col)
    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return docs.select(F.col(id_col), held_out.alias("held_out"), und.alias("p")).select(id_col, "held_out", "p.*")
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def guess(texts: pa.Array) -> pa.Array:
        m = held.value
        names, score = [], []
        for t in texts:
            text = t.as_py()
            if text is None or not has_letter(text):
                names.append("und")
                score.append(0.0)
                continue
            at, x = _vector(text, m["idf"])
            p = ftrl.softmax((x @ m["weights"][at] + m["bias"]) / m["temperature"])
            names.append(m["names"][int(p.argmax())])
            score.append(float(p.max()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return docs.select(F.col(id_col), held_out.alias("held_out"), guess(F.col(text_col)).alias("p")).select(id_col, "held_out", "p.*")

"""Toxicity by weak supervision.

Voters are lexicons, patterns and signals of form: fixed lists of insults by language; fixed patterns; and some
thirty lexicons mined from the labelled training rows: words, and word beginnings of four, five and six letters as patterns, that
between them speak up in the toxic rows and hardly in the clean ones. The rows are halved, and each half is voted on by the lexicons
that were mined from the other, so no voter has seen the label of a row that it votes on.

A generative label model looks at votes alone. A row is of one of a few kinds, such as clean, or toxic in one language; each voter speaks
up with a probability of its own in each kind. Where two voters agree more, or less, than the kinds explain, their dependence is a
parameter too: the strongest dependences form a forest, in which a voter's probability depends on the kind and on one
other voter. The given label is one more voter, whose error rates are estimated like those of the others: where lexicons speak up
against it, they can overrule it, and where none speaks up, it is what there is. Expectation maximisation estimates the
probabilities, the forest and the kinds of the rows; a kind is toxic to the extent to which its labels say so. The posterior labels that
follow train a sparse linear classifier on words and word beginnings, which scores whole texts.

The model is fitted on a bounded sample: at most `rows_per_class` labelled rows of each class, taken in the order of a
hash of the id. Scoring reads every row and whole text. Labels other than those of training rows are never read, and
labels, lang, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .common import body, few_of_each

#: Lexicons of insults.
LEXICONS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash clown pathetic worthless disgusting filthy vermin jerk bastard bitch asshole fool imbecile",
    "de": "idiot idioten dumm dummkopf trottel abschaum arschloch widerlich wertlos erbärmlich versager ekelhaft hurensohn schwachkopf",
    "fr": "idiot idiote imbécile crétin connard salope ordure minable dégoûtant stupide abruti pathétique raclure débile",
    "es": "idiota imbécil estúpido estúpida tonto basura escoria patético asqueroso inútil cabrón gilipollas payaso perdedor",
}
#: Patterns on the whole text, in lower case.
PATTERNS = [
    r"\byou(?: are|'re)? (?:an? |such an? |all )?(?:\w+ )?(?:idiot|moron|loser|clown|scum|trash)",
    r"\b(?:shut up|go to hell|drop dead|kill yourself)\b",
]
#: Patterns of form on the whole text as it is: shouting, exclamation, masked and stretched words.
FORMS = [r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b", r"!!", r"!\s*$", r"\w[*#@]{2,}\w?", r"(\w)\1{3,}", r"\?!"]
BEGINNINGS = (4, 5, 6)
#: Lexicons into which the mined features are dealt.
DEALT = 32
L1_SHARE = 0.0015
REJECT = 0.7
WORDS = re.compile(r"[^\W\d_]+")
CACHE = 300_000


def _features_of(word: str) -> list[int]:
    """32-bit hashes of the word, and of its beginnings with their length."""
    digest = xxhash.xxh32_intdigest
    return [digest(word.encode())] + [digest(word[:k].encode(), k) for k in BEGINNINGS if len(word) > k]


def _sample(labels: DataFrame, held_out: Column, rows_per_class: int, id_col: str, label_col: str) -> DataFrame:
    """id, label: at most rows_per_class ids of either class. A document with several labels is toxic if one says so."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("label"))
    return few_of_each(known, "id", "label", rows_per_class)


def _read(chosen: DataFrame, docs: DataFrame, id_col: str, text_col: str):
    """Of the sample: labels, features as arrays, and which fixed voters speak up. Texts stay on the executors."""
    lexicons = [frozenset(x.split()) for x in LEXICONS.values()]
    patterns, forms = [re.compile(p) for p in PATTERNS], [re.compile(p, re.S) for p in FORMS]

    @F.arrow_udf("struct<features: binary, votes: binary>")
    def look(texts: pa.Array) -> pa.Array:
        features, votes = [], []
        for t in texts:
            text = t.as_py()
            low = text.lower()
            words = set(WORDS.findall(low))
            features.append(np.unique(np.fromiter(chain.from_iterable(map(_features_of, words)), np.uint32)).tobytes())
            votes.append(bytes([*(not words.isdisjoint(x) for x in lexicons), *(bool(p.search(low)) for p in patterns), *(bool(p.search(text)) for p in forms)]))
        return pa.StructArray.from_arrays([pa.array(features, pa.binary()), pa.array(votes, pa.binary())], ["features", "votes"])

    texts = docs.select(F.col(id_col).alias("id"), body(text_col).alias("text")).join(F.broadcast(chosen), "id")  # twice rows_per_class at most
    rows = texts.select("id", "label", look("text").alias("x")).select("id", "label", "x.*").collect()
    rows.sort(key=lambda r: (r.id, r.features))
    return (
        np.array([r.label for r in rows], np.int64),
        [np.frombuffer(r.features, np.uint32) for r in rows],
        np.array([list(r.votes) for r in rows], bool).reshape(len(rows), len(lexicons) + len(patterns) + len(forms)),
    )


def _mine(truth: np.ndarray, features: list[np.ndarray], most: int = 400, dear: float = 4.0) -> list[np.ndarray]:
    """Lexicons of features, picked one after the other: that which speaks up in the most toxic rows in which none speaks up
    yet, less `dear` for every clean row in which it does. Words that merely come with a topic or language add no row."""
    names, code = np.unique(np.concatenate(features), return_inverse=True)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cost = dear * np.bincount(code, truth[row] == 0, len(names))
    gain = np.bincount(code, truth[row], len(names)) - cost
    by_code = np.argsort(code, kind="stable")
    first = np.searchsorted(code[by_code], np.arange(len(names) + 1))
    ends = np.cumsum([len(f) for f in features])
    open_, picked, least = truth.astype(bool), [], max(2.0, 0.002 * truth.sum())
    while len(picked) < most and gain[best := int(gain.argmax())] >= least:
        picked.append(best)
        rows = np.unique(row[by_code[first[best] : first[best + 1]]])
        for r in rows[open_[rows]]:
            gain[code[ends[r] - len(features[r]) : ends[r]]] -= 1
        open_[rows] = False
        gain[best] = -np.inf
    return [names[picked[k::DEALT]] for k in range(DEALT) if picked[k::DEALT]]


def _votes(truth: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """rows by DEALT: which mined lexicons speak up in a row, all mined from the half of the rows that it isn't in."""
    out = np.zeros((len(features), DEALT), bool)
    for half in (0, 1):
        taught = [i for i in range(len(features)) if i % 2 != half]
        if len(set(truth[taught].tolist())) < 2 or not sum(len(features[i]) for i in taught):
            continue
        for k, lexicon in enumerate(np.sort(x) for x in _mine(truth[taught], [features[i] for i in taught])):
            for i in range(half, len(features), 2):
                out[i, k] = np.isin(features[i], lexicon, assume_unique=True).any()
    return out


#: Rows that a rate starts from. A given label starts from so many rows in which it is right so often; what the data say outweighs that.
PRIOR, LABELLED, RIGHT = 0.5, 40.0, 0.99


def _joint(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """P(a = x, b = y) of all pairs of voters under the weights w of the rows: voters, voters, 2, 2."""
    both, one, n = (v * w[:, None]).T @ v, w @ v, w.sum()
    cells = np.stack([n - one[:, None] - one[None, :] + both, one[None, :] - both, one[:, None] - both, both], axis=-1).reshape(*both.shape, 2, 2)
    return (np.maximum(cells, 0) + PRIOR / 4) / (n + PRIOR)


def _forest(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """p: rows by kinds. The other voter that each one depends on, -1 for none: a spanning forest of the greatest mutual information
    within the kinds, of that which pays for its parameters."""
    info = np.zeros((v.shape[1], v.shape[1]))
    for w in p.T:
        q = _joint(v, w)
        a, b = q.sum(axis=3, keepdims=True), q.sum(axis=2, keepdims=True)
        info += w.sum() * (q * np.log(q / (a * b))).sum(axis=(2, 3))
    np.fill_diagonal(info, 0)
    parent, inside = np.full(len(info), -1), np.zeros(len(info), bool)
    while not inside.all():
        gain = np.where(inside[:, None] & ~inside[None, :], info, -1)
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] > p.shape[1] * np.log(len(v)):
            parent[j] = i
        else:  # a new tree
            j = int(np.flatnonzero(~inside)[0])
        inside[j] = True
    return parent


def _likelihood(v: np.ndarray, parent: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """log P(votes of a row | kind), rows by kinds, of tables (kind, voter, vote of the one it depends on, vote)."""
    said = v.astype(int)
    other = np.where(parent >= 0, said[:, parent], 0)
    return np.log(tables[:, np.arange(v.shape[1])[None, :], other, said]).sum(axis=2).T


def _first_kinds(v: np.ndarray, most: int) -> np.ndarray:
    """A kind for each row to begin with: the voter that speaks up in the most rows has one, of the other rows again, and so on;
    the last is that of rows which no such voter speaks up in."""
    kind, k = np.full(len(v), -1), 0
    while k < most - 1 and (counts := v[kind < 0].sum(axis=0)).max(initial=0) >= max(3, 0.005 * len(v)):
        kind[(kind < 0) & (v[:, int(counts.argmax())] > 0)] = k
        k += 1
    kind[kind < 0] = k
    return kind


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 40, kinds: int = 8, start: np.ndarray | None = None) -> dict:
    """votes: rows by voters, who speak up or don't. labels: what the rows are said to be, the last voter. start: the voters whose rows are
    the kinds to begin with, all by default; rows that none of them speaks up in are two kinds, by their label.

    posterior: P(toxic) of each row. kinds: rows by kinds. toxic: the toxic share of each kind. rates (class, voter): P(speaks up). parent: the
    voter that each one depends on, or -1. tables (kind, voter, vote of that one, vote). correlations: of all pairs of votes, within the kinds."""
    labels = np.asarray(labels, np.float64)
    first = _first_kinds(votes if start is None else votes[:, start], kinds - 1)
    first[(first == first.max()) & (labels > 0)] += 1
    v = np.concatenate([votes, labels[:, None]], axis=1).astype(np.float64)
    p = np.full((len(v), first.max() + 1), 0.05 / (first.max() + 1))
    p[np.arange(len(v)), first] += 0.95
    parent = np.full(v.shape[1], -1)
    believed = np.tile((v.sum(axis=0) + PRIOR / 2) / (len(v) + PRIOR), (p.shape[1], 1))
    believed[:, -1] = np.where(labels @ p > 0.5 * p.sum(axis=0), RIGHT, 1 - RIGHT)
    weight = np.append(np.full(v.shape[1] - 1, PRIOR), LABELLED)
    for n in range(rounds):
        if n and n % 10 == 5:
            parent = _forest(v, p)
        share = (p.sum(axis=0) + 1) / (len(v) + p.shape[1])
        tables = np.empty((p.shape[1], v.shape[1], 2, 2))
        for y, w in enumerate(p.T):
            one = (w @ v + weight * believed[y]) / (w.sum() + weight)
            tables[y] = np.stack([1 - one, one], axis=1)[:, None, :]
            for j in np.flatnonzero(parent >= 0):
                for x in (0, 1):
                    own = w * (v[:, parent[j]] == x)
                    speaks = (own @ v[:, j] + PRIOR * one[j]) / (own.sum() + PRIOR)
                    tables[y, j, x] = 1 - speaks, speaks
        tables = np.clip(tables, 1e-6, 1)
        new = ftrl.softmax(np.log(share) + _likelihood(v, parent, tables))
        still = np.abs(new - p).max() < 1e-4
        p = new
        if still and n > 5:
            break
    toxic = (labels @ p + labels.mean() * PRIOR) / (p.sum(axis=0) + PRIOR)
    posterior = p @ toxic
    sharp = posterior**2 / (posterior**2 + (1 - posterior) ** 2)
    rates = np.stack([(w @ v + PRIOR / 2) / (w.sum() + PRIOR) for w in (1 - sharp, sharp)])
    left = v - p @ np.stack([w @ v / max(1e-9, w.sum()) for w in p.T])
    dev = np.sqrt(np.maximum((left * left).mean(axis=0), 1e-9))
    return {
        "posterior": posterior, "kinds": p, "toxic": toxic, "share": share, "rates": rates, "parent": parent, "tables": tables,
        "correlations": left.T @ left / max(1, len(v)) / np.outer(dev, dev),
    }


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, rows_per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The classifier: bias, and the weights of features that are not zero. Without labels of both classes it has no weights,
    and all texts get the score 0."""
    truth, features, fixed = _read(_sample(labels, held_out, rows_per_class, id_col, label_col), docs, id_col, text_col)
    if len(set(truth.tolist())) < 2 or not sum(map(len, features)):
        return {"bias": None, "weights": {}}
    mined = _votes(truth, features)
    votes = np.concatenate([fixed, mined], axis=1)
    told = votes.any(axis=0) & ~votes.all(axis=0)
    votes, is_mined = votes[:, told], (np.arange(votes.shape[1]) >= fixed.shape[1])[told]
    posterior = label_model(votes, truth, start=np.flatnonzero(is_mined))["posterior"] if votes.size else truth.astype(float)
    posterior = (posterior > 0.5).astype(np.float64)  # the likelier label: the classifier's penalties shrink scores enough
    names, code, rows_with = np.unique(np.concatenate(features), return_inverse=True, return_counts=True)
    column = np.where(rows_with >= 3, np.cumsum(rows_with >= 3) - 1, -1)  # rarer ones get no weight
    ends = np.cumsum([len(f) for f in features])
    rows = [(c[c >= 0], np.ones((c >= 0).sum())) for c in (column[code[e - len(f) : e]] for e, f in zip(ends, features))]
    names = names[rows_with >= 3]
    toxic = posterior.sum()
    rarer = posterior > 0.5 if 2 * toxic < len(rows) else posterior <= 0.5  # the rarer class is shown more often, to balance
    times = np.where(rarer, max(1, round((len(rows) - rarer.sum()) / max(1, rarer.sum()))), 1)
    l1 = max(1.0, L1_SHARE * (posterior * times).sum())
    weights, bias = ftrl.fit(rows, np.stack([1 - posterior, posterior], axis=1), len(names), l1=l1, l2=0.01, epochs=12, alpha=0.5, times=times)
    slope = weights[:, 1] - weights[:, 0]
    used = np.flatnonzero(np.abs(slope) > 1e-9)
    return {"bias": float(bias[1] - bias[0]), "weights": dict(zip(names[used].tolist(), slope[used].tolist()))}


_known: dict[int, dict[str, tuple[int, ...]]] = {}


def score_column(model: dict, docs: DataFrame, text_col: str = "text") -> Column:
    """P(toxic) of whole texts; null counts as an empty text."""
    if model["bias"] is None:
        return F.lit(0.0)
    held = docs.sparkSession.sparkContext.broadcast(model)  # as many weights as the sample has features, at most
    mark = hash((model["bias"], len(model["weights"])))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, bias = held.value["weights"], held.value["bias"]
        if mark not in _known:
            _known.clear()
        known = _known.setdefault(mark, {})
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            words = set(WORDS.findall(t.as_py().lower()))
            if new := [w for w in words if w not in known]:
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = list(words)
                known.update((w, tuple(f for f in _features_of(w) if f in weights)) for w in new)
            active = set(chain.from_iterable(map(known.__getitem__, words)))
            out[i] = bias + sum(weights[f] for f in sorted(active))
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score(body(text_col))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, rows_per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each of docs: id_col, held_out, score (0 to 1), predicted (1 from a score of 0.7). held_out: from the id
    column, true for rows whose labels must not be learned from. Null and empty texts are scored like texts without
    features; rows may repeat; other columns are not read."""
    model = fit(docs, labels, held_out, rows_per_class, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col), held_out.alias("held_out"), score_column(model, docs, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, rows_per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without those that classify() would predict as toxic; columns as they are. Null and empty texts stay, unless texts without
    words are toxic by the labels; rows that repeat go or stay together; no rows give none."""
    model = fit(docs, labels, held_out, rows_per_class, id_col, text_col, label_col)
    return docs.filter(score_column(model, docs, text_col) < REJECT)

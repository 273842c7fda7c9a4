"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources; its membership pattern is the set of them. Documents are summed by
pattern, a table whose size depends on the sources and not on the documents. On it a min-cost flow routes words
from patterns to source quotas: a pattern gives its words once at a low cost, a second and a third time at rising
(convex) costs, so repetition is spread before it is stacked. What a pattern must give fixes whole repeats of all
its documents and a remainder, and the remainder is filled by documents in the order of a seeded hash: a histogram
of the hash finds, in three passes over small rows, the hash below which the words just fit, and then the largest
documents that fit in what is left, a few a pattern, close the gap. The choice depends on ids, texts and seed alone.

Weights: sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the total of all sizes; no
target is above `max_repeats` times its source's size, and what that cuts off is shared anew by weight.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, body, cut, fresh

#: The hash has LEVELS times STEP bits.
STEP, LEVELS, FILLS = 12, 3, 4


def n_words(text_col: str) -> Column:
    return F.regexp_count(body(text_col), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], cycle: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> dict[str | None, float]:
    """Words to take of each source, from its size."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    out, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > max_repeats * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(max_repeats * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], max_repeats: int = 3) -> dict[tuple, int]:
    """Words to take of each pattern: a min-cost flow, by successive cheapest paths, pattern by pattern group that shares sources."""
    taken = dict.fromkeys(patterns, 0)
    by_source: dict[str | None, list[tuple]] = {}
    for p in patterns:
        for s in p:
            by_source.setdefault(s, []).append(p)
    seen: set[tuple] = set()
    for p in patterns:
        if p in seen:
            continue
        group, queue = [], deque([p])
        seen.add(p)
        while queue:
            group.append(q := queue.popleft())
            for s in q:
                for r in by_source[s]:
                    if r not in seen:
                        seen.add(r)
                        queue.append(r)
        taken |= _flow(group, {q: patterns[q] for q in group}, {s: quotas[s] for q in group for s in q}, max_repeats)
    return taken


def _flow(group, size, quota, repeats) -> dict[tuple, int]:
    nodes = {("p", p): i for i, p in enumerate(group, 2)} | {("s", s): i for i, s in enumerate(quota, 2 + len(group))}
    to, room, cost, at = [], [], [], [[] for _ in range(2 + len(nodes))]

    def arc(a, b, r, c):
        for x, y, rr, cc in ((a, b, r, c), (b, a, 0, -c)):
            at[x].append(len(to))
            to.append(y)
            room.append(rr)
            cost.append(cc)

    for p in group:
        for k in range(repeats):
            arc(0, nodes["p", p], size[p], 2 * k + 1)
        for s in p:
            arc(nodes["p", p], nodes["s", s], repeats * size[p], 0)
    for s, q in quota.items():
        arc(nodes["s", s], 1, q, 0)
    while True:
        best, via, queue, inside = {0: 0}, {}, deque([0]), {0}
        while queue:
            u = queue.popleft()
            inside.discard(u)
            for e in at[u]:
                if room[e] > 0 and best[u] + cost[e] < best.get(to[e], 1 << 60):
                    best[to[e]], via[to[e]] = best[u] + cost[e], e
                    if to[e] not in inside:
                        inside.add(to[e])
                        queue.append(to[e])
        if 1 not in best:
            return {p: sum(room[e] for e in at[nodes["p", p]] if to[e] == 0) for p in group}  # what can flow back has flown
        path, v = [], 1
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step


def _pattern(df: DataFrame, source_col: str) -> Column:
    """The sources of a row, without repeats and in order, as JSON; null and empty lists are the source null."""
    c = F.col(source_col)
    kind = df.schema[source_col].dataType.typeName()
    if kind == "array":
        c = F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c.cast("array<string>")))).otherwise(F.array(F.lit(None).cast("string")))
        c = F.coalesce(c, F.array(F.lit(None).cast("string")))
    else:
        c = F.array(c.cast("string"))
    return F.to_json(c)


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    """STEP * LEVELS bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.xxhash64(body(text_col)), F.lit(seed)), 64 - STEP * LEVELS)


def _decide(known: DataFrame, max_repeats: int, max_patterns: int) -> DataFrame:
    """known: pattern, size, h. Returns one row for each pattern: pattern, source_size, target, repeats, below, picks."""
    spark = known.sparkSession
    summed = known.groupBy("pattern").agg(F.sum("size").alias("size"))
    rows = summed.limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns: the flow is solved on the driver; raise max_patterns if it has the memory")
    size = {r.pattern: r["size"] for r in rows}
    sources: dict[str | None, int] = {}
    for p, n in size.items():
        for s in json.loads(p):
            sources[s] = sources.get(s, 0) + n
    want = targets(sources, max_repeats=max_repeats)
    quotas = {s: round(t) for s, t in want.items()}
    taken = route({tuple(json.loads(p)): n for p, n in size.items()}, quotas, max_repeats)
    state = {}
    for p, n in size.items():
        give = taken[tuple(json.loads(p))]
        whole = min(give // n, max_repeats) if n else 0
        state[p] = {"repeats": whole, "left": give - whole * n, "below": 0, "picks": []}
    schema = "pattern string, below long, left long, picks array<long>"
    frame = lambda: F.broadcast(spark.createDataFrame([(p, s["below"], s["left"], s["picks"]) for p, s in state.items() if s["left"] > 0], schema))
    for level in range(LEVELS):  # at most max_patterns * 2 ** STEP sums a pass
        if not any(s["left"] > 0 for s in state.values()):
            break
        shift = STEP * (LEVELS - 1 - level)
        inside = known.join(frame(), "pattern").filter(F.shiftright("h", shift + STEP) == F.shiftright("below", shift + STEP))
        sums = inside.groupBy("pattern", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        running = sums.withColumn("upto", F.expr("sum(n) over (partition by pattern order by bucket)"))
        stops = running.filter("upto > left").groupBy("pattern").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
        for r in stops.collect():
            state[r.pattern]["below"] = r.b.bucket << shift
            state[r.pattern]["left"] -= r.b.before
    for _ in range(FILLS):
        if not any(s["left"] > 0 for s in state.values()):
            break
        fits = known.join(frame(), "pattern").filter("h >= below and size > 0 and size <= left and not array_contains(picks, h)")
        found = fits.groupBy("pattern").agg(F.max(F.struct("size", "h")).alias("b")).collect()
        for r in found:
            state[r.pattern]["picks"].append(r.b.h)
            state[r.pattern]["left"] -= r.b["size"]
        if not found:
            break
    plan = [
        (p, sum(sources[x] for x in json.loads(p)), float(sum(want[x] for x in json.loads(p))), s["repeats"], s["below"], s["picks"]) for p, s in state.items()
    ]
    return F.broadcast(spark.createDataFrame(plan, "pattern string, source_size long, target double, repeats int, below long, picks array<long>"))


def _times() -> Column:
    return F.col("repeats") + (F.col("h") < F.col("below")).cast("int") + F.array_contains("picks", F.col("h")).cast("int")


def assign(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, seed: int = 17, max_patterns: int = 100_000
) -> DataFrame:
    """One row for each of docs: id_col, size (words), source_size and target (summed over its sources), taken (words that the
    mix takes of it, repeats counted; size times a whole number from 0 to max_repeats).

    Null and empty texts have the size 0. Rows with the same id and text are taken equally often. Other columns are not read."""
    known = cut(docs.select(F.col(id_col).alias("id"), n_words(text_col).alias("size"), _pattern(docs, source_col).alias("pattern"), _hash(id_col, text_col, seed).alias("h")))
    plan = _decide(known, max_repeats, max_patterns)
    return known.join(plan, "pattern").select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _times()).alias("taken")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, seed: int = 17, max_patterns: int = 100_000
) -> DataFrame:
    """The mix itself: each row of docs as often as assign() takes it, with its columns. Rows without words (null and empty texts among them) don't occur; a null source, or an
    empty list of them, is a source of its own; rows with the same id and text occur equally often; no rows give none."""
    pattern, h, words = fresh(docs, "pattern", "h", "words")
    marks = {pattern: _pattern(docs, source_col), h: _hash(id_col, text_col, seed), words: n_words(text_col)}
    known = cut(docs.select(marks[words].alias("size"), marks[pattern].alias("pattern"), marks[h].alias("h")))
    plan = _decide(known, max_repeats, max_patterns)
    wide = docs.withColumns(marks).select(F.struct(*docs.columns).alias("row"), F.col(pattern).alias("pattern"), F.col(h).alias("h"), F.col(words).alias("size"))
    several = wide.join(plan, "pattern").withColumn("times", F.when(F.col("size") > 0, _times()).otherwise(0)).filter("times > 0")
    return several.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("n")).select("row.*")

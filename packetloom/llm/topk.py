"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments, and of each segment the mean and the deviation are kept. For segments of length L,

    |q - x|^2 >= sum of L * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

and as |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, this bounds the inner product from above by the sum of
L * (mean_q * mean_x + dev_q * dev_x), itself a product of short vectors, here with 4, 8, 16, ... segments.

Rows are dealt to the nearest of some pivots in the space of the statistics of up to 16 segments, and to blocks by their distance from
it, so that a block's statistics lie close together; their least and greatest values are its envelope, which bounds a query's product with any row
of the block. First each query meets its SEEDS best blocks by that bound, and its k-th best score there is its bar. Then it
is sent to those blocks only whose envelope reaches its bar. In a block, the bounds of pairs are looked at from coarse to fine, and what
survives is computed exactly: pair by pair where few survive, by a matrix product where many do, since that is cheaper than
a closer look. Bounds are rounded upwards, so no pair is lost, ties included; where nothing can be pruned, all pairs are computed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FIRST, LEAST, OUTLINE = 4, 2, 16
#: Numbers in a block of rows and of queries, pairs of one step, envelopes that a block of queries meets at once.
BLOCK, ASKING, STEP, PAGE = 1 << 19, 1 << 17, 1 << 20, 4096
#: Blocks that a query meets first; pivots, and the rows that they are found from. These change the cost, never the result.
SEEDS, PIVOTS, SAMPLE = 2, 256, 4096
#: Blocks of queries for which a block is copied.
ASKERS = 32
#: Shares of surviving pairs up to which they are bounded more finely, and taken one by one.
FINER, SINGLY = 1 / 2, 1 / 32


def _levels(dim: int) -> list[int]:
    out, n = [], FIRST
    while dim // n >= LEAST:
        out.append(n)
        n *= 2
    return out


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, each times the root of its segment's length; segments may differ by one in length."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    dev = np.sqrt(np.maximum(np.add.reduceat(x * x, cuts[:-1], axis=1) / size - mean * mean, 0))
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([size, size]))


def _outline(x: np.ndarray) -> np.ndarray:
    """The statistics of at most OUTLINE segments, as fine as may be; of very short vectors, the vectors themselves."""
    x = x.astype(np.float64)
    levels = [n for n in _levels(x.shape[1]) if n <= OUTLINE]
    return _statistics(x, levels[-1]) if levels else x


class Side:
    """Vectors of one length with their ids, and what is known of them."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m = ids, m
        self.levels = _levels(m.shape[1])
        self.top = float(max(-m.min(initial=0), m.max(initial=0)))
        self.norms = np.linalg.norm(m.astype(np.float64), axis=1)
        self._exact: dict = {}
        self._bounds: dict = {}

    def exact(self, kind) -> np.ndarray:
        if kind not in self._exact:
            self._exact[kind] = self.m.astype(kind)
        return self._exact[kind]

    def bounds(self, level: int, kind) -> np.ndarray:
        if (level, kind) not in self._bounds:
            self._bounds[level, kind] = _statistics(self.m.astype(np.float64), level).astype(kind)
        return self._bounds[level, kind]


def _gathered(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a with rows j of b."""
    out = np.empty(len(i), a.dtype)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("nd,nd->n", a[i[s]], b[j[s]])
    return out


def search_block(q: Side, x: Side, k: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and of rows, and scores: for each query its k best rows whose score is not below its bar, its own id excluded."""
    reach = q.top * x.top * max(1, x.m.shape[1])
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64  # products in it are exact
    loose = np.float32 if max(q.top, x.top) < 1e12 else np.float64
    eps = ((2e-5 if loose == np.float32 else 1e-9) * (q.norms * x.norms.max(initial=0) + 1)).astype(loose)[:, None]
    out = []
    for at in range(0, len(q.ids), step := max(1, STEP // max(1, len(x.ids)))):
        rows = slice(at, at + step)
        least = np.full(len(q.ids[rows]), -np.inf) if bar is None else bar[rows].astype(np.float64)
        alive = q.ids[rows, None] != x.ids[None, :]
        qe, xe = q.exact(kind)[rows], x.exact(kind)
        pairs = None
        for level in x.levels if len(x.ids) > k else []:
            qs, xs = q.bounds(level, loose)[rows], x.bounds(level, loose)
            if pairs is not None:
                i, j = pairs
                near = _gathered(qs, xs, i, j) + eps[rows][i, 0] >= least[i].astype(loose)
                pairs = i[near], j[near]
                continue
            bound = qs @ xs.T + eps[rows]
            if level == FIRST and bar is None:
                least = _first_bar(bound, alive, qe, xe, k)
            alive &= bound >= least.astype(loose)[:, None]
            share = np.count_nonzero(alive) / max(1, alive.size)
            if share > FINER:
                break
            if share <= SINGLY:
                pairs = np.nonzero(alive)
        if pairs is None:
            score = qe @ xe.T
            i, j = np.nonzero(alive & (score >= least[:, None]))
            s = score[i, j].astype(np.int64)
        else:
            i, j = pairs
            s = _gathered(qe, xe, i, j)
            good = s >= least[i]
            i, j, s = i[good], j[good], s[good].astype(np.int64)
        order = np.lexsort((x.ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(least)))[i] < k
        out.append((at + i[keep], j[keep], s[keep]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))


def _first_bar(bound: np.ndarray, alive: np.ndarray, q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the rows that its bounds promise most of: what is below can't be among the k best."""
    n = min(4 * k, x.shape[0])
    best = np.argpartition(np.where(alive, bound, -np.inf), x.shape[0] - n, axis=1)[:, x.shape[0] - n :]
    i = np.repeat(np.arange(len(best)), n)
    s = _gathered(q, x, i, best.ravel()).astype(np.float64)
    s[~alive[i, best.ravel()]] = -np.inf
    return np.sort(s.reshape(-1, n), axis=1)[:, n - min(k, n)]


# --- blocks ---------------------------------------------------------------------------------------------------


def _pivots(sample: list) -> dict[int, np.ndarray]:
    """For each length of the sampled vectors, some points among their statistics, neighbours next to each other."""
    out = {}
    for dim in {len(v) for v in sample}:
        s = _outline(np.array([v for v in sample if len(v) == dim]))
        p = s[:: max(1, len(s) // min(PIVOTS, max(1, len(s) // 8)))]
        for _ in range(5):
            near = (np.square(s).sum(1)[:, None] - 2 * s @ p.T + np.square(p).sum(1)).argmin(1)
            p = np.stack([s[near == i].mean(0) if (near == i).any() else p[i] for i in range(len(p))])
        left, chain = list(range(1, len(p))), [0]
        while left:
            chain.append(min(left, key=lambda i: float(np.square(p[i] - p[chain[-1]]).sum())))
            left.remove(chain[-1])
        out[dim] = p[chain]
    return out


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """With pivot and far: the nearest pivot, and the distance from it."""

    @F.arrow_udf("struct<pivot: int, far: float>")
    def place(v: pa.Array) -> pa.Array:
        ends, values = v.offsets.to_numpy(), v.values.to_numpy()
        dims = np.diff(ends)
        pivot, far = np.zeros(len(v), np.int32), np.zeros(len(v), np.float32)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            if int(dim) in pivots:
                p = pivots[int(dim)]
                s = _outline(values[ends[rows][:, None] + np.arange(dim)])
                d = np.square(s).sum(1)[:, None] - 2 * s @ p.T + np.square(p).sum(1)
                pivot[rows], far[rows] = d.argmin(1), np.sqrt(np.maximum(d.min(1), 0))
        return pa.StructArray.from_arrays([pa.array(pivot), pa.array(far)], ["pivot", "far"])

    return vectors.withColumn("place", place("v")).select("*", "place.*").drop("place")


BLOCK_SCHEMA = "block string, dim int, kind string, ids binary, m binary, low array<double>, high array<double>"


def _pack(numbers: int):
    """Sorted by dim and place: a row for each block of about so many numbers, with its ids and vectors in the smallest type
    and its envelope, named by a digest. Equal rows, which stand together, are one."""

    def closed(dim: int, ids: np.ndarray, m: np.ndarray):
        top = max(-int(m.min()), int(m.max()) + 1)
        kind = next(t for t in ("i1", "i2", "i4", "i8") if top <= 1 << (8 * int(t[1]) - 1))
        s = _outline(m)
        ids_, m_ = ids.tobytes(), m.astype(kind).tobytes()
        block = xxhash.xxh3_128_hexdigest(ids_ + m_, dim)
        row = {"block": block, "dim": dim, "kind": kind, "ids": ids_, "m": m_, "low": s.min(0).tolist(), "high": s.max(0).tolist()}
        return pa.RecordBatch.from_pylist(
            [row], pa.schema([("block", pa.string()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("m", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        )

    def run(batches):
        held, n, at = [], 0, None

        def flush():
            nonlocal held, n
            ids, m = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            new = np.append(True, (ids[1:] != ids[:-1]) | (m[1:] != m[:-1]).any(axis=1))
            held, n = [], 0
            return closed(at, ids[new], m[new])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, dims = (batch.column(c).to_numpy().astype(np.int64) for c in (0, 1))
            v = batch.column(2)
            values, ends = v.values.to_numpy(), v.offsets.to_numpy()
            starts = np.flatnonzero(np.append(True, dims[1:] != dims[:-1]))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(dims)]):
                if held and at != dims[s]:
                    yield flush()
                at = int(dims[s])
                rows = max(256, numbers // at)
                m = values[ends[s] : ends[e]].reshape(-1, at)
                while s < e:
                    take = min(e - s, rows - n)
                    held.append((ids[s : s + take], m[:take]))
                    s, m, n = s + take, m[take:], n + take
                    if n >= rows:
                        yield flush()
        if held:
            yield flush()

    return run


def _blocks(placed: DataFrame, numbers: int, total: int) -> DataFrame:
    """placed (id, dim, v, pivot, far) as a written table of blocks; total: how many numbers there are."""
    order = ["dim", "pivot", "far", F.xxhash64("id")]
    parts = int(max(1, min(100_000, total // numbers)))
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "id", "v").select("id", "dim", "v")
    return cut(ranged.mapInArrow(_pack(numbers), BLOCK_SCHEMA))


def _side(r: dict, which=None) -> Side:
    ids, m = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["m"], r["kind"]).reshape(-1, r["dim"])
    return Side(ids, m) if which is None else Side(ids[which], m[which])


# --- who meets whom -------------------------------------------------------------------------------------------


def _reaching(pages: DataFrame, asking: DataFrame, n_pages: int, barred: bool) -> DataFrame:
    """q_block, block, which (numbers of queries), bound: by the envelopes, the SEEDS best blocks of each query, in each page of envelopes;
    barred: all blocks that reach the query's bar and are not in its `seen`."""

    @F.arrow_udf("binary")
    def outline(m: pa.Array, kind: pa.Array, dim: pa.Array) -> pa.Array:
        of = lambda m, kind, dim: _outline(np.frombuffer(m, kind).reshape(-1, dim)).tobytes()
        return pa.array([of(x.as_py(), k.as_py(), d.as_py()) for x, k, d in zip(m, kind, dim)], pa.binary())

    told = [c for c in ("bar", "seen") if c in asking.columns]
    few = cut(asking.select("q_block", "dim", outline("m", "kind", "dim").alias("outline"), (F.octet_length("ids") / 8).cast("int").alias("n"), *told))  # the vectors stay
    every = few.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, ["dim", "page"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                s, blocks = np.frombuffer(r["outline"]).reshape(r["n"], -1), r["blocks"]
                low, high = np.array(r["lows"]), np.array(r["highs"])
                bound = np.maximum(s, 0) @ high.T + np.minimum(s, 0) @ low.T  # of each product, the greatest in the envelope
                bound += 1e-9 * (np.abs(s) @ np.maximum(np.abs(low), np.abs(high)).T + 1)
                if barred:
                    hit = bound >= np.array(r["bar"], np.float64)[:, None]
                    place = {b: i for i, b in enumerate(blocks)}
                    for x in r["seen"]:
                        if x["block"] in place:
                            hit[x["w"], place[x["block"]]] = False
                else:
                    hit = np.zeros(bound.shape, bool)
                    n = min(SEEDS, len(blocks))
                    np.put_along_axis(hit, np.argpartition(bound, len(blocks) - n, axis=1)[:, len(blocks) - n :], True, axis=1)
                rows = [{"q_block": r["q_block"], "block": blocks[b], "which": w.tolist(), "bound": bound[w, b].tolist()} for b in range(len(blocks)) if len(w := np.flatnonzero(hit[:, b]))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("q_block", pa.string()), ("block", pa.string()), ("which", pa.list_(pa.int32())), ("bound", pa.list_(pa.float64()))]))

    return every.mapInArrow(run, "q_block string, block string, which array<int>, bound array<double>")


FOUND = "q_block string, which int, query_id long, vec_id long, score long"


def _searched(meetings: DataFrame, asking: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """meetings, a written table: q_block, block, which. Only the vectors of these queries are sent to the block; a block that many ask for is there in
    several copies, each for some ASKERS blocks of queries. FOUND rows, at most k for a query and block."""
    parts = meetings.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("parts"))  # a row a block

    def pick(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                w = np.array(r["which"], np.int64)
                q = _side(r, w)
                bar = None if r["bar"] is None else np.array(r["bar"], np.int64)[w].tobytes()
                row = {"q_block": r["q_block"], "block": r["block"], "salt": r["salt"], "which": w.tobytes(), "q_kind": r["kind"], "q_ids": q.ids.tobytes(), "q_m": q.m.tobytes(), "q_bar": bar}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("q_block", pa.string()), ("block", pa.string()), ("salt", pa.int32()), *[(c, pa.string() if c == "q_kind" else pa.binary()) for c in ("which", "q_kind", "q_ids", "q_m", "q_bar")]]))

    def run(batches):
        at, x = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                if r["block"] != at:
                    at, x = r["block"], _side(r)
                q = Side(np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_m"], r["q_kind"]).reshape(-1, r["dim"]))
                i, j, s = search_block(q, x, k, None if r["q_bar"] is None else np.frombuffer(r["q_bar"], np.int64))
                which = np.frombuffer(r["which"], np.int64)[i].astype(np.int32)
                columns = [pa.repeat(r["q_block"], len(i)), *map(pa.array, (which, q.ids[i], x.ids[j], s))]
                yield pa.RecordBatch.from_arrays(columns, ["q_block", "which", "query_id", "vec_id", "score"])

    salted = meetings.select("q_block", "block", "which").join(parts, "block").withColumn("salt", F.pmod(F.xxhash64("q_block"), F.col("parts")).cast("int")).drop("parts")
    sent = salted.join(asking, "q_block").mapInArrow(pick, "q_block string, block string, salt int, which binary, q_kind string, q_ids binary, q_m binary, q_bar binary")
    copies = blocks.select("block", "dim", "kind", "ids", "m").join(parts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return sent.join(copies, ["block", "salt"]).mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k rows, its own id excluded, whose vectors have the largest inner
    product with its own, ties to the smaller id; all rows, if there are fewer. Components are floor(scale * x) first.

    Rows that are null, have no id, or hold a null or non-finite component take no part; vectors of different
    length don't meet. Rows with the same id and vector are one. Other columns are not read. No rows, or no queries, give no rows."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(F.lit(scale) * x).cast("long"))
    finite = F.forall(F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).filter(finite)
    sound = sound.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.size(vector_col).alias("dim"), v.alias("v"))
    sample = [r.v for r in sound.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    placed = cut(_placed(sound, _pivots(sample)))
    sizes = {r.asks: r.n for r in placed.groupBy("asks").agg(F.sum("dim").alias("n")).collect()}
    blocks = _blocks(placed.drop("asks"), BLOCK, sum(sizes.values()))
    asking = _blocks(placed.filter("asks").drop("asks"), ASKING, sizes.get(True, 0)).withColumnRenamed("block", "q_block").drop("low", "high")
    n_pages = -(-max(1, blocks.count()) // PAGE)
    pages = blocks.select("dim", F.pmod(F.xxhash64("block"), F.lit(n_pages)).cast("int").alias("page"), F.struct("block", "low", "high").alias("b"))
    pages = pages.groupBy("dim", "page").agg(F.collect_list("b").alias("b")).select("dim", "page", F.col("b.block").alias("blocks"), F.col("b.low").alias("lows"), F.col("b.high").alias("highs"))

    best = _reaching(pages, asking, n_pages, False)
    if n_pages > 1:  # of the best in each page, the best of all
        one = best.select("q_block", "block", F.explode(F.arrays_zip("which", "bound")).alias("w")).select("q_block", "block", "w.*")
        place = F.row_number().over(Window.partitionBy("q_block", "which").orderBy(F.desc("bound"), "block"))
        best = one.withColumn("place", place).filter(F.col("place") <= SEEDS).groupBy("q_block", "block").agg(F.collect_list("which").alias("which"))
    best = cut(best.select("q_block", "block", "which"))
    found = cut(_searched(best, asking.withColumn("bar", F.lit(None).cast("array<long>")), blocks, k))

    # Each query's bar, and the blocks that it has met: as arrays in the order of the block's queries.
    place = F.row_number().over(Window.partitionBy("q_block", "which").orderBy(F.desc("score"), "vec_id"))
    bars = found.withColumn("place", place).filter(F.col("place") == k).groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("which", "score"))).alias("known"))
    seen = best.select("q_block", F.explode("which").alias("w"), "block").groupBy("q_block").agg(F.collect_list(F.struct("w", "block")).alias("seen"))
    number = F.sequence(F.lit(0), (F.octet_length("ids") / 8 - 1).cast("int"))
    bar = F.transform(number, lambda i: F.coalesce(F.try_element_at(F.col("known"), i), F.lit(-(1 << 63))))
    barred = cut(asking.join(bars, "q_block", "left").join(seen, "q_block", "left").withColumn("bar", bar).withColumn("seen", F.coalesce("seen", F.array().cast("array<struct<w:int,block:string>>"))).drop("known"))
    more = _searched(cut(_reaching(pages, barred, n_pages, True)), barred.drop("seen"), blocks, k)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    every = found.unionByName(more).select("query_id", "vec_id", "score")
    return every.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

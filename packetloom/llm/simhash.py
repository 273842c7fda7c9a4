"""Near-duplicates by SimHash, found through the generalised pigeonhole principle.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its word shingles. Two
texts are linked if their fingerprints differ in at most `max_bits` bits, and linked texts form components.

To find all links, the 64 positions are grouped into parts, correlated bits together, so that what the data
repeat falls into few parts. Part i gets a threshold t_i >= -1, unequal in general, with the sum of (t_i + 1)
equal to max_bits + 1: two fingerprints within max_bits must then differ by at most t_i bits in some part i.
Dynamic programming picks the thresholds, for every number of parts, at the least estimated cost: probes plus
candidates, the candidates estimated from the pairs of a bounded sample. The plan changes the cost, never the
result. Every fingerprint is listed under its value in each part, and asks the values within t_i that are
larger than its own; candidates in a bucket are verified on all bits.

Equal fingerprints are one node, so copies cost nothing. A bucket returns a spanning forest of its links, never
all pairs; buckets of more than `bucket_rows` fingerprints, those that only ask counted too, are cut into blocks, and
pairs of blocks are verified by different tasks, so no task holds an unbounded bucket.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, cut, lookup_join
from .components import components

BITS = 64
SEED = 42
#: Words of a fingerprint's shingle, and in how many bits linked fingerprints differ at most.
WORDS, MAX_BITS = 3, 3
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 14


def _grams(text: bytes, shingle: int) -> list[bytes]:
    words = text.lower().split()
    n = len(words)
    if n <= shingle:
        return [b" ".join(words)] * (n > 0)
    if shingle == 1:
        return words
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle + 1]
    return [line[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]


def _majority(grams: list[bytes], digest, bits: int) -> np.ndarray:
    """Of each bit of the hashes, whether it is set in over half of them, as 64-bit numbers."""
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(grams), CHUNK):
        h = np.frombuffer(b"".join([digest(g, SEED) for g in grams[at : at + CHUNK]]), ">u8").reshape(-1, bits // 64)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(grams)).view(">u8").astype(np.uint64)


def _again(h: np.ndarray, k: int) -> np.ndarray:
    h = (h + np.uint64(2 * k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def fingerprint(text: bytes, shingle: int) -> int:
    """Of a UTF-8 text. A-Z is lower-cased, words are separated by [\\x20\\x09-\\x0D], shingles are joined by one
    space. Fewer words make one shingle, none give 0. A repeated shingle counts as often as it occurs."""
    return int(_majority(_grams(text, shingle), xxhash.xxh64_digest, BITS)[0])


def fingerprint_column(text_col: str, shingle: int):
    """The fingerprint as a bigint column; null counts as an empty text."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts), np.uint64)
        for i, text in enumerate(texts.cast(pa.binary())):
            out[i] = fingerprint(text.as_py(), shingle)
        return pa.array(out.view(np.int64))

    return of(body(text_col))


# --- the plan -------------------------------------------------------------------------------------------------


def _pair_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many both bit i and bit j are set. Every task sums its own rows first."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total, n = total + (x.T @ x).astype(np.float64), n + len(x)
        at = np.append(np.arange(BITS * BITS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["at", "n"])

    summed = prints.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    got = {r["at"]: r["n"] for r in summed}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(BITS * BITS)], np.float64).reshape(BITS, BITS)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit 0 is the most significant one."""
    return np.unpackbits(values.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _grouping(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each takes the bits most correlated with those that it has."""
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    like = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(like, 0)
    free, out = set(range(BITS)), []
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        bits = [max(free, key=lambda b: (like[b, sorted(free)].max(initial=0), -b))]
        free.discard(bits[0])
        while len(bits) < width:
            bits.append(max(free, key=lambda b: (like[b, bits].mean(), -b)))
            free.discard(bits[-1])
        out.append(sorted(bits))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def _allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """cost[i][t + 1] of threshold t in part i; thresholds from -1 up whose sum of t + 1 is `total`, at least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k, x in enumerate(row):
                if used + k <= total and (used + k not in new or c + x < new[used + k][0]):
                    new[used + k] = (c + x, [*ts, k - 1])
        best = new
    return best.get(total, (float("inf"), []))


#: The widest ball of probes that a plan may use, and what a row that is shuffled and sorted costs beside the comparison of a
#: candidate, some two microseconds and fifty bytes to five nanoseconds.
MOST_RADIUS, PROBE_COST, LEAST_PARTS, MOST_PARTS = 3, 400.0, 2, 16


def plan(n: int, both: np.ndarray, sample: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(mask, threshold) of each part in use. sample: some fingerprints, from whose pairs candidates are estimated."""
    sample = np.asarray(sample, np.int64).view(np.uint64)
    best = (float("inf"), [])
    for parts in range(LEAST_PARTS, min(MOST_PARTS, max_bits + 4) + 1):
        masks = [_mask(b) for b in _grouping(n, both, parts)]
        cost = []
        for mask in masks:
            width = mask.bit_count()
            seen = np.zeros(width + 1)
            own = sample & np.uint64(mask)
            for at in range(0, len(own), 256):
                seen += np.bincount(np.bitwise_count(own[at : at + 256, None] ^ own[None, :]).ravel(), minlength=width + 1)[: width + 1]
            seen[0] -= len(own)
            pairs, row, ball = max(1, len(own) * (len(own) - 1)), [0.0], 0
            for t in range(min(MOST_RADIUS, width) + 1):
                ball += comb(width, t)
                share = max(seen[: t + 1].sum() / pairs, ball / 2.0**width)
                row.append(PROBE_COST * n * (1 + ball) / 2 + share * n * n / 2)
            cost.append(row)
        c, ts = _allocate(cost, max_bits + 1)
        best = min(best, (c, [(m, t) for m, t in zip(masks, ts) if t >= 0]))
    return best[1]


# --- probing and verifying ------------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def _ball(mask: int, radius: int) -> np.ndarray:
    """All ways to flip one to `radius` bits of mask."""
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    return np.array([sum(c) for r in range(1, radius + 1) for c in combinations(bits, r)], np.uint64)


def _rows(parts: list[tuple[int, int]]):
    """Of (fp, node): part, key, probe, fp, node for the list entry and each probe."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fp, node = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                f = fp.view(np.uint64)
                for p, (mask, t) in enumerate(parts):
                    own = f & np.uint64(mask)
                    yield _batch(p, own, False, fp, node)
                    if t > 0:
                        for flips in np.array_split(_ball(mask, t), max(1, len(_ball(mask, t)) // 64)):
                            asked = own[:, None] ^ flips[None, :]
                            i, j = np.nonzero(asked > own[:, None])  # of two values, the smaller asks for the larger
                            yield _batch(p, asked[i, j], True, fp[i], node[i])

    return run


def _batch(p, key, probe, fp, node):
    n = len(fp)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, p, np.int16)), pa.array(key.view(np.int64)), pa.array(np.full(n, probe)), pa.array(fp), pa.array(node)],
        ["part", "key", "probe", "fp", "node"],
    )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) between node numbers, as links of each node with the least one of its component."""
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(names))
    return names[label[far]], names[far]


#: Cells of one comparison, and rows up to which a run is compared by shifts.
CELLS, SHORT = 1 << 21, 12


def _links(listed: tuple, asking: tuple, near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one bucket. listed, asking: (rows of fingerprints, nodes). A component under way is compared
    only with what it has not reached yet, so a dense bucket costs far less than all its pairs."""
    (lf, ln), (af, an) = listed, asking
    out = []
    step = max(1, CELLS // max(1, len(lf)))
    if len(lf) <= 2048:
        i, j = np.nonzero(near(lf[:, None], lf[None, :]))
        out += [(ln[i], ln[j])] * bool(len(i))
        for at in range(0, len(af), step):
            i, j = np.nonzero(near(af[at : at + step, None], lf[None, :]))
            out += [(an[at + i], ln[j])] * bool(len(i))
    else:
        f, node = np.concatenate([lf, af]), np.concatenate([ln, an])
        rest = np.arange(len(f))
        while len(rest):
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                block, front = front[:256], front[256:]
                got = np.zeros(len(rest), bool)
                for at in range(0, len(rest), CELLS // 256):
                    hit = near(f[block][:, None], f[rest[at : at + CELLS // 256]][None, :])
                    new = hit.any(axis=0)
                    got[at : at + len(new)] = new
                    out += [(node[block[hit.argmax(axis=0)[new]]], node[rest[at : at + len(new)][new]])] * bool(new.any())
                front, rest = np.concatenate([front, rest[got]]), rest[~got]
    if not out:
        return []
    a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
    return [_forest(a, b)] if len(a) > 64 else [(a, b)]


def _verify(max_bits: int):
    """Sorted by bucket; yields links a, b. Short buckets of a batch are compared together, by shifts."""

    def near(x, y):
        return np.bitwise_count(x["f"] ^ y["f"]) <= max_bits

    def rows(table: pa.Table):
        col = {n: table.column(n).to_numpy().astype(np.int64) for n in table.column_names if n not in ("probe",)}
        f = np.zeros(table.num_rows, np.dtype([("f", np.uint64)]))
        f["f"] = col["fp"].view(np.uint64)
        return f, col, table.column("probe").to_numpy()

    def closed(table: pa.Table):
        f, col, probe = rows(table)
        node = col["node"]
        key = np.ones(len(f), bool)
        key[1:] = np.any([col[n][1:] != col[n][:-1] for n in ("part", "key", "p", "q") if n in col], axis=0)
        starts = np.flatnonzero(key)
        sizes = np.diff(np.append(starts, len(f)))
        run = np.cumsum(key) - 1
        short = (sizes <= SHORT)[run]
        a, b = [], []
        for d in range(1, SHORT):
            i = np.flatnonzero(short[:-d] & (run[:-d] == run[d:]) & ~(probe[:-d] & probe[d:])) if len(f) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[near(f[i], f[i + d])]
            a.append(node[i])
            b.append(node[i + d])
        for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
            own, ask = s + np.flatnonzero(~probe[s : s + n]), s + np.flatnonzero(probe[s : s + n])
            if len(own):
                for x, y in _links((f[own], node[own]), (f[ask], node[ask]), near):
                    a.append(x)
                    b.append(y)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        keep = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [c for c in ("part", "key", "p", "q") if c in batch.schema.names]
            held.append(batch)
            n += batch.num_rows
            if n < 1 << 16:
                continue
            table = pa.Table.from_batches(held)
            same = np.ones(table.num_rows, bool)
            for c in keys:  # the last bucket may go on
                x = table.column(c).to_numpy()
                same &= x == x[-1]
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if end:
                yield closed(table.slice(0, end))
            held = table.slice(end).combine_chunks().to_batches()
            n = 0 if end else -table.num_rows  # a bucket that fills all is read on until it doubles
            n = sum(x.num_rows for x in held) if end else n
        if held and sum(x.num_rows for x in held):
            yield closed(pa.Table.from_batches(held))

    return run


def link(nodes: DataFrame, max_bits: int, sample_rows: int = 2048, bucket_rows: int = 20000) -> DataFrame:
    """nodes: fp, node (bigints, no nulls); a node has one row.
    Returns links a, b between nodes that span the components of all pairs within max_bits."""
    n, both = _pair_counts(nodes.select("fp"))
    sample = [r.fp for r in nodes.select("fp").orderBy(F.xxhash64("node"), "fp").limit(sample_rows).collect()]
    parts = plan(n, both, np.array(sample, np.int64), max_bits)
    rows = nodes.select("fp", "node").mapInArrow(_rows(parts), "part smallint, key long, probe boolean, fp long, node long")
    counts = rows.groupBy("part", "key").agg(F.count_if(~F.col("probe")).alias("listed"), F.count_if("probe").alias("asking"))
    heavy = cut(counts.filter(F.col("listed") + F.col("asking") > bucket_rows))
    keys = ["part", "key"]
    if heavy.head(1):  # at most rows / bucket_rows buckets
        blocks = lambda c: F.ceil(F.col(c) / bucket_rows).cast("int")
        sized = heavy.select("part", "key", blocks("listed").alias("lists"), blocks("asking").alias("asks"))
        rows = rows.join(F.broadcast(sized) if sized.count() <= 10000 else sized, keys, "left")
        number = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
        pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
        each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        lists, asks = F.col("lists"), F.col("asks")
        # Blocks of entries meet in pairs (p, q); a block of probes, numbered below zero, meets each block of entries.
        among = F.transform(each(lists), lambda i: pair(F.least(number(lists), i), F.greatest(number(lists), i)))
        asked = F.transform(each(asks), lambda i: pair(-1 - i, number(lists)))
        asking = F.transform(each(lists), lambda i: pair(-1 - number(asks), i))
        place = F.when(lists.isNull(), F.array(pair(F.lit(0), F.lit(0)))).when(F.col("probe"), asking).otherwise(F.concat(among, asked))
        rows = rows.withColumn("place", F.explode(place)).select("part", "key", "place.p", "place.q", "probe", "fp", "node")
        keys += ["p", "q"]
    count = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(count, *keys).sortWithinPartitions(*keys, "probe").mapInArrow(_verify(max_bits), "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


# --- operators ------------------------------------------------------------------------------------------------


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each of docs: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable by links,
    its own included). Null and empty texts have the fingerprint 0. A null id counts for no component: its row gets
    the component of its fingerprint if that has an id, else null. Rows may repeat. Other columns are not read. No rows give none."""
    known = cut(docs.select(F.col(id_col).cast("long").alias("id"), fingerprint_column(text_col, shingle).alias("fp")))
    prints = cut(known.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")))
    nodes = prints.filter("node is not null").select("fp", "node")
    if not nodes.head(1):
        named = prints.withColumn("component_id", F.col("node"))
    else:
        # An id that stands for two fingerprints (repeated ids) is one node with two rows: linked by what it is.
        found = components(link(nodes, max_bits)).select("node", "component")
        named = prints.join(found, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    named = cut(named.select("fp", "component_id", "copies"))
    return lookup_join(known, named, "fp", "copies", known.count()).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: For near_dedup: keys of a set of shingles, and how many pairs of the wanted similarity may share none of them.
BANDS, MISSED = 32, 1e-5
#: Rows of a bucket that are paired with all others before anything is verified.
FIRST = 4
#: Standard deviations by which the estimated similarity of a pair may miss the wanted one, so that it is still verified.
MARGIN = 5


def _minima_for(similarity: float) -> int:
    """Minima that make one key: the most with which no more than MISSED of the pairs of this Jaccard similarity share none of
    BANDS keys. Two sets have the same minimum with the probability of their Jaccard similarity, whatever they differ in."""
    r = 1
    while (1 - similarity ** (r + 1)) ** BANDS <= MISSED:
        r += 1
    return r


def band_keys(grams: set[bytes], minima: int) -> tuple[np.ndarray, bytes]:
    """BANDS keys of a set that is not empty, each of `minima` least values of hashes of its elements; and a byte of each of these."""
    h = np.frombuffer(b"".join([xxhash.xxh3_64_digest(g, SEED) for g in grams]), ">u4")[::2].astype(np.uint32)
    by = (_again(np.arange(BANDS * minima, dtype=np.uint64), 7) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = np.full(len(by), np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024, None] * by
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, (x ^ (x >> np.uint32(12))).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, minima).T:
        key = _again(key ^ x.astype(np.uint64), 0)
    return key, least.astype(np.uint8).tobytes()


def _set_column(text_col: str, shingle: int, minima: int):
    """Struct of a digest of the set of shingles, its size, its keys, and a byte of each minimum; null counts as an empty text."""

    @F.arrow_udf("struct<d: binary, n: int, keys: array<bigint>, least: binary>")
    def of(texts: pa.Array) -> pa.Array:
        digests, sizes, keys, least = [], [], [], []
        for text in texts.cast(pa.binary()):
            grams = set(_grams(text.as_py(), shingle))
            digests.append(xxhash.xxh3_128_digest(b"\n".join(sorted(grams)), SEED))
            sizes.append(len(grams))
            key, low = band_keys(grams, minima) if grams else (np.zeros(0, np.uint64), b"")
            keys.append(key.view(np.int64))
            least.append(low)
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(least, pa.binary())], ["d", "n", "keys", "least"])

    return of(body(text_col))


def _alike(n, m, similarity: float):
    """Whether sets of n and m elements can be that similar."""
    return np.minimum(n, m) / np.maximum(n, m) >= similarity


def _first_pairs(similarity: float):
    """Of (key, node, n) sorted by key and node: pairs a, b of the first FIRST rows of a bucket with all others, with key null; and
    the further rows again, as a = node, b = n. A bucket may be of any size: no more than its first rows are held."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(held[0])
            key, node, n = (np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held))
            new = np.append(True, key[1:] != key[:-1])
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            pos = np.arange(len(key)) - start
            for k in range(FIRST):
                i = np.flatnonzero(pos > k)
                i = i[i >= old]
                j = start[i] + k
                ok = (node[i] != node[j]) & _alike(n[i], n[j], similarity)
                i, j = i[ok], j[ok]
                yield _three(pa.nulls(len(i), pa.int64()), node[j], node[i])
            i = np.flatnonzero(pos >= FIRST)
            i = i[i >= old]
            yield _three(pa.array(key[i]), node[i], n[i])
            last = slice(start[-1], start[-1] + FIRST)
            held = [key[last], node[last], n[last]]

    return run


def _three(key, a, b):
    return pa.RecordBatch.from_arrays([key, pa.array(a), pa.array(b)], ["key", "a", "b"])


def _enough(similarity: float, minima: int) -> float:
    """The share of equal minima from which a pair is verified."""
    return similarity - MARGIN * (similarity * (1 - similarity) / (BANDS * minima)) ** 0.5


def _likely(similarity: float, minima: int):
    """Of (a, b, x, y): pairs of which enough of the minima x and y are equal."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(i)), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= _enough(similarity, minima)))

    return run


def _hashes_column(text_col: str, shingle: int):
    """64-bit hashes of the set of shingles, in order, as bytes."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        hashed = lambda t: np.unique(np.frombuffer(b"".join([xxhash.xxh3_64_digest(g, SEED) for g in set(_grams(t, shingle))]), np.uint64))
        return pa.array([hashed(t.as_py()).tobytes() for t in texts.cast(pa.binary())], pa.binary())

    return of(F.col(text_col))


def _other_links(similarity: float, minima: int):
    """Of (key, p, q, own, node, component, least, grams) sorted by key, p, q: links a, b that span the near pairs of a bucket that are not in one
    component yet. Pairs with enough equal minima are compared by their sets, the likeliest first, unless links so far join them."""

    def near(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both)

    def closed(table: pa.Table):
        key, p, q, own, node, comp = (table.column(i).to_numpy() for i in range(6))
        low = np.frombuffer(b"".join(v.as_py() for v in table.column(6)), np.uint8).reshape(table.num_rows, -1)
        grams = [np.frombuffer(v.as_py(), np.uint64) for v in table.column(7)]
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        new = np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
        for s, e in zip(np.flatnonzero(new).tolist(), np.append(np.flatnonzero(new)[1:], len(key)).tolist()):
            parent: dict[int, int] = {}

            def root(x):
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            links = []
            step = max(1, CELLS // (e - s))
            for at in range(s, e, step):
                to = min(e, at + step)
                i, j = np.nonzero((comp[at:to, None] < comp[None, s:e]) & _alike(size[at:to, None], size[None, s:e], similarity))
                i, j = i + at, j + s
                ok = (own[i] != own[j]) | (p[i] == q[i])
                i, j = i[ok], j[ok]
                share = np.concatenate([np.zeros(0), *((low[i[c : c + 8192]] == low[j[c : c + 8192]]).mean(axis=1) for c in range(0, len(i), 8192))])
                ok = np.flatnonzero(share >= _enough(similarity, minima))
                for k in ok[np.argsort(-share[ok], kind="stable")].tolist():
                    a, b = root(int(comp[i[k]])), root(int(comp[j[k]]))
                    if a != b and near(grams[i[k]], grams[j[k]]):
                        parent[a] = b
                        links.append((int(node[i[k]]), int(node[j[k]])))
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            same = np.ones(table.num_rows, bool)
            for c in ("key", "p", "q"):  # the last bucket may go on
                x = table.column(c).to_numpy()
                same &= x == x[-1]
            if not same.all():
                end = int(np.flatnonzero(~same)[-1]) + 1
                yield from closed(table.slice(0, end))
                held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield from closed(pa.Table.from_batches(held))

    return run


#: Ids that are broadcast to pick their texts, some 50 bytes each in memory. Where more are wanted, texts and ids are shuffled.
FEW = 500_000


def _few(ids: DataFrame) -> DataFrame:
    """ids, a table that is cheap to read, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs a, b of ids whose texts in docs (id, text) have sets of shingles with a Jaccard similarity of `similarity`
    or more, exactly. An id that is in many pairs is broadcast with its text; other texts of pairs are shuffled. docs is read once."""
    ends = pairs.select(F.col("a").alias("id"), F.lit(1).alias("w")).unionByName(pairs.select(F.col("b").alias("id"), F.lit(0).alias("w")))
    held = cut(docs.join(_few(cut(ends.groupBy("id").agg(F.sum("w").alias("w")))), "id").select("id", "text", "w"))
    left = held.filter("w > 0").select(F.col("id").alias("a"), F.col("text").alias("x"), "w")
    right = held.select(F.col("id").alias("b"), F.col("text").alias("y"))
    both = lookup_join(pairs, left, "a", "w", pairs.count()).select("a", "b", "x").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        known: dict[bytes, set[bytes]] = {}

        def grams(text):
            text = text.as_py()
            if text not in known:
                if len(known) >= 64:
                    known.clear()
                known[text] = set(_grams(text, shingle))
            return known[text]

        for batch in batches:
            x, y = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            ok = []
            for s, t in zip(x, y):
                s, t = grams(s), grams(t)
                shared = len(s & t)
                ok.append(shared > 0 and shared / (len(s) + len(t) - shared) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def fingerprint_pairs(sets: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """sets: node, n, fp. Pairs a < b of nodes with words that span the components of all whose fingerprints differ in max_bits bits or fewer: each with the least
    of its fingerprint, and these by the links of fingerprints."""
    spark = sets.sparkSession
    worded = sets.filter("n > 0").select("node", "fp")
    prints = cut(worded.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("rows")))
    if not prints.head(1):
        return spark.createDataFrame([], "a long, b long")
    same = lookup_join(worded, prints, "fp", "rows", worded.count()).select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = link(prints.select("fp", F.col("first").alias("node")), max_bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(linked).filter("a < b")


def near_pairs(sets: DataFrame, docs: DataFrame, shingle: int, similarity: float, bucket_rows: int = 20000) -> DataFrame:
    """sets: node (an id), n, keys, least, fp; docs: id, text. Returns verified pairs a, b that span the components of all pairs of nodes
    that share a key and are near, with those that `fingerprint_pairs` proposes.

    The first rows of each bucket are paired with all its others. What these links leave apart in larger buckets meets there with its sets
    of shingles, as 64-bit hashes, and gives a spanning forest: no more links than rows, whatever a bucket's size. Pairs of whose
    minima too few are equal are left out, by a margin of MARGIN standard deviations; all others are compared."""
    spark, minima = sets.sparkSession, _minima_for(similarity)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = sets.select(F.explode("keys").alias("key"), "node", "n").repartition(count, "key").sortWithinPartitions("key", "node")
    found = cut(rows.mapInArrow(_first_pairs(similarity), "key long, a long, b long"))
    low = sets.select("node", "least")
    first = found.filter("key is null").select("a", "b").distinct()
    first = first.join(low.select(F.col("node").alias("a"), F.col("least").alias("x")), "a").join(low.select(F.col("node").alias("b"), F.col("least").alias("y")), "b")
    likely = first.select("a", "b", "x", "y").mapInArrow(_likely(similarity, minima), "a long, b long")
    seen = cut(fingerprint_pairs(sets).unionByName(likely).distinct())
    links = cut(_verified(seen, docs, shingle, similarity))
    every = found.filter("key is not null").select("key", F.col("a").alias("node"), F.col("b").alias("n"))
    if not every.head(1):
        return links
    rest = every.join(components(links).select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = cut(rest.select("key", "node", "component"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"))
    mixed = cut(mixed.filter("low <> high").select("key", "rows", F.ceil(F.col("rows") / bucket_rows).cast("int").alias("blocks")))
    rest = cut(lookup_join(rest, mixed, "key", "rows", rest.count()))
    if not rest.head(1):
        return links
    wanted = _few(cut(rest.select(F.col("node").alias("id")).distinct()))
    grams = docs.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    grams = grams.select(F.col("id").alias("node"), _hashes_column("text", shingle).alias("grams")).join(low, "node")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    rest = rest.join(grams, "node").select("key", "p", "q", "own", "node", "component", "least", "grams").repartition(count, "key", "p", "q")
    others = rest.sortWithinPartitions("key", "p", "q", "node").mapInArrow(_other_links(similarity, minima), "a long, b long")
    return cut(links.unionByName(others))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-duplicates: the smallest id; columns as they are.

    Near: a Jaccard similarity of `similarity` or more of the sets of `shingle`-word shingles, which the texts are verified by.
    Groups are the components of near pairs. Pairs are proposed by their fingerprints, as near_components links them, and verified by their sets. Fingerprints alone miss most pairs at the
    similarity itself, so pairs that share one of BANDS keys of minima of their sets are verified too: of pairs
    at the similarity itself no more than MISSED are not, of those above fewer, whether words are changed, added or cut.
    Texts without words are one group; rows with a null id stay; rows with the same id all stay if one of them does. The ids that
    go, fewer than those that stay, are broadcast if Spark finds them small; else rows and ids are shuffled."""
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), body(text_col).alias("text"))
    known = cut(texts.select("id", fingerprint_column("text", WORDS).alias("fp"), _set_column("text", shingle, _minima_for(similarity)).alias("s")).select("id", "fp", "s.*"))
    sets = known.groupBy("d").agg(F.min(F.struct("id", "n", "keys", "least", "fp")).alias("m"), F.count(F.lit(1)).alias("copies"))
    sets = cut(sets.select("d", F.col("m.id").alias("node"), "m.n", "m.keys", "m.least", "m.fp", "copies"))
    if not sets.head(1):
        return docs
    found = components(near_pairs(sets, texts, shingle, similarity)).select("node", "component")
    named = cut(sets.select("d", "node", "copies").join(found, "node", "left").select("d", "copies", F.coalesce("component", "node").alias("stays")))
    known = known.select("id", "d")
    rows = lookup_join(known, named, "d", "copies", known.count())
    gone = cut(rows.groupBy("id").agg(F.max((F.col("id") == F.col("stays")).cast("int")).alias("any")).filter("any = 0").select(F.col("id").alias(id_col)))
    return docs.join(gone, id_col, "left_anti").select(docs.columns)

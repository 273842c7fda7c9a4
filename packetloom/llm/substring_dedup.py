"""Substring dedup: passages of `window` words that also start in an earlier document are removed.

A count-min prefilter keeps most windows out of the shuffle. Every window of 50 words has an anchor, the least hash
of its runs of 16 words; equal windows have equal anchors, and one anchor serves some twenty windows in a row. The first
pass counts, in a count-min sketch a partition, the documents of each anchor; the merged sketch overestimates that
count, and so the number of documents with the window. The second pass drops the windows whose estimate is one and groups
the others exactly, by 128 bits of the window's words (the words themselves are not compared): none that repeats is lost, and a false
alarm costs a row. A window that a document holds many times is one row of it, with all its places.

Windows estimated in `hot_docs` documents or more are summed up by each task before they are shuffled, and their least document
is looked up, for the most frequent ones by broadcast; all others have groups of fewer rows than that. The sketch grows with the text.
Up to two rows of `max_cells` cells, two bits a cell reach the driver and are broadcast. Beyond that there is a sketch of its own for each range of the
anchors' hash, and nothing of it leaves the tasks: the anchors, written once, are dealt to the ranges, meet the bits of theirs, and those that may repeat
go back to their texts. A range with many anchors, as one that a third of all documents hold, is dealt to several tasks, each with its bits.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT as HOT_KEYS
from .common import body, cut, fresh, lookup_join

RUN = 16
ROWS, BLOCK = 2, 1 << 16
#: A window in so many documents would weigh on one task; the ways of hot windows cost two shuffles.
HOT = 10_000
#: Cells that are counted in one range, at least, before its anchors are dealt to several tasks.
PART = 1 << 16
#: Characters that are hashed at once, words of a longer text's segment, and words that are remembered.
CHUNK, SEGMENT, CACHE = 1 << 20, 1 << 18, 400_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
MASK64 = (1 << 64) - 1


class _Words(dict):
    """A number for every word, and its 128-bit hashes by number."""

    def __init__(self):
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        self.digests += xxhash.xxh3_128_digest(word)
        self[word] = n = len(self)
        return n


_words = _Words()


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and of its inverse, modulo 2 ** 64."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            tables = []
            for b in (base, pow(base, -1, 1 << 64)):
                t = np.full(size, b, np.uint64)
                t[0] = 1
                tables.append(np.multiply.accumulate(t))
        _tables[base] = have = tuple(tables)
    return have


def _rolling(x: np.ndarray, base: int, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbours: their polynomial in the base, modulo 2 ** 64."""
    up, down = _powers(base, len(x) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)], dtype=np.uint64)])
    return (sums[width:] - sums[:-width]) * down[: len(x) - width + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _lows(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        g, have = np.minimum(g[:-have], g[have:]), have * 2
    return np.minimum(g[: len(g) - (width - have)], g[width - have :]) if width > have else g


def _windows(texts: list[bytes], window: int):
    """For the windows of several texts: number of the text, place in it, two hashes, anchor."""
    global _words
    if len(_words) > CACHE:
        _words = _Words()
    numbers, row, base, ends, total = [], [], [], [], 0
    for i, text in enumerate(texts):
        words = text.split()
        for at in range(0, max(1, len(words) - window + 1), SEGMENT - window + 1):
            part = words[at : at + SEGMENT]
            if len(part) < window:
                continue
            numbers.append(part)
            row.append(i)
            base.append(at - total)
            total += len(part)
            ends.append(total)
    if not numbers:
        return None
    code = np.fromiter(map(_words.__getitem__, chain.from_iterable(numbers)), np.int64, total)
    x = np.frombuffer(bytes(_words.digests), np.uint64).reshape(-1, 2)[code]
    h1, h2 = (_rolling(np.ascontiguousarray(x[:, k]), _BASES[k], window) for k in (0, 1))
    run = min(RUN, window)
    anchor = _lows(_mix(_rolling(np.ascontiguousarray(x[:, 0]), _BASES[1], run)), window - run + 1)
    sizes = np.diff([0, *ends])
    part = np.repeat(np.arange(len(row)), sizes)[: len(h1)]
    ok = np.arange(len(h1)) + window <= np.array(ends)[part]
    at = np.flatnonzero(ok)
    part = part[at]
    return np.array(row)[part], at + np.array(base)[part], h1[at], h2[at], anchor[at]


def _chunks(batch: pa.RecordBatch, text: int):
    """Parts of a batch, of CHUNK bytes or one text: first row, texts."""
    first, held, n = 0, [], 0
    for i, t in enumerate(batch.column(text).cast(pa.binary())):
        t = t.as_py()
        held.append(t)
        n += len(t)
        if n >= CHUNK:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def _cells(anchor: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of an anchor in each row; rows follow one another."""
    h = _mix(anchor ^ np.uint64(0x1234567))
    return [((h >> np.uint64(32 * r)) & np.uint64(cells - 1)).astype(np.int64) + r * cells for r in range(ROWS)]


def _cells_of_ranges(anchor: np.ndarray, ranges: int) -> list[np.ndarray]:
    """The same where each range of the hash has a block of its own, half of it for each row."""
    h = _mix(anchor ^ np.uint64(0x1234567))
    block, half = ((h >> np.uint64(30)) & np.uint64(ranges - 1)).astype(np.int64) << 16, np.uint64(BLOCK // ROWS - 1)
    return [block + ((h >> np.uint64(15 * r)) & half).astype(np.int64) + r * (BLOCK // ROWS) for r in range(ROWS)]


def _packed(places: list[np.ndarray]) -> pa.RecordBatch:
    """Counts of cells, a row for each block: places, counts, and their sum."""
    place, n = np.unique(np.concatenate(places), return_counts=True)
    block = place >> 16
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(starts[1:], len(block))
    low, few = (place & 0xFFFF).astype(np.uint16), np.minimum(n, 65535).astype(np.uint16)
    cut_up = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(block[starts]), cut_up(low), cut_up(few), pa.array(np.add.reduceat(n, starts))], ["block", "place", "n", "total"])


def _once_a_text(texts: list[bytes], window: int):
    """Anchors, each once a text, and their texts' numbers; None without any."""
    if (got := _windows(texts, window)) is None:
        return None
    row, _, _, _, anchor = got
    new = np.flatnonzero((np.diff(anchor, prepend=~anchor[0]) != 0) | (np.diff(row, prepend=-1) != 0))
    row, anchor = row[new], anchor[new]
    order = np.lexsort((anchor, row))
    row, anchor = row[order], anchor[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    return row[keep], anchor[keep]


def _count(cells: int, window: int):
    """The sketch of a task, block by block: places with counts."""

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for _, texts in _chunks(batch, 0):
                if (got := _once_a_text(texts, window)) is None:
                    continue
                found += _cells(got[1], cells)
                size += len(got[1])
                if size > 1 << 20:
                    yield _packed(found)
                    found, size = [], 0
        if found:
            yield _packed(found)

    return run


def _anchors(window: int):
    """id, tag, text -> id, tag, anchor, each anchor once a text."""

    def run(batches):
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, texts in _chunks(batch, 2):
                if (got := _once_a_text(texts, window)) is None:
                    continue
                row = first + got[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(tags[row]), pa.array(got[1].view(np.int64))], ["id", "tag", "anchor"])

    return run


def _count_ranges(ranges: int):
    """anchor -> the sketches of a task, range by range. An anchor that many rows hold is one entry."""

    def run(batches):
        found, size = [], 0
        for batch in batches:
            found += _cells_of_ranges(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), ranges)
            size += batch.num_rows
            if size > 1 << 20:
                yield _packed(found)
                found, size = [], 0
        if size:
            yield _packed(found)

    return run


def _merge(hot_docs: int):
    """Sorted by block; a block's bits for counts of two and of hot_docs, and the sum of its counts."""

    def closed(at, count, total):
        bits = [pa.array([np.packbits(count >= least).tobytes()], pa.binary()) for least in (2, hot_docs)]
        return pa.RecordBatch.from_arrays([pa.array([at]), *bits, pa.array([total])], ["block", "two", "hot", "total"])

    def run(batches):
        at, count, total = None, np.zeros(BLOCK), 0
        for batch in batches:
            for block, place, n, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if block != at:
                    if at is not None:
                        yield closed(at, count, total)
                    at, count, total = block, np.zeros(BLOCK), 0
                count[np.frombuffer(place, np.uint16)] += np.frombuffer(n, np.uint16)
                total += own
        if at is not None:
            yield closed(at, count, total)

    return run


def _merged(counted: DataFrame, parts: int | None, hot_docs: int) -> DataFrame:
    by_block = counted.repartition(parts, "block") if parts else counted.repartition("block")
    return by_block.sortWithinPartitions("block").mapInArrow(_merge(hot_docs), "block long, two binary, hot binary, total long")


def _all_set(bits: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    ok = np.ones(len(at[0]), bool)
    for c in at:
        ok &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _sketch(texts: DataFrame, cells: int, window: int, hot_docs: int):
    """Broadcast bits of the merged sketch, and whether a cell is hot. At most ROWS * cells / 4 bytes pass through the driver."""
    spark = texts.sparkSession
    parts = max(1, min(ROWS * cells // BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counted = texts.mapInArrow(_count(cells, window), "block long, place binary, n binary, total long")
    merged = _merged(counted, parts, hot_docs).drop("total")
    two, hot = bytearray(ROWS * cells // 8), bytearray(ROWS * cells // 8)
    for r in merged.collect():
        where = slice(r.block * BLOCK // 8, (r.block + 1) * BLOCK // 8)
        two[where], hot[where] = r.two, r.hot
    return spark.sparkContext.broadcast((bytes(two), bytes(hot))), any(hot)


def _meet(ranges: int):
    """Sorted by block and part, each one's bits first: of the anchors, those that may repeat, and whether they are hot."""

    def run(batches):
        two = hot = None
        for batch in batches:
            block, part = (batch.column(k).to_numpy() for k in (0, 1))
            starts = np.flatnonzero((np.diff(block, prepend=block[0] - 1) != 0) | (np.diff(part, prepend=part[0]) != 0)) if len(block) else []
            for a, b in zip(starts, [*starts[1:], len(block)]):
                if batch.column(5)[a].is_valid:
                    two, hot = (np.frombuffer(batch.column(k)[a].as_py(), np.uint8) for k in (5, 6))
                    a += 1
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                at = [c & (BLOCK - 1) for c in _cells_of_ranges(own.column(4).to_numpy().view(np.uint64), ranges)]
                may = pa.array(_all_set(two, at))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in (2, 3, 4)), pa.array(_all_set(hot, at))], ["id", "tag", "anchor", "hot"]).filter(may)

    return run


def _repeated_anchors(keyed: DataFrame, cells: int, window: int, hot_docs: int) -> DataFrame:
    """id, tag, anchor, hot of the anchors that may occur in several texts, by a sketch for each range of their hash; written."""
    ranges = ROWS * cells // BLOCK
    known = cut(keyed.mapInArrow(_anchors(window), "id long, tag long, anchor long"))
    bits = cut(_merged(known.select("anchor").mapInArrow(_count_ranges(ranges), "block long, place binary, n binary, total long"), None, hot_docs))
    floor = max(PART, ROWS * known.count() // HOT_KEYS)
    bits = bits.withColumn("parts", F.ceil(F.col("total") / floor).cast("int"))
    many = bits.filter("parts > 1").select("block", "parts")  # at most HOT_KEYS, by the sum of the totals

    @F.arrow_udf("long")
    def block_of(anchor: pa.Array) -> pa.Array:
        return pa.array(_cells_of_ranges(anchor.to_numpy().view(np.uint64), ranges)[0] >> 16)

    none = F.lit(None).cast("long")
    asked = known.withColumn("block", block_of("anchor")).join(F.broadcast(many), "block", "left")
    part = F.coalesce(F.pmod(F.xxhash64("id", "tag"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    asked = asked.select("block", part, "id", "tag", "anchor", F.lit(None).cast("binary").alias("two"), F.lit(None).cast("binary").alias("hot"))
    told = bits.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none.alias("id"), none.alias("tag"), none.alias("anchor"), "two", "hot")
    met = told.unionByName(asked).repartition("block", "part").sortWithinPartitions("block", "part", F.col("two").isNull())
    return cut(met.mapInArrow(_meet(ranges), "id long, tag long, anchor long, hot boolean"))


def _candidates(held, cells: int, window: int, wanted: bool):
    """id, tag, text -> the windows that may repeat, hot ones or the others as wanted, as _sent has them."""

    def start():
        two, hot = (np.frombuffer(b, np.uint8) for b in held.value)

        def chosen(anchor, batch, first, n):
            at = _cells(anchor, cells)
            return _all_set(two, at) & (_all_set(hot, at) == wanted)

        return chosen

    return _sent(start, window)


def _listed(window: int):
    """id, tag, text, anchors that may repeat -> their windows, as _sent has them. An anchor is listed for all texts with it or for none."""
    return _sent(lambda: lambda anchor, batch, first, n: np.isin(anchor, batch.column(3).slice(first, n).flatten().to_numpy().view(np.uint64)), window)


def _sent(start, window: int):
    """id, tag, text -> the windows whose anchors are chosen: h1, h2, id, place (the first one, with the tag), more
    (the other places of the same window in the text, 32 bits each; null without any)."""

    def once(row, h1, h2):
        """An order in which equal windows of a text stand together, by place, and where each one starts; None if none repeats."""
        if len(np.unique(_mix(h1 ^ (row.astype(np.uint64) * np.uint64(_BASES[0]))))) == len(row):
            return None
        order = np.lexsort((h2, h1, row))  # stable: places stay in order
        r, a, b = row[order], h1[order], h2[order]
        return order, np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))

    def run(batches):
        chosen = start()
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, texts in _chunks(batch, 2):
                if (got := _windows(texts, window)) is None:
                    continue
                row, place, h1, h2, anchor = got
                edge = np.flatnonzero(np.diff(anchor, prepend=~anchor[0]) != 0)
                run_of = np.cumsum(np.diff(anchor, prepend=~anchor[0]) != 0) - 1
                keep = np.flatnonzero(chosen(anchor[edge], batch, first, len(texts))[run_of])
                if not len(keep):
                    continue
                row, place, h1, h2 = first + row[keep], place[keep], h1[keep], h2[keep]
                more = pa.nulls(len(row), pa.binary())
                if (same := once(row, h1, h2)) is not None:
                    order, starts = same
                    places = place[order].astype(np.int32)
                    more = pa.array([places[a + 1 : b].tobytes() if b > a + 1 else None for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)])], pa.binary())
                    row, place, h1, h2 = (x[order[starts]] for x in (row, place, h1, h2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[row]), pa.array(tags[row] << 32 | place), more],
                    ["h1", "h2", "id", "place", "more"],
                )

    return run


#: A null id stands behind all others.
LAST = (1 << 63) - 1


def _keys(docs: DataFrame, id_col: str, text_col: str):
    """The id for comparison, and 31 bits of the text that tell rows with the same id apart."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.shiftrightunsigned(F.xxhash64(body(text_col)), 33)


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, max_cells: int = 1 << 26, hot_docs: int = HOT) -> DataFrame:
    """id, tag, starts, more: where windows start, in words, that also start in a row with a smaller id: as numbers, and 32 bits each."""
    wide, k, t = _wide(docs, id_col, text_col)
    return _places(wide, k, t, text_col, window, max_cells, hot_docs)


def _wide(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with id and tag for comparison, and these columns' names."""
    k, t = fresh(docs, "id_key", "tag_key")
    doc, tag = _keys(docs, id_col, text_col)
    return docs.withColumns({k: doc, t: tag}), k, t


def _places(wide: DataFrame, k: str, t: str, text_col: str, window: int, max_cells: int, hot_docs: int) -> DataFrame:
    chars = wide.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    cells = max(BLOCK, 1 << (chars // 40).bit_length())
    keyed = wide.select(F.col(k).alias("id"), F.col(t).alias("tag"), body(text_col).alias("text"))
    kind = "h1 long, h2 long, id long, place long, more binary"
    if cells <= max_cells:
        held, some_hot = _sketch(keyed.select("text"), cells, window, hot_docs)
        rows = lambda hot: keyed.mapInArrow(_candidates(held, cells, window, hot), kind)
    else:
        anchors = _repeated_anchors(keyed, cells, window, hot_docs)
        some_hot = not anchors.filter("hot").isEmpty()
        (listed,) = fresh(wide, "anchors")
        lists = lambda hot: anchors.filter(F.col("hot") == hot).groupBy(F.col("id").alias(k), F.col("tag").alias(t)).agg(F.collect_set("anchor").alias(listed))
        # all columns, so that this join and the one that takes words out of the texts share one exchange of the texts
        rows = lambda hot: wide.join(lists(hot), [k, t]).select(k, t, body(text_col), listed, *[c for c in wide.columns if c not in (k, t)]).mapInArrow(_listed(window), kind)
    places = rows(False).withColumn("first", F.min("id").over(Window.partitionBy("h1", "h2"))).filter("id > first").select("id", "place", "more")
    if some_hot:
        often = cut(rows(True))
        firsts = often.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        firsts = cut(firsts.filter("first < last").drop("last"))
        joined = lookup_join(often, firsts, ["h1", "h2"], "n", often.count())
        places = places.unionByName(joined.filter("id > first").select("id", "place", "more"))
    start = F.col("place").bitwiseAND((1 << 32) - 1).cast("int")
    return places.groupBy("id", F.shiftright("place", 32).alias("tag")).agg(F.collect_list(start).alias("starts"), F.collect_list("more").alias("more"))


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    starts = np.unique(starts)
    change[starts] += 1
    np.subtract.at(change, starts + window, 1)
    return np.cumsum(change[:n]) > 0


def _without(text: bytes, starts, more, window: int) -> tuple[list[bytes], int]:
    """Words that stay, and how many there were. starts, more: as Arrow scalars."""
    words = text.split()
    if not starts.is_valid:
        return words, len(words)
    every = np.concatenate([starts.values.to_numpy(), *(np.frombuffer(m.as_py(), np.int32) for m in more.values)])
    gone = _covered(len(words), every, window)
    return list(compress(words, (~gone).tolist())), len(words)


def _with_starts(docs: DataFrame, id_col: str, text_col: str, window: int, max_cells: int, hot_docs: int) -> tuple[DataFrame, str, str]:
    wide, k, t = _wide(docs, id_col, text_col)
    starts, more = fresh(wide, "starts", "more")
    found = _places(wide, k, t, text_col, window, max_cells, hot_docs).select(F.col("id").alias(k), F.col("tag").alias(t), F.col("starts").alias(starts), F.col("more").alias(more))
    return wide.join(found, [k, t], "left").drop(k, t), starts, more


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, max_cells: int = 1 << 26, hot_docs: int = HOT) -> DataFrame:
    """One row for each of docs: id_col, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    Null and empty texts have no words. A null id counts as the largest. Rows with the same id remove nothing from
    each other. Other columns are not read."""
    wide, starts, more = _with_starts(docs.select(id_col, text_col), id_col, text_col, window, max_cells, hot_docs)

    @F.arrow_udf("struct<n_words: bigint, n_removed: bigint, kept_sha256: string>")
    def digest(texts: pa.Array, starts: pa.Array, more: pa.Array) -> pa.Array:
        n, gone, sha = [], [], []
        for t, s, m in zip(texts.cast(pa.binary()), starts, more):
            words, had = _without(t.as_py(), s, m, window)
            n.append(had)
            gone.append(had - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["n_words", "n_removed", "kept_sha256"])

    return wide.select(F.col(id_col), digest(body(text_col), F.col(starts), F.col(more)).alias("d")).select(id_col, "d.*")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, max_cells: int = 1 << 26, hot_docs: int = HOT) -> DataFrame:
    """docs with the repeated passages taken out of the texts, whose words are then joined by one space; texts from which
    nothing is taken stay as they are. Columns as they are. Null texts stay null; a null id counts as the largest; rows with the same id
    take nothing from each other, so repeated rows stay alike; no rows give none."""
    wide, starts, more = _with_starts(docs, id_col, text_col, window, max_cells, hot_docs)

    @F.arrow_udf("string")
    def kept(texts: pa.Array, starts: pa.Array, more: pa.Array) -> pa.Array:
        rows = zip(texts.cast(pa.binary()), starts, more)
        return pa.array([b" ".join(_without(t.as_py(), s, m, window)[0]) if s.is_valid else t.as_py() for t, s, m in rows], pa.binary()).cast(pa.string())

    new = F.when(F.col(starts).isNull(), F.col(text_col)).otherwise(kept(body(text_col), F.col(starts), F.col(more)))
    return wide.withColumn(text_col, new).select(docs.columns)

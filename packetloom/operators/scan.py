"""Ordered computations along streams, in blocks.

A stream may hold a third of all rows, so a window over a whole stream would put them into one task. These
operators cut each stream's order column, a bigint, into blocks: of a fixed width, or, where values lie unevenly, of one width in each of a few hundred pieces between quantiles. Rows shuffle by
(stream, block); what a block must know of those before or behind it, its carry, comes from a table of one row a
block, summed before it is shuffled. One scan computes any number of things at once, so a step reads its input
twice, however much it computes; a step that depends on another's result reads that from a table (`settle`). The
result doesn't depend on the width.

`keys` may be empty: the table is then one stream, whose carries are summed in two levels. NULL is a key like any other. Ties in the
order column are broken by `ties`. A row whose order is NULL has no place along its stream: it stays, gets NULL, and
counts for no other row."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.timebase import floor_div

#: Rows of a block, blocks whose carries are summed by one task, and into how many blocks rows without a place are dealt.
ROWS, BLOCKS, NOWHERE = 1 << 16, 1 << 12, 1 << 20


@dataclass(frozen=True)
class Sum:
    """Of the earlier rows, 0 for the first; inclusive: the row's own too."""

    value: Column
    inclusive: bool = False


@dataclass(frozen=True)
class Max:
    """The greatest value of the earlier rows, NULL for the first; inclusive: the row's own too."""

    value: Column
    inclusive: bool = False


@dataclass(frozen=True)
class Last:
    """The last value that isn't NULL up to the row (inclusive) or before it."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Next:
    """The first value that isn't NULL from the row on (inclusive) or behind it."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class First:
    """The value of the stream's first row at which it isn't NULL."""

    value: Column


@dataclass(frozen=True)
class Top:
    """The greatest value in the whole stream."""

    value: Column


Step = Sum | Max | Last | Next | First | Top


@dataclass(frozen=True)
class Pieces:
    """Pieces of the order column: where each begins, but for the first, and the width of its blocks."""

    borders: tuple[int, ...]
    widths: tuple[int, ...]


Width = int | Pieces

#: Fractions of the rows between which widths may differ, with ever smaller ones at both ends; how exact they are; and how many times its rows a block may hold before widths differ.
QUANTILES = [*(2.0**-k for k in range(15, 7, -1)), *(k / 128 for k in range(1, 128)), *(1 - 2.0**-k for k in range(8, 16))]
ACCURACY, DENSE, SPAN = 50_000, 4, 1 << 44


def width_for(df: DataFrame, order: str, rows: int = ROWS) -> Width:
    """The width at which a block, all rows one stream, has some `rows` rows: an aggregate of one column. A far value would make the width
    that is right on the whole far too large for all others; then each piece between quantiles gets a width of its own."""
    marks = F.percentile_approx(order, QUANTILES, ACCURACY)
    r = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(order).alias("n"), marks.alias("marks")).first()
    if not r.n:
        return 1
    whole = max(1, (r.high - r.low + 1) * rows // r.n)
    at, share = [r.low], [0.0]
    for x, q in zip([*r.marks, r.high + 1], [*QUANTILES, 1.0]):  # pieces end where values do
        if x > at[-1]:
            at.append(x)
            share.append(q)
        else:
            share[-1] = q
    widths = [max(1, min(1 << 62, int((b - a) * rows / max(1.0, (q - p) * r.n)))) for a, b, p, q in zip(at, at[1:], share, share[1:])]
    spans = list(zip(at, at[1:], ((q - p) * r.n for p, q in zip(share, share[1:]))))
    densest = max((sum(n * min(1.0, (a + whole - x) / (y - x)) for x, y, n in spans if a <= x < a + whole) for a, _, _ in spans), default=0)
    if densest <= DENSE * rows:  # no block of one width would hold much more than it should
        return whole
    return Pieces(tuple(at[1:-1]), tuple(widths))


def block_of(order: Column, width: Width) -> Column:
    """The number of the block; it rises with the order. Among pieces it is found by binary search, a batch at a time."""
    if isinstance(width, int):
        return floor_div(order, width)
    borders, widths = np.array(width.borders, np.int64), np.array(width.widths, np.int64)
    starts = np.append(borders[:1], borders)  # the first piece is counted back from its end

    @F.arrow_udf("long")
    def of(values: pa.Array) -> pa.Array:
        x = values.fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.searchsorted(borders, x, "right")
        inside = np.minimum((x - starts[piece]) // widths[piece], SPAN - 1)
        return pa.array(piece * SPAN + np.maximum(inside, np.where(piece > 0, 0, -SPAN)), pa.int64())

    return of(order.cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share; only where it is unset, one in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: what follows doesn't compute it anew. The folder is the caller's to clear."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Blocks:
    """df with a block column; windows in a block, and over blocks."""

    block = "__block"

    def __init__(self, df: DataFrame, keys: Sequence[str], order: str, width: Width, ties: Sequence[str] = ()):
        self.keys, self.order, self.ties = list(keys), order, list(ties)
        flat = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        nowhere = F.lit(-(1 << 62)) + F.pmod(F.xxhash64(*flat), F.lit(NOWHERE))
        self.df = df.withColumn(self.block, F.when(F.col(order).isNotNull(), block_of(F.col(order), width)).otherwise(nowhere))
        self.by = []
        for i, k in enumerate(keys):  # NULL meets NULL, and joins and windows share one shuffle
            kind = df.schema[k].dataType
            named = {f"__k{i}": F.struct(k)}  # in a struct, NULL equals NULL
            if isinstance(kind, T.IntegralType | T.StringType):
                named = {f"__k{i}": F.coalesce(k, F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)), f"__n{i}": F.isnull(k)}
            self.df = self.df.withColumns(named)
            self.by += named

    def local(self, first: int | None = None, last: int | None = None, also: Sequence[str] = ()) -> WindowSpec:
        spec = Window.partitionBy(*self.by, self.block, *also).orderBy(self.order, *self.ties)
        return spec.rowsBetween(Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)

    def over(self, by: Sequence[str], order: str, behind: bool = False) -> WindowSpec:
        spec = Window.partitionBy(*by).orderBy(order)
        return spec.rowsBetween(1, Window.unboundedFollowing) if behind else spec.rowsBetween(Window.unboundedPreceding, -1)

    def key(self) -> Column:
        return F.struct(self.order, *self.ties)

    def placed(self, value: Column) -> Column:
        """The value, NULL where the row has no place."""
        return F.when(F.col(self.order).isNotNull(), value)


def _total(step: Step, v: str, key: Column) -> Column:
    if isinstance(step, Sum):
        return F.sum(v)
    if isinstance(step, Max | Top):
        return F.max(v)
    return (F.max_by if isinstance(step, Last) else F.min_by)(v, F.when(F.col(v).isNotNull(), key))


def _carry(step: Step, s: str, b: Blocks, by: Sequence[str], order: str) -> Column:
    """Of the totals s before the block, or behind it, or of all."""
    if isinstance(step, Sum):
        return F.sum(s).over(b.over(by, order))
    if isinstance(step, Max):
        return F.max(s).over(b.over(by, order))
    if isinstance(step, Last):
        return F.last(s, True).over(b.over(by, order))
    if isinstance(step, Next):
        return F.first(s, True).over(b.over(by, order, behind=True))
    every = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (F.max(s) if isinstance(step, Top) else F.first(s, True)).over(every)


def _combined(step: Step, far: Column, near: Column) -> Column:
    """What is carried from other groups of blocks, and from blocks of the same group."""
    if isinstance(step, Sum):
        return F.coalesce(far, F.lit(0)) + F.coalesce(near, F.lit(0))
    if isinstance(step, Max | Top):
        return F.greatest(far, near)
    return F.coalesce(far, near) if isinstance(step, First) else F.coalesce(near, far)


def run(df: DataFrame, keys: Sequence[str], order: str, steps: dict[str, Step], width: Width | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """df with a column for each step, all from one pass."""
    b = Blocks(df.withColumns({f"__v_{n}": s.value for n, s in steps.items()}), keys, order, width or width_for(df, order), ties)
    rows = b.df.withColumns({f"__v_{n}": b.placed(F.col(f"__v_{n}")) for n in steps})
    on = [*b.by, b.block]
    totals = rows.groupBy(*on).agg(*[_total(s, f"__v_{n}", b.key()).alias(f"__s_{n}") for n, s in steps.items()])
    if keys:
        carried = totals.select(*on, *[_carry(s, f"__s_{n}", b, b.by, b.block).alias(f"__c_{n}") for n, s in steps.items()])
    else:  # no task sees all blocks: groups of blocks first
        totals = totals.withColumn("__group", floor_div(b.block, BLOCKS))
        groups = totals.groupBy("__group").agg(*[_total(s, f"__s_{n}", F.col(b.block)).alias(f"__g_{n}") for n, s in steps.items()])
        groups = groups.select("__group", *[_carry(s, f"__g_{n}", b, [], "__group").alias(f"__g_{n}") for n, s in steps.items()])  # a row for BLOCKS blocks
        near = totals.select("__group", b.block, *[_carry(s, f"__s_{n}", b, ["__group"], b.block).alias(f"__c_{n}") for n, s in steps.items()])
        carried = near.join(groups, "__group").select(b.block, *[_combined(s, F.col(f"__g_{n}"), F.col(f"__c_{n}")).alias(f"__c_{n}") for n, s in steps.items()])
    rows = rows.join(carried, on)
    new = {}
    for n, s in steps.items():
        v, c = f"__v_{n}", F.col(f"__c_{n}")
        own = 0 if getattr(s, "inclusive", False) else -1
        if isinstance(s, Sum):
            got = F.coalesce(c, F.lit(0)) + F.coalesce(F.sum(v).over(b.local(None, own)), F.lit(0))
        elif isinstance(s, Max):
            got = F.greatest(c, F.max(v).over(b.local(None, own)))
        elif isinstance(s, Last):
            got = F.coalesce(F.last(v, True).over(b.local(None, own)), c)
        elif isinstance(s, Next):
            got = F.coalesce(F.first(v, True).over(b.local(-own, None)), c)
        else:
            got = c
        new[n] = b.placed(got)
    return rows.withColumns(new).drop(*on, *[f"__{x}_{n}" for x in "vc" for n in steps])


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, width: Width | None = None, ties: Sequence[str] = (), inclusive: bool = False) -> DataFrame:
    """`name`: the sum of `value` over the earlier rows of the stream, 0 for the first; inclusive: the row's own too."""
    return run(df, keys, order, {name: Sum(value, inclusive)}, width, ties)


def row_number(df: DataFrame, keys: Sequence[str], order: str, name: str, width: Width | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """`name`: 0 for the first row of the stream, and so on."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name, width, ties)


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, width: Width | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """`name`: the greatest `value` of the earlier rows of the stream, NULL for the first."""
    return run(df, keys, order, {name: Max(value)}, width, ties)


def last_known(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], width: Width | None = None, ties: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """For each name, the last value that isn't NULL up to the row (inclusive) or before it."""
    return run(df, keys, order, {k: Last(v, inclusive) for k, v in values.items()}, width, ties)


def next_known(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], width: Width | None = None, ties: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """For each name, the first value that isn't NULL from the row on (inclusive) or behind it."""
    return run(df, keys, order, {k: Next(v, inclusive) for k, v in values.items()}, width, ties)


def lag(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], width: Width | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """For each name, the value of the row before, NULL for the stream's first."""
    out = last_known(df, keys, order, {k: F.struct(v.alias("v")) for k, v in values.items()}, width, ties, inclusive=False)
    return out.withColumns({k: F.col(k)["v"] for k in values})


def lead(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], width: Width | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """For each name, the value of the row behind, NULL for the stream's last."""
    out = next_known(df, keys, order, {k: F.struct(v.alias("v")) for k, v in values.items()}, width, ties, inclusive=False)
    return out.withColumns({k: F.col(k)["v"] for k in values})


def as_of(
    probes: DataFrame, facts: DataFrame, keys: Sequence[str], probe_time: str, fact_time: str, take: Sequence[str], width: Width | None = None,
    strict: bool = False, forward: bool = False, ties: Sequence[str] = (), first: str | None = None,
) -> DataFrame:
    """Left join of each probe with the last fact at or before its time (strict: before), or, forward, the first at or
    after it. Both are one ordered stream, so no probe meets more than one fact. `ties` orders facts of the same time.
    The fact columns `take` are NULL where there is none, and for a probe whose time or one of whose keys is NULL. `first` names a
    struct of the same columns of the stream's first fact, whose time may be later."""
    width = width or width_for(facts, fact_time)
    probes_first = strict != forward  # among equal times: facts then don't count backwards, and do forwards
    order = [f"__o_{c}" for c in ties]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    p = probes.select(
        F.struct(*probes.columns).alias("__p"),
        *keys,
        F.when(known, F.col(probe_time).cast("long")).alias("__t"),
        F.lit(0 if probes_first else 1).alias("__side"),
        *[F.lit(None).cast(facts.schema[c].dataType).alias(o) for c, o in zip(ties, order)],
        F.lit(None).cast(facts.select(F.struct(*take)).schema[0].dataType).alias("__f"),
    )
    f = facts.filter(known & F.col(fact_time).isNotNull()).select(
        F.lit(None).cast(p.schema["__p"].dataType).alias("__p"),
        *keys,
        F.col(fact_time).cast("long").alias("__t"),
        F.lit(1 if probes_first else 0).alias("__side"),
        *[F.col(c).alias(o) for c, o in zip(ties, order)],
        F.struct(*take).alias("__f"),
    )
    steps: dict[str, Step] = {"__got": (Next if forward else Last)(F.col("__f"))}
    if first:
        steps["__first"] = First(F.col("__f"))
    both = run(p.unionByName(f), keys, "__t", steps, width, ["__side", *order])
    also = [F.col("__first").alias(first)] if first else []
    return both.filter(F.col("__p").isNotNull()).select("__p.*", *[F.col("__got")[c].alias(c) for c in take], *also)

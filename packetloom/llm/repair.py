"""Conversation structure repair by generalised LR parsing.

A conversation's roles must follow a grammar: nothing, or perhaps a system turn and then user and assistant by turns. What it says instead is repaired
by the cheapest edits: keep a turn (0), give it another role (2), delete it (3; the only way for blank and repeated turns), insert an empty
turn before it (2); a truncated turn that stays costs 1 more. Of equally cheap repairs the one whose audit, the initials of its edits in order, is least in ASCII is
taken.

SLR tables are built from the grammar. All repairs are followed at once: stacks share what lies below (a graph-structured stack), every row tries all edits on every
stack top, and of stacks with equal tops the one with the least (cost, audit) goes on. That loses nothing, because what this grammar allows next depends on the top alone (a test
compares with all repairs), and of two audits of the same rows and cost none starts with the other: every row ends the insertions before it with its own K, R
or D. So audits are compared by their rank among the tops before and the newest token, and are written only once, backwards along the best path.

A conversation of up to ROWS rows and BYTES bytes is one piece, repaired by one task. Longer ones are cut into pieces by their order; each piece is repaired from every stack top
it may begin with, a small table of (top, top, cost, audit) a piece is combined along the conversation, and then each piece is repaired from the top it does begin with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, cut, lookup_join

#: Start symbol first. Terminals are the initials of roles.
GRAMMAR = [("start", ("chat",)), ("chat", ()), ("chat", ("talk",)), ("talk", ("s", "turns")), ("talk", ("turns",)), ("turns", ("turns", "u", "a")), ("turns", ("u", "a"))]
ROLES = {"u": "user", "a": "assistant"}
END = "$"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Insertions before one row: two lead from any stack top to all that can be of use.
INSERTED = 2
BLANK = " \t\n\v\f\r"
ROWS, BYTES = 1 << 14, 64 << 20
#: Characters of repaired turns that a task hands on at once.
BATCH = 4 << 20


class Tables:
    """SLR tables: shifts, reductions by lookahead, and where to go on after one. More than one action in a cell is no fault."""

    def __init__(self, rules: list[tuple[str, tuple[str, ...]]]):
        self.rules = rules
        names = {left for left, _ in rules}
        first: dict[str, set] = {n: set() for n in names}
        follow: dict[str, set] = {n: set() for n in names}
        follow[rules[0][0]].add(END)
        empty: set[str] = set()
        while True:
            before = len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))
            for left, right in rules:
                if all(x in empty for x in right):
                    empty.add(left)
                for x in right:
                    first[left] |= first[x] if x in names else {x}
                    if x not in empty:
                        break
                after = set(follow[left])
                for x in reversed(right):
                    if x in names:
                        follow[x] |= after
                        after = first[x] | (after if x in empty else set())
                    else:
                        after = {x}
            if before == (len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))):
                break
        self.states = [self._closure({(0, 0)}, names)]
        self.goto: list[dict[str, int]] = []
        for state in self.states:  # grows meanwhile
            by: dict[str, set] = {}
            for rule, dot in state:
                if dot < len(rules[rule][1]):
                    by.setdefault(rules[rule][1][dot], set()).add((rule, dot + 1))
            moves = {}
            for x, kernel in sorted(by.items()):
                to = self._closure(kernel, names)
                if to not in self.states:
                    self.states.append(to)
                moves[x] = self.states.index(to)
            self.goto.append(moves)
        self.reduce = [{x: [r for r, dot in sorted(s) if dot == len(rules[r][1]) and x in follow[rules[r][0]]] for x in {*follow[rules[0][0]], *(t for f in follow.values() for t in f)}} for s in self.states]

    def _closure(self, items: set, names: set) -> frozenset:
        out, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            if dot < len(right) and right[dot] in names:
                for r, (left, _) in enumerate(self.rules):
                    if left == right[dot] and (r, 0) not in out:
                        out.add((r, 0))
                        todo.append((r, 0))
        return frozenset(out)


@dataclass(eq=False)
class Stack:
    """A stack: its top and the stack below, which others share."""

    top: int
    below: Stack | None
    above: dict[int, Stack] = field(default_factory=dict)

    def push(self, state: int) -> Stack:
        if state not in self.above:
            self.above[state] = Stack(state, self)
        return self.above[state]


@dataclass(frozen=True)
class Kind:
    """What a row allows: may it stay, is it truncated, and its role's initial."""

    stays: bool
    truncated: bool
    initial: str


class Repair:
    """Repairs of rows, from any stack top to all others."""

    def __init__(self, grammar=None):
        self.tables = Tables(grammar or GRAMMAR)
        self.bottom = Stack(0, None)
        self._arcs: dict[tuple[int, Kind | None], list] = {}
        self.stacks = {0: self.bottom}  # one for each top
        todo = [self.bottom]
        while todo:
            stack = todo.pop()
            for x in {t for moves in self.tables.goto for t in moves if len(t) == 1}:
                for more in self.advance(stack, x):
                    if more.top not in self.stacks:
                        self.stacks[more.top] = more
                        todo.append(more)

    def advance(self, stack: Stack, x: str) -> list[Stack]:
        """The stacks after a terminal: reductions that x allows, then the shift."""
        out, todo = [], [stack]
        while todo:
            at = todo.pop()
            if x == END and at.top == self.tables.goto[0].get(self.tables.rules[0][1][0]):
                return [at]
            if x in self.tables.goto[at.top]:
                out.append(at.push(self.tables.goto[at.top][x]))
            for rule in self.tables.reduce[at.top].get(x, ()):
                left, right = self.tables.rules[rule]
                base = at
                for _ in right:
                    base = base.below
                if left in self.tables.goto[base.top]:
                    todo.append(base.push(self.tables.goto[base.top][left]))
        return out

    def arcs(self, top: int, kind: Kind | None) -> list[tuple[int, int, str, str]]:
        """(next top, cost, token, initials of the turns put out), the best for each next top; kind None: the end."""
        if (known := self._arcs.get((top, kind))) is not None:
            return known
        best: dict[int, tuple] = {}

        def take(stack: Stack, cost: int, token: str, put: str) -> None:
            if stack.top not in best or (cost, token) < best[stack.top][1:3]:
                best[stack.top] = (stack.top, cost, token, put)

        ways = [(self.stacks[top], 0, "")]
        for stack, n, put in ways:  # grows meanwhile
            if kind is None:
                for end in self.advance(stack, END):
                    take(end, n * INSERT, "I" * n, put)
            else:
                take(stack, n * INSERT + DELETE, "I" * n + "D", put)
                extra = n * INSERT + TRUNCATED * kind.truncated
                for x in ("s", *ROLES) if kind.stays else ():
                    for to in self.advance(stack, x):
                        if x == kind.initial:
                            take(to, extra, "I" * n + "K", put + x)
                        if x in ROLES:
                            take(to, extra + REROLE, "I" * n + "R", put + x)
            if n < INSERTED:
                ways += [(to, n + 1, put + x) for x in ROLES for to in self.advance(stack, x)]
        self._arcs[top, kind] = list(best.values())
        return self._arcs[top, kind]

    def follow(self, kinds: Iterable[Kind | None], top: int = 0) -> tuple[dict[int, int], list[dict]]:
        """Costs by the top they lead to, and the way there: by row, for each top, the top before, the token and what it puts out."""
        costs, rank, way = {top: 0}, {top: 0}, []
        for kind in kinds:
            new: dict[int, tuple] = {}
            for at, cost in costs.items():
                for to, more, token, put in self.arcs(at, kind):
                    if to not in new or (cost + more, rank[at], token) < new[to][:3]:
                        new[to] = (cost + more, rank[at], token, at, put)
            order = sorted({v[1:3] for v in new.values()})
            costs, rank = {k: v[0] for k, v in new.items()}, {k: order.index(v[1:3]) for k, v in new.items()}
            way.append({k: (v[3], v[2], v[4]) for k, v in new.items()})
        return costs, way

    @staticmethod
    def path(way: list[dict], to: int) -> list[tuple[str, str]]:
        """(token, what it puts out) of each row on the best way to a top."""
        out = []
        for step in reversed(way):
            to, token, put = step[to]
            out.append((token, put))
        return out[::-1]


def initial(role: str) -> str:
    return role[:1]


@dataclass
class Piece:
    """The rows of a piece in order, with what is wrong with them."""

    rows: list[tuple[str, str]]
    kinds: list[Kind]
    counts: dict[str, int]
    turns: list[int]

    @classmethod
    def of(cls, rows: Iterable[tuple]) -> Piece:
        """rows: (turn, role, text, times, seen before, or None: to be found out)."""
        out, kinds, n, turns, seen = [], [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, [], set()
        for turn, role, text, times, again in rows:
            if turn is not None and times and (not turns or turns[-1] != turn):
                turns.append(turn)
            for k in range(times):
                end = text.rstrip(BLANK)[-1:]
                repeated = k > 0 or ((role, text) in seen if again is None else again)
                if again is None:
                    seen.add((role, text))
                fault = "blank" if not end else "duplicate" if repeated else "truncated" if end not in ".!?" else None
                if fault:
                    n[fault] += 1
                if out and initial(out[-1][0]) + initial(role) not in ("su", "ua", "au"):
                    n["illegal"] += 1
                out.append((role, text))
                kinds.append(Kind(fault not in ("blank", "duplicate"), fault == "truncated", initial(role)))
        return cls(out, kinds, n, turns)

    def lines(self, path: list[tuple[str, str]]) -> list[dict]:
        """Every edit: its initial, and the role and text of the turn it leaves, null if it leaves none."""
        out = []
        for k, (token, put) in enumerate(path):
            put = iter(put)
            for edit in token:
                if edit == "D":
                    out.append({"edit": edit, "role": None, "text": None})
                    continue
                x = next(put)
                role, text = self.rows[k] if edit != "I" else ("", "")
                out.append({"edit": edit, "role": role if edit == "K" else ROLES[x], "text": text})
        return out


LINES = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _report(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("conv", kind), ("piece", pa.int32()), ("pieces", pa.int32()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("lines", LINES)])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with equal first columns."""
    now, own = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if own and row[:keys] != now:
                yield now, own
                own = []
            now = row[:keys]
            own.append(row[keys:])
    if own:
        yield now, own


def _sent(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(100 + len(x["text"] or "") for x in row.get("lines", ()))
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _gaps(first, last, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _whole(kind: pa.DataType):
    """Conversations of one piece."""
    schema = _report(kind)

    def run(batches):
        engine = Repair()

        def reports():
            for (conv,), rows in _runs(batches, 1):
                p = Piece.of(r + (None,) for r in rows)
                costs, way = engine.follow([*p.kinds, None])
                (end, cost), = costs.items()
                path = engine.path(way, end)
                gaps = _gaps(min(p.turns, default=None), max(p.turns, default=None), len(p.turns))
                yield {"conv": conv, "piece": 0, "pieces": 1, "gaps": gaps, **p.counts, "cost": cost, "audit": "".join(t for t, _ in path), "lines": p.lines(path)}

        yield from _sent(reports(), schema)

    return run


def _transfers(kind: pa.DataType):
    """For each piece of a long conversation: costs and audits between stack tops, and what its borders have."""
    arc = pa.list_(pa.struct([("top", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([("conv", kind), ("piece", pa.int32()), ("turns", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("arcs", arc)])

    def run(batches):
        engine = Repair()

        def pieces():
            for (conv, piece), rows in _runs(batches, 2):
                p = Piece.of(rows)
                arcs = []
                for top in engine.stacks:
                    costs, way = engine.follow(p.kinds, top)
                    arcs += [{"top": top, "to": to, "cost": c, "audit": "".join(t for t, _ in engine.path(way, to))} for to, c in costs.items()]
                edge = lambda k: initial(p.rows[k][0]) if p.rows else None
                yield {"conv": conv, "piece": piece, "turns": len(p.turns), "first": p.turns[0] if p.turns else None, "last": p.turns[-1] if p.turns else None, "head": edge(0), "tail": edge(-1), "arcs": arcs}

        for row in pieces():
            yield pa.RecordBatch.from_pylist([row], schema)

    return run


def _joined(kind: pa.DataType):
    """The stack tops between which each piece of a conversation goes, its gaps (all at the first piece) and whether its first pair of roles is illegal."""
    schema = pa.schema([("conv", kind), ("piece", pa.int32()), ("top", pa.int32()), ("to", pa.int32()), ("ends", pa.bool_()), ("pieces", pa.int32()), ("gaps", pa.int64()), ("border", pa.int64())])

    def run(batches):
        engine = Repair()

        def conversation(conv, pieces):
            costs, rank, way = {0: 0}, {0: 0}, []
            turns, first, last, tail, borders = 0, None, None, None, []
            for _, n, lo, hi, head, end, arcs in pieces:
                new: dict[int, tuple] = {}
                for a in arcs:
                    if a["top"] in costs:
                        v = (costs[a["top"]] + a["cost"], rank[a["top"]], a["audit"], a["top"])
                        if a["to"] not in new or v[:3] < new[a["to"]][:3]:
                            new[a["to"]] = v
                order = sorted({v[1:3] for v in new.values()})
                costs, rank = {k: v[0] for k, v in new.items()}, {k: order.index(v[1:3]) for k, v in new.items()}
                way.append({k: v[3] for k, v in new.items()})
                turns += n - (n > 0 and lo == last)
                first, last = lo if first is None else first, last if hi is None else hi
                borders.append(int(tail is not None and head is not None and tail + head not in ("su", "ua", "au")))
                tail = tail if end is None else end
            ends = [(cost + more, rank[at], token, at) for at, cost in costs.items() for _, more, token, _ in engine.arcs(at, None)]
            to = min(ends)[3]
            tops = []
            for step in reversed(way):
                tops.append((step[to], to))
                to = step[to]
            gaps = _gaps(first, last, turns)
            for k, (p, (top, to), border) in enumerate(zip(pieces, tops[::-1], borders)):
                yield {"conv": conv, "piece": p[0], "top": top, "to": to, "ends": k == len(pieces) - 1, "pieces": len(pieces), "gaps": gaps if k == 0 else 0, "border": border}

        yield from _sent((row for (conv,), pieces in _runs(batches, 1) for row in conversation(conv, pieces)), schema)

    return run


def _rendered(kind: pa.DataType):
    schema = _report(kind)

    def run(batches):
        engine = Repair()
        for (conv, piece, top, to, ends, pieces, gaps, border), rows in _runs(batches, 8):
            p = Piece.of(rows)
            costs, way = engine.follow([*p.kinds, None] if ends else p.kinds, top)
            if ends:
                (to, _), = costs.items()
            path = engine.path(way, to)
            p.counts["illegal"] += border
            yield pa.RecordBatch.from_pylist([{"conv": conv, "piece": piece, "pieces": pieces, "gaps": gaps, **p.counts, "cost": costs[to], "audit": "".join(t for t, _ in path), "lines": p.lines(path)}], schema)

    return run


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times_col: str | None = None, max_rows: int = ROWS, max_bytes: int = BYTES
) -> DataFrame:
    """The repaired conversations: conv_col, piece (in order; 0 for a conversation of one piece), pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, lines. Numbers of
    the pieces of a conversation add up to its own, and audits and lines follow each other. lines has every edit, with the role and text of the
    turn that it leaves.

    Rows follow their turns, nulls first, then role and text; rows that are alike are repeats of each other. Null roles and texts are one blank. A null conv_col is
    a conversation of its own. times_col: how often a row occurs; a conversation whose rows all occur 0 times has an empty repair. Other columns are not read. An empty table gives no row."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = rows.sparkSession, rows.schema[conv_col].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"),
        (F.col(times_col).cast("int") if times_col else F.lit(1)).alias("times"),
    )
    report = f"conv {name}, piece int, pieces int, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, lines array<struct<edit string, role string, text string>>"
    sizes = plain.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = cut(sizes.filter((F.col("n") > max_rows) | (F.col("bytes") > max_bytes)).select(F.col("conv").alias("own"), "n"))
    total = long.agg(F.sum("n")).first()[0]
    same = F.col("conv").eqNullSafe(F.col("own"))
    short = plain.join(long, same, "left_anti") if total else plain
    order = ["turn", "role", "text"]
    out = short.repartition("conv").sortWithinPartitions("conv", *order).select("conv", "turn", "role", "text", "times").mapInArrow(_whole(arrow), report)
    if total:
        marked = plain.join(long, same, "left_semi").withColumns({"rid": F.monotonically_increasing_id(), "key": F.struct("conv", "role", "text")})
        marked = cut(marked)
        place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), F.col("rid").alias("rid"))
        first = marked.filter("times > 0").groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("weight"))
        seen = lookup_join(marked.filter("times > 0"), first, "key", "weight", total).withColumn("again", place != F.col("first"))
        placed = seen.select("conv", "turn", "role", "text", "times", "again", "rid").repartitionByRange(max(2, -(-total // max_rows)), "conv", *order, "rid")
        placed = cut(placed.withColumn("piece", F.spark_partition_id()))
        sort = ["conv", "piece", *order, "rid"]
        pieces = placed.repartition("conv", "piece").sortWithinPartitions(*sort).select("conv", "piece", "turn", "role", "text", "times", "again")
        table = f"conv {name}, piece int, turns long, first long, last long, head string, tail string, arcs array<struct<top int, to int, cost long, audit string>>"
        moves = pieces.mapInArrow(_transfers(arrow), table)
        tops = f"conv {name}, piece int, top int, to int, ends boolean, pieces int, gaps long, border long"
        chosen = cut(moves.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_joined(arrow), tops))  # a row a piece
        renamed = chosen.withColumnsRenamed({"conv": "own", "piece": "part"})
        asked = placed.join(renamed, same & (F.col("piece") == F.col("part")))
        asked = asked.repartition("conv", "piece").sortWithinPartitions(*sort)
        done = asked.select("conv", "piece", "top", "to", "ends", "pieces", "gaps", "border", "turn", "role", "text", "times", "again").mapInArrow(_rendered(arrow), report)
        absent = long.join(placed.select("conv").distinct(), same, "left_anti").select(F.col("own").alias("conv"))  # long ones without a row that occurs
        zero = {"piece": F.lit(0), "pieces": F.lit(1), **{c: F.lit(0).cast("long") for c in COUNTS}, "audit": F.lit(""), "lines": F.array().cast("array<struct<edit string, role string, text string>>")}
        out = out.unionByName(done).unionByName(absent.withColumns(zero))
    return out.withColumnRenamed("conv", conv_col)


def _streamed(kind: pa.DataType):
    """Digests of conversations of several pieces: a piece at a time, so only the audit grows."""
    schema = pa.schema([("conv", kind), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        now, state = None, None

        def closed():
            return pa.RecordBatch.from_pylist([{"conv": now, **dict(zip(COUNTS, state[0])), "audit": "".join(state[1]), "repaired_sha256": state[2].hexdigest()}], schema)

        for batch in batches:
            for conv, _, *counts, audit, text in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    if state is not None:
                        yield closed()
                    now, state = conv, [[0] * len(COUNTS), [], hashlib.sha256(), False]
                state[0] = [a + b for a, b in zip(state[0], counts)]
                state[1].append(audit)
                if text is not None:
                    state[2].update((("\n" if state[3] else "") + text).encode())
                    state[3] = True
        if state is not None:
            yield closed()

    return run


def digest(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation of repair(): conv_col, the counts, cost, audit, and repaired_sha256, the SHA-256 of `role:text` of the turns that
    are left, joined by newlines. An empty table gives no row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = repaired.schema[conv_col].dataType
    left = F.filter("lines", lambda x: x["edit"] != "D")
    text = F.array_join(F.transform(left, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    own = repaired.withColumnRenamed(conv_col, "conv").withColumn("text", F.when(F.size(left) > 0, text))
    single = own.filter("pieces = 1").select("conv", *COUNTS, "audit", F.sha2(body("text"), 256).alias("repaired_sha256"))
    several = own.filter("pieces > 1").repartition("conv").sortWithinPartitions("conv", "piece").select("conv", "piece", *COUNTS, "audit", "text")
    schema = f"conv {kind.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return single.unionByName(several.mapInArrow(_streamed(to_arrow_type(kind)), schema)).withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """rows with planted faults, for tests: crc32(`conv:turn`) modulo 20 says which rows go (0; times 0), lose their text (1) or its full stops, exclamation and
    question marks (2), come twice (3; times 2) or are given the role user (4). Nulls are one blank; the columns are conv_col, turn_col, role_col, text_col and times."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    when = lambda k, value, other: F.when(what == k, value).otherwise(other)
    text: Column = when(1, F.lit(""), when(2, F.regexp_replace(blank(text_col), "[.!?]", ""), blank(text_col)))
    return rows.select(
        conv_col, turn_col, when(4, F.lit("user"), blank(role_col)).alias(role_col), text.alias(text_col), when(0, F.lit(0), when(3, F.lit(2), F.lit(1))).alias("times")
    )

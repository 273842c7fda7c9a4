"""Conversation repair against every edit script, and conversations in pieces against whole ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from packetloom.llm import repair
from packetloom.llm.common import table

from ..conftest import SMALLEST

BLANK = " \t\n\v\f\r"


def scripts(n):
    """Every edit script of n rows with up to two insertions at a place."""
    ins = ["", "I", "II"]
    for edits in itertools.product("KRD", repeat=n):
        for gaps in itertools.product(ins, repeat=n + 1):
            yield "".join(g + e for g, e in zip(gaps, (*edits, "")))


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        t = text.strip(BLANK)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "" if t[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """rows: (turn, role, text) in order. Returns cost, audit and the text that is left."""
    faults, best = plain_faults(rows), None
    for audit in scripts(len(rows)):
        k, cost, kinds = 0, 0, []
        for e in audit:
            if e == "I":
                kinds.append(("I", "?", ""))
                cost += 2
                continue
            _, role, text = rows[k]
            bad = faults[k] in ("blank", "duplicate")
            if e == "D":
                cost += 3
            else:
                if bad:
                    break
                cost += (faults[k] == "truncated") + 2 * (e == "R")
                kinds.append((e, role, text))
            k += 1
        else:
            n = len(kinds)
            want = "s" * (n % 2) + "ua" * (n // 2)
            if n == 1 or any(e == "K" and role[:1] != x or e != "K" and x == "s" for (e, role, _), x in zip(kinds, want)):
                continue
            lines = [f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[x]}:{text}" for (e, role, text), x in zip(kinds, want)]
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, "\n".join(lines))
    return best


def plain_digest(rows):
    """conv_id -> what op11 returns of rows (conv, turn, role, text, times)."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, n in rows if c == conv for _ in range(n)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        faults = plain_faults(own)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, text = plain_repair(own)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def got_of(df):
    rows = df.collect()
    out = {r[0]: tuple(r[c] for c in (*repair.COUNTS, "audit", "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, times int, audit string, lines string, piece int"


def random_rows(rng, convs, most):
    rows = []
    for conv in convs:
        for _ in range(rng.randint(0, most)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "unknown"])
            text = rng.choice(["a.", "b!", "c", "", None, " \t", "d? ", "e.\n", "f", "g.", "h.", "ü.", "i…"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), role, text, rng.choice([0, 1, 1, 1, 2])))
        rows.append((conv, 7, "user", "z.", 0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 3) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [r for r in random_rows(rng, [None, *range(60)], 3)] + [(100, k, r, t, 1) for k, (r, t) in enumerate([("user", "a."), ("user", "b."), ("system", "c."), ("assistant", "d")])]


def test_repairs_equal_the_best_of_all_scripts(spark, rows):
    want = plain_digest(rows)
    done = repair.repair(frame(spark, rows), times_col="times")
    assert got_of(repair.digest(done)) == want
    for r in done.collect():
        left = "\n".join(f"{x.role}:{x.text}" for x in r.lines if x.edit != "D")
        assert "".join(x.edit for x in r.lines) == r.audit and hashlib.sha256(left.encode()).hexdigest() == want[r.conv_id][-1]


@pytest.mark.parametrize("max_rows, max_bytes", [(2, 1 << 20), (1, 0)])
def test_long_conversations_in_pieces(spark, rows, max_rows, max_bytes):
    """Pieces of a row or two; one conversation holds half of all rows, and repeats of one turn."""
    rng = random.Random(12)
    hot = [(7, rng.choice([None, k // 2]), rng.choice(["user", "assistant", "system", None]), rng.choice(["a.", "b", "", f"{k}."]), rng.choice([0, 1, 2])) for k in range(150)]
    hot += [(8, 3, "user", "same.", 1)] * 40 + [(9, k, "user", "same.", 1) for k in range(30)]
    rest = [r for r in rows if r[0] not in (7, 8, 9)]
    whole = got_of(repair.digest(repair.repair(frame(spark, hot + rest), times_col="times")))
    pieces = repair.repair(frame(spark, hot + rest), times_col="times", max_rows=max_rows, max_bytes=max_bytes)
    assert got_of(repair.digest(pieces)) == whole
    assert {c: v for c, v in whole.items() if c not in (7, 8, 9)} == plain_digest(rest)
    assert pieces.filter("conv_id = 7").count() > 3


def test_what_may_follow_depends_on_the_top_alone():
    engine = repair.Repair()
    assert len(engine.stacks) < 10
    ends = {}
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            stacks = [engine.bottom]
            for x in word:
                stacks = [to for s in stacks for to in engine.advance(s, x)]
            assert len(stacks) <= 1
            word = "".join(word)
            assert any(engine.advance(s, "$") for s in stacks) == bool(re.fullmatch("(s?(ua)+)?", word))
            for s in stacks:
                ends.setdefault(s.top, []).append(s)
    words = ["".join(w) for n in range(5) for w in itertools.product("sua", repeat=n)]

    def accepted(stack):
        out = set()
        for w in words:
            stacks = [stack]
            for x in w + "$":
                stacks = [to for s in stacks for to in engine.advance(s, x)]
            if stacks:
                out.add(w)
        return out

    for stacks in ends.values():
        assert len({frozenset(accepted(s)) for s in stacks}) == 1


def test_damage(spark):
    rows = [(c, t, "assistant", "Really? Yes. ") for c in (None, *range(40)) for t in (None, *range(5))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text, r.times) for r in repair.damaged(d).collect()}
    for c, t, role, text in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = ("user" if what == 4 else role, "" if what == 1 else "Really Yes " if what == 2 else text, {0: 0, 3: 2}.get(what, 1))
        assert got[c, t] == want


def test_given_rows_and_no_rows(spark):
    t = table(spark, SMALLEST, "conversations")
    damaged = repair.damaged(t)
    rows = [tuple(r) for r in damaged.collect()]
    short = {c for c in {r[0] for r in rows} if sum(r[4] for r in rows if r[0] == c) <= 5}
    got = got_of(repair.digest(repair.repair(damaged, times_col="times")))
    assert got.keys() == {r.conv_id for r in t.collect()}
    assert {c: got[c] for c in short} == plain_digest([r for r in rows if r[0] in short])
    assert repair.digest(repair.repair(t.limit(0))).collect() == []

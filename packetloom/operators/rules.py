"""Bandwidth rules, as columns.

A rule set is text like `#$Bandwidth<67959,a=1;#($Bandwidth>=67959)&&($Old==1),a=2;`. Conditions compare variables and
integers; && and || have the same precedence and are read from left to right, both sides always looked at. A rule
without a condition always holds. Spark's own expression parser does the reading: here only `$name` is named as a column, and
the left-to-right reading is written out in brackets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _leftwards(condition: str) -> str:
    """Every && and || of one bracket level closed to the left."""
    out, depth, start, groups = "", 0, 0, 0
    for m in re.finditer(r"\(|\)|&&|\|\|", condition):
        if m[0] in "()":
            if m[0] == "(" and depth == 0:
                inner = m.end()
            depth += 1 if m[0] == "(" else -1
            if m[0] == ")" and depth == 0:
                out += condition[start : inner] + _leftwards(condition[inner : m.start()]) + ")"
                start = m.end()
        elif depth == 0:
            out += condition[start : m.start()] + (") AND " if m[0] == "&&" else ") OR ")
            groups += 1
            start = m.end()
    return "(" * groups + out + condition[start:]


def rule_columns(text: str, variables: dict[str, str]) -> list[Column]:
    """A boolean column for each rule; variables says which column each name stands for. NULL counts as not holding."""
    out = []
    for rule in filter(None, (r.strip() for r in text.strip().strip('"').split(";"))):
        head = rule.partition(",")[0].strip() if rule.startswith("#") else ""
        condition = head.removeprefix("#").strip()
        if not condition:
            out.append(F.lit(True))
            continue
        named = re.sub(r"\$(\w+)", lambda m: f"`{variables[m[1]]}`", condition)
        sql = re.sub(r"(?<![<>=])==(?!=)", "=", _leftwards(named))
        out.append(F.coalesce(F.expr(sql), F.lit(False)))
    return out


def holding_rules(text: str, variables: dict[str, str]) -> Column:
    """array<int> of the numbers of the rules that hold."""
    columns = rule_columns(text, variables)
    return F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(columns)]), lambda x: x.isNotNull())

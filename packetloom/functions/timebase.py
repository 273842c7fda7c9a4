"""Integer time. A time is a bigint in units of 1 / timescale seconds; undefined is NULL; it is never a double.

One rounding policy for all: to the nearest unit, halves upwards (towards +infinity), for negative times too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def col(c: Column | str | int) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def div(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer division that truncates towards zero; NULL for a divisor of 0."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return F.when(b != 0, F.call_function("div", a, b))


def floor_div(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer division that rounds down, exact for bigints; b is positive."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return div(a - F.pmod(a, b), b)


def rescale(t: Column | str, source: Column | int, target: Column | int) -> Column:
    """A time of timescale `source` in timescale `target`."""
    n, d = col(t).cast("long") * col(target).cast("long"), col(source).cast("long")
    return floor_div(2 * n + d, 2 * d)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts).cast("timestamp_ntz"))


def stream_duration(start: Column | str, end: Column | str) -> Column:
    """end - start; undefined if the end is, while an undefined start counts as 0."""
    return col(end) - F.coalesce(col(start), F.lit(0))

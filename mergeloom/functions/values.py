"""Scalar functions: ids, typed values, counters, times, texts and arrays.

Functions that the data can violate give null for bad input; the ``checked`` ones raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = 9007199254740991  # greatest whole number a float holds exactly


def parse_opid(c: Column) -> Column:
    """``(ctr, actor)`` of an id such as ``12@ab``, null if it is none."""
    ok = c.rlike(r"^\d+@.*$")
    return F.when(ok, F.struct(F.regexp_extract(c, r"^(\d+)@(.*)$", 1).cast("long").alias("ctr"), F.regexp_extract(c, r"^(\d+)@(.*)$", 2).alias("actor")))


def checked(c: Column, ok: Column, message: str) -> Column:
    """``c``, or an error where ``ok`` is not true."""
    return F.when(ok, c).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(c.cast("string"), F.lit("null")))).cast("string"))


def opid_delta(a: Column, b: Column, delta: int) -> Column:
    """Whether two ids are of one actor and ``delta`` apart."""
    x, y = parse_opid(a), parse_opid(b)
    return (x["actor"] == y["actor"]) & (x["ctr"] + delta == y["ctr"])


def is_actor(c: Column) -> Column:
    """Lower-case hexadecimal digits, an even number of them."""
    return c.rlike(r"^([0-9a-f]{2})+\z")


def infer_type(c: Column) -> Column:
    """Type of a number: ``int`` if it is whole and exact, else ``float64``; null has type ``null``."""
    whole = (c == F.floor(c)) & (F.abs(c) <= SAFE)
    return F.when(c.isNull(), "null").when(whole, "int").otherwise("float64")


def as_int(c: Column) -> Column:
    """A whole number in the exact range, else null."""
    return F.when((c == F.floor(c)) & (F.abs(c) <= SAFE), c.cast("long"))


def as_uint(c: Column) -> Column:
    """A whole number from 0 in the exact range, else null."""
    return F.when((c == F.floor(c)) & (c >= 0) & (c <= SAFE), c.cast("long"))


def counter_after(start: Column, deltas: Column) -> Column:
    """A counter's value after an array of increments (negative ones decrement)."""
    return F.aggregate(deltas, start.cast("long"), lambda acc, d: acc + F.coalesce(d, F.lit(1)).cast("long"))


def from_millis(c: Column) -> Column:
    """Time of a timestamp value, in milliseconds since 1970."""
    return F.timestamp_millis(c)


def to_millis(c: Column) -> Column:
    return F.unix_millis(c)


def characters(c: Column) -> Column:
    """Array of the characters of a text, by code point."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def slice_(a: Column, start: int, end: int | None = None) -> Column:
    """Elements from ``start`` up to before ``end``; negative ones count from the end."""
    n = F.size(a)
    at = lambda k: F.greatest(F.lit(0), n + k) if k < 0 else F.least(F.lit(k), n)
    first, last = at(start), n if end is None else at(end)
    return F.slice(a, first + 1, F.greatest(F.lit(0), last - first))


def index_of(a: Column, v: Column) -> Column:
    """Index of the first such element, -1 if there is none."""
    return (F.array_position(a, v) - 1).cast("long")


def last_index_of(a: Column, v: Column) -> Column:
    p = F.array_position(F.reverse(a), v)
    return F.when(p > 0, F.size(a) - p).otherwise(-1).cast("long")


def element(a: Column, i: int) -> Column:
    """Element at an index from 0 (negative: from the end), null beyond either."""
    return F.try_element_at(a, F.lit(i + 1 if i >= 0 else i))


def nulls(n: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("string"), n)

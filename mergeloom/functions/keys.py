"""Reading hashes, actor ids and operation ids as they are written in feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH = r"^[0-9a-f]{64}\z"  # not $, which also matches before a last line end
ROOT = "_root"
_SPACE = r"[\s\p{Z}\x{FEFF}\x{200B}]+"
_PREFIX = "^(.*:)?(0x)?"


def bare_key(c: Column) -> Column:
    """Lower case, without white space and without a prefix such as ``0x`` or ``sha256:``. Null stays null."""
    low = F.regexp_replace(F.lower(c), _SPACE, "")
    return F.when(c.rlike(r"^[0-9a-f]*\z"), c).otherwise(F.regexp_replace(low, _PREFIX, ""))


def clean_hash(c: Column) -> Column:
    """The 64 digits of a change hash, or null where the value is no hash."""
    b = bare_key(c)
    return F.when(b.rlike(HASH), b)


def opid(ctr: Column, actor: Column) -> Column:
    """``ctr@actor``; null if either is null."""
    return F.concat(ctr.cast("string"), F.lit("@"), actor)


def object_id(obj: Column) -> Column:
    """The id of a container given as struct ``(ctr, actor)``; null or incomplete means the root."""
    return F.coalesce(opid(obj["ctr"], bare_key(obj["actor"])), F.lit(ROOT))


def digest(*cols: Column) -> Column:
    """16 bytes that stand for a tuple in shuffles; nulls equal nulls and differ from every value."""
    parts: list[Column] = []
    for c in cols:
        s = c.cast("string")
        parts += [F.coalesce(F.concat(F.length(s).cast("string"), F.lit("|"), s), F.lit("-")), F.lit("|")]
    return F.unhex(F.md5(F.concat(*parts)))

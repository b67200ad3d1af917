"""New ids, from a source that can be replaced so that tests know what comes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _random() -> str:
    return uuid.uuid4().hex


_source: Callable[[], str] = _random


def new_id() -> str:
    """32 hexadecimal digits, unless another source is set."""
    return _source()


def set_source(source: Callable[[], str]) -> None:
    global _source
    _source = source


def reset_source() -> None:
    set_source(_random)


def new_ids() -> Column:
    """A random id for each row of a table."""
    return F.regexp_replace(F.expr("uuid()"), "-", "")

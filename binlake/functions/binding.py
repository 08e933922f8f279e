"""Name a value inside an expression."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also when a lambda inside reads it per element."""
    return F.transform(F.array(value), body)[0]

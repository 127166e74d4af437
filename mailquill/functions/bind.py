"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, and only when the whole expression is.

    Spark shares repeated expressions between columns, but neither inside lambdas nor across branches of a condition.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))

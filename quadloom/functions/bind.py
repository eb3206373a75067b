"""Evaluating a column once where a lambda reads it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` bound to a lambda's variable.

    Without it the optimizer copies the expression to each place that reads it,
    inside lambdas to each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)

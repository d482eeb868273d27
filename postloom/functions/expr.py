"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`.

    An expression repeated in a tree is evaluated each time it occurs under a condition or in a lambda,
    which multiplies for nested expressions.
    """
    return F.transform(F.array(value), body)[0]


def unless(value: Column, *unwanted: str) -> Column:
    """The text, or null where it equals one of the unwanted texts."""
    return let(value, lambda v: F.when(~v.isin(*unwanted), v))

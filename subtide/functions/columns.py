"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times, also inside lambdas.

    Catalyst merges projections, so an expression that a lambda refers to would be evaluated again for each element;
    a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def big(value: Column) -> Column:
    return value.cast("bigint")


def strict_or(*conditions: Column) -> Column:
    """OR in which an unknown condition counts as false."""
    out = F.lit(False)
    for condition in conditions:
        out = out | F.coalesce(condition, F.lit(False))
    return out

"""Evaluate an expression a single time.

The optimizer may copy an expression into every place that uses its result:
into a filter pushed below the projection, or into a lambda that then runs it
per element. These two helpers prevent that for costly expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column behind a one-element explode, which filters do not cross."""
    return df.select("*", F.explode(F.array(value)).alias(name))

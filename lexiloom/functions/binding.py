"""Values that are computed once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; inside lambdas Spark would compute it each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """``keep`` and the named ``values`` of a table, each computed once for a row.

    A generator of one row stands between: Spark puts a column's expression in the place of the column where it merges projections or pushes filters
    down, so that a costly one would be computed for each of its uses.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))))

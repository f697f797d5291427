"""Array elements to rows.

Spark infers `size(array) > 0` from a plain explode and pushes it down by
copying the array expression, which evaluates a costly one twice. The outer
forms with a filter behind them give the same rows without the copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list, values: Column | str, out: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(values).alias(out)).where(F.col(out).isNotNull())


def posexploded(df: DataFrame, keep: list, values: Column | str, pos: str, out: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(values).alias(pos, out)).where(F.col(pos).isNotNull())


def settled(df: DataFrame, keep: list, **computed: Column) -> DataFrame:
    """Computed columns that later filters do not copy.

    A filter on a projected column is pushed below the projection with the whole
    expression inside it, so a costly one runs twice. Filters on the output of
    this one-row generator stay above it.
    """
    fields = [value.alias(name) for name, value in computed.items()]
    return df.select(*keep, F.inline(F.array(F.struct(*fields))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often `use` names it.

    An expression that names a costly one several times repeats it each time,
    and inside a lambda once per array element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))

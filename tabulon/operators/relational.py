"""Relational operators as DataFrame functions; Catalyst picks the physical plan of each."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import zero


def equi_join(a: DataFrame, b: DataFrame, left: str, right: str, how: str = "inner", null_equal: bool = False) -> DataFrame:
    """Join on one pair of columns; null_equal lets null match null."""
    on = a[left].eqNullSafe(b[right]) if null_equal else a[left] == b[right]
    return a.join(b, on, how)


def chain_join(first: DataFrame, *steps: tuple[DataFrame, Column]) -> DataFrame:
    return reduce(lambda df, step: df.join(*step), steps, first)


def correlated_total(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, value: str, name: str) -> DataFrame:
    """outer with the sum of value over matching inner rows (0 for none): one aggregate below one join."""
    kind = inner.schema[value].dataType.simpleString()
    sums = inner.groupBy(F.col(inner_key).alias("_key")).agg(F.sum(value).alias("_sum"))
    return outer.join(sums, outer[outer_key] == sums["_key"], "left").select(*[outer[c] for c in outer.columns], F.coalesce("_sum", zero(kind)).alias(name))


def sort(df: DataFrame, column: str, descending: bool = False, null_as_zero: bool = False) -> DataFrame:
    key = F.col(column)
    if null_as_zero:
        key = F.coalesce(key, zero(df.schema[column].dataType.simpleString()))
    return df.orderBy(key.desc() if descending else key.asc())


def top(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows by keys: each task keeps n rows, so nothing is sorted as a whole."""
    return df.orderBy(*keys).limit(n)

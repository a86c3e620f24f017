"""Column builders for the engine's comparison, aggregate and constant rules.

Comparisons are two-valued: a null never equals, exceeds or precedes anything, and NOT and != are plain
complements, so they pass nulls.  A date-only literal equals any moment of that day, a time-only literal
that time of any day.  SUM, AVG, MIN and MAX over nothing are the type's zero.
"""
from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE, TIME = re.compile(r"\d{4}-\d{1,2}-\d{1,2}$"), re.compile(r"\d{1,2}:\d{1,2}:\d{1,2}$")


def day_of(text: str) -> dt.datetime | None:
    return dt.datetime(*map(int, text.split("-"))) if DATE.match(text) else None


def literal(value, kind: str) -> Column:
    """A literal cast to the column's type, as the comparison rules ask (2.5 against a long is 2)."""
    if kind in ("bigint", "int", "long") and isinstance(value, float):
        value = int(value)
    if kind.startswith("timestamp") and isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    return F.lit(value).cast(kind)


def eq(c: Column, value, kind: str) -> Column:
    """c = value; null rows give null, which a filter drops."""
    if kind.startswith("timestamp") and isinstance(value, str):
        if day := day_of(value):
            return (c >= F.lit(day).cast("timestamp_ntz")) & (c < F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz"))
        if TIME.match(value):
            return F.date_format(c, "HH:mm:ss") == ":".join(x.zfill(2) for x in value.split(":"))
    return c == literal(value, kind)


def ne(c: Column, value, kind: str) -> Column:
    """Complement of eq; written so that the null test and the rest can both reach the scan."""
    return c.isNull() | ~eq(c, value, kind)


def negate(p: Column) -> Column:
    return ~F.coalesce(p, F.lit(False))


def lt(c: Column, value, kind: str) -> Column:
    return c < (F.lit(day_of(value)).cast("timestamp_ntz") if isinstance(value, str) and kind.startswith("timestamp") and day_of(value) else literal(value, kind))


def gt(c: Column, value, kind: str) -> Column:
    return c > (F.lit(day_of(value)).cast("timestamp_ntz") if isinstance(value, str) and kind.startswith("timestamp") and day_of(value) else literal(value, kind))


def le(c: Column, value, kind: str) -> Column:
    """Less or equal; a date-only literal takes in its whole day."""
    if kind.startswith("timestamp") and isinstance(value, str) and (day := day_of(value)):
        return c < F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz")
    return lt(c, value, kind) | eq(c, value, kind)


def ge(c: Column, value, kind: str) -> Column:
    if kind.startswith("timestamp") and isinstance(value, str) and (day := day_of(value)):
        return c >= F.lit(day).cast("timestamp_ntz")
    return gt(c, value, kind) | eq(c, value, kind)


def zero(kind: str) -> Column:
    if kind == "string":
        return F.lit("")
    if kind.startswith("timestamp"):
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.lit(0).cast(kind)


def total(c: Column, kind: str) -> Column:
    return F.coalesce(F.sum(c), zero("double" if kind in ("double", "float") else "bigint"))


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def least(c: Column, kind: str) -> Column:
    return F.coalesce(F.min(c), zero(kind))


def most(c: Column, kind: str) -> Column:
    return F.coalesce(F.max(c), zero(kind))

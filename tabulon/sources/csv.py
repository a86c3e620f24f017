"""CSV with tagged headers: a deterministic typed scan and a sink."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: one-letter groups in brackets at a header's end: N number, T text, D date and time, P primary key.
TAGS = re.compile(r"(?:\s*\([a-zA-Z0-9]\))+\s*$")
WHOLE, FLOAT = r"^\s*[+-]?\d{1,19}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MOMENT = r"^\s*(\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{1,2}(:\d{1,2})?)?|\d{1,2}:\d{1,2}:\d{1,2})\s*$"


def split_header(cell: str) -> tuple[str, set[str]]:
    """Name and tags (upper case) of a header cell."""
    tail = TAGS.search(cell)
    name = cell[: tail.start()] if tail else cell
    return name.strip(), {c.upper() for c in tail[0] if c.isalnum()} if tail else set()


def moment(c: Column) -> Column:
    """Date and time, date only (midnight) or time only (of 1970-01-01), padded or not, as a timestamp without zone; null if none fits."""
    t = F.trim(c)
    t = F.when(t.rlike(r"^\d{1,2}:"), F.concat(F.lit("1970-01-01 "), t)).otherwise(t)
    forms = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms]).cast("timestamp_ntz")


def typed(c: Column, kind: str) -> Column:
    if kind == "long":
        return F.trim(c).try_cast("bigint")
    if kind == "double":
        return F.trim(c).try_cast("double")
    return moment(c) if kind == "timestamp" else F.coalesce(c, F.lit(""))  # the reader gives null for an empty cell


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Reads a CSV file with a header.  A tag N, T or D gives a column's type (N stays integral if every cell is);
    other columns take the narrowest of integer, float, date-time and text that all filled cells fit, found in
    one aggregate over the file.  Cells that do not parse become null; empty text stays empty text.
    A row with more or fewer cells than the header is an error."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").option("enforceSchema", False)
    raw = reader.option("mode", "FAILFAST").csv(path)
    heads = [split_header(c) for c in raw.columns]
    names = [n for n, _ in heads]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"repeated column names: {names}")
    raw = raw.toDF(*names)
    filled = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != ""
    checks = []
    for i, c in enumerate(names):
        some = F.when(filled(c), F.col(f"`{c}`"))
        checks += [F.count(some).alias(f"n{i}")] + [F.coalesce(F.bool_and(some.rlike(p)), F.lit(True)).alias(f"{k}{i}") for k, p in (("f", FLOAT), ("d", MOMENT))]
        # Nineteen digits may or may not fit 64 bits, so the cast decides.
        checks.append(F.coalesce(F.bool_and(some.rlike(WHOLE) & F.trim(some).try_cast("bigint").isNotNull()), F.lit(True)).alias(f"i{i}"))
    seen = raw.agg(*checks).first() if names else None
    out = []
    for i, (name, tags) in enumerate(heads):
        if "T" in tags:
            kind = "string"
        elif "D" in tags:
            kind = "timestamp"
        elif "N" in tags:
            kind = "long" if seen[f"i{i}"] and seen[f"n{i}"] else "double"
        else:
            kind = "string" if not seen[f"n{i}"] else "long" if seen[f"i{i}"] else "double" if seen[f"f{i}"] else "timestamp" if seen[f"d{i}"] else "string"
        out.append(typed(F.col(f"`{name}`"), kind).alias(name))
    return raw.select(*out)


def cell(c: Column, kind: T.DataType) -> Column:
    """A value as the sink prints it: six decimals for floats, padded date and time, nothing for null."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        c = F.format_string("%.6f", c.cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


def shown(df: DataFrame) -> DataFrame:
    """Every column as the text that the sink prints."""
    return df.select(*[cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def write_parts(df: DataFrame, path: str) -> None:
    """Writes a result as a folder of CSV files, each with the header: every task writes its own rows, to any file
    system, by the same rules as write()."""
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    shown(df).write.options(**options).csv(path)


def write(df: DataFrame, path: str) -> None:
    """Writes a result as one CSV file on the driver, with a header and LF endings; fields are quoted only where they must be.

    Rows stream to the driver partition by partition, so only one partition is held at a time; one process writes them
    all, so results of many gigabytes belong in write_parts()."""
    import csv

    with open(path, "w", newline="", encoding="utf-8") as out:
        w = csv.writer(out, lineterminator="\n")
        w.writerow(df.columns)
        for row in shown(df).toLocalIterator():
            w.writerow(row)

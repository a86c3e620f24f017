"""Helpers that several operators of this subpackage use."""
from __future__ import annotations

import atexit
import sys
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch

#: Fixed value: what separates words (ASCII white space); bytes.split() cuts at the same set.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the Parquet tables with Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folders() -> list[list[str]]:
    """Folders made and not yet deleted: those of the session first, then of each open temporaries()."""
    return sys.__dict__.setdefault("_tabulon_folders", [[]])


def _forget(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        try:
            if path.startswith("table:"):
                spark.sql(f"drop table if exists {path[6:]}")
            else:
                remove(spark, path)
        except Exception:  # the session or its file system may be gone; nothing depends on this
            pass


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir (see scratch()), deleted with the enclosing temporaries() or at exit."""
    if not getattr(sys, "_tabulon_at_exit", False):
        sys._tabulon_at_exit = True
        atexit.register(lambda: _forget(SparkSession.getActiveSession() or spark, [p for scope in _folders() for p in scope]))
    path = scratch(spark)
    _folders()[-1].append(path)
    return path


@contextmanager
def temporaries(spark: SparkSession):
    """Deletes, at its end, the folders and tables that shared_dir() and bucketed() made inside.  It gives a function
    that stores a frame so that it outlives them, until the enclosing temporaries() end."""
    scopes = _folders()
    outer, mine = scopes[-1], []
    scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        out = stored(df)
        outer.append(mine.pop())
        return out

    try:
        yield keep
    finally:
        scopes.remove(mine)
        _forget(spark, mine)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key wanted has, written to the shared folder in buckets of the key: one shuffle now, none
    when a join on the key reads them.  An inner join, as Spark moves a semi-join below the shuffle and, where it
    can't broadcast, shuffles df twice.  The table keeps a name of its own in the session's catalog until the
    enclosing temporaries() end."""
    spark, n, name = df.sparkSession, partitions(df.sparkSession), f"tabulon_{uuid.uuid4().hex}"
    dealt = df.repartition(n, key).join(wanted.select(key).distinct(), key)
    dealt.write.bucketBy(n, key).option("path", shared_dir(spark)).option("compression", "zstd").saveAsTable(name)
    _folders()[-1].append(f"table:{name}")
    return spark.table(name)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, bound as a lambda variable."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text, in order; empty for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def worker_state(name: str, make):
    """A value kept for the life of a Python worker process, across its tasks."""
    kept = sys.__dict__.setdefault("_tabulon_worker", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def trimmed() -> None:
    """Gives back what a Python worker has freed in earlier tasks and still holds, as workers serve many stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Arrow batches to Python carry at most rows rows and about size bytes, so that long texts fit in memory.  The
    setting is read when a query runs, so it stays in the session; it is only ever lowered."""
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < bytes_of(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def groups_of_text(batches: Iterable, column: int, most: int = 4 << 20, rows: int = 1000):
    """Slices of Arrow batches with about most bytes of text and at most rows rows each (a longer text comes alone)."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            end = min(end, at + rows)
            yield b.slice(at, end - at)
            at = end

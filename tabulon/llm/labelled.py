"""Labelled rows for the classifiers: a bounded, repeatable sample and the held-out split."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; a null key counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of at most most labelled rows with usable(key), those of least hash: one row an id, of several labels
    the largest, of several texts that of least hash.  The list of ids that is broadcast has at most most rows."""
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("k").isNotNull() & usable(F.col("k")))
    chosen = rows.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "k")
    return found.groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")).select("text", "y")

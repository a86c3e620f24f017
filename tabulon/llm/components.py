"""Connected components by alternating large-star and small-star steps (DataFrame operations only).

Every step is a grouped minimum (combined before its shuffle) and one join; the edges of each round
are written to the shared folder, so that lineage stays short and lost executors cost one round.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Edges that one task of a caller's own contraction takes.
AT_ONCE = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node on the least of them: those above the node, or those up to it."""
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # an edge always points from the larger node a to the smaller node b
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        moved = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return moved.where("a != b")


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether each node above another hangs on a root and on nothing else."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, odd = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return n or 0, not odd


def components(edges: DataFrame, most_rounds: int = 60, contract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """edges (a, b) of orderable ids, in any direction, loops and repeats allowed; nulls link nothing.

    Returns (node, root) for every node that an edge names; root is the least node of its component.
    contract, if given, may replace the edges of each task (AT_ONCE or so) by fewer that connect the same nodes.
    Raises if most_rounds rounds do not settle it (each round shrinks paths by a factor)."""
    e = edges.where("a is not null and b is not null and a != b")
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, settled = _state(e)
    for _ in range(most_rounds):
        if contract and not settled:
            e = stored(contract(e.coalesce(-(-n // AT_ONCE))))
            n, settled = _state(e)
        if settled:
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        e = stored(_star(_star(e, True), False).distinct())
        n, settled = _state(e)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

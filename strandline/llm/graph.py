"""Connected components of an edge table, by alternating stars.

Each round links all larger neighbours of a node to its least neighbour, then all smaller ones; rounds end when the edges no longer
change.  Minima are combined before the shuffle; where there are few edges they are joined by a broadcast, else they are settled first,
so that the join can be split where a node has very many neighbours.  Edges are tables in the shared folder; those of a
round go when the next ones are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch

#: Files of the edges of a round that are few enough for a broadcast.
FILES = 8


def _pair(a, b):
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the least node reachable) of every node in ``edges`` (a, b: long).  Loops and repeated edges don't matter."""
    held = Scratch(edges.sparkSession)
    now = held.keep(edges.where("a <> b").select(*_pair(F.col("a"), F.col("b"))).distinct(), "edges")
    mark = None
    for _ in range(most):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        few, kept = 2 * seen[0] <= BROADCAST_ROWS, []

        def least_of(df: DataFrame) -> DataFrame:
            least = df.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            if few:
                return F.broadcast(least)
            kept.append(held.keep(least, "least"))
            return kept[-1]

        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least_of(both), "a").where("b > a").select(*_pair(F.col("b"), F.col("m"))).where("a <> b").distinct()
        if not few:
            large = held.keep(large, "edges")
            kept.append(large)
        small = large.join(least_of(large), "a").select("a", "b", "m")
        small = small.select(*_pair(F.col("b"), F.col("m"))).unionByName(small.select("a", F.col("m").alias("b")))
        small = small.where("a <> b").distinct()
        kept.append(now)
        now = held.keep(small.coalesce(FILES) if few else small, "edges")
        held.drop(*kept)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

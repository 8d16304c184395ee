"""Connected components of a graph given as edges, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MAX_ROUNDS = 60


def _connect(edges: DataFrame, large: bool) -> DataFrame:
    """One star step of Kiveris et al. (2014): every node's larger (or not larger) neighbours are linked to its smallest."""
    both = edges.select("hi", "lo").unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))) if large else edges
    # Minima are written first: both sides of the join are then exchanged, and a node with many neighbours can be split.
    least = checkpointed(both.groupBy(F.col("hi").alias("u")).agg(F.least(F.min("lo"), F.first("hi")).alias("m")))
    joined = both.join(least, F.col("hi") == F.col("u"))
    moved = joined.where(F.col("lo") > F.col("hi")) if large else joined
    out = moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi <> lo").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that it is connected to.

    Large-star and small-star steps by turns until nothing changes; each round is written to the checkpoint folder.
    Only a count and a sum of hashes come to the driver.
    """
    now = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where("hi <> lo").distinct()
    now, before = checkpointed(now), None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = checkpointed(_connect(checkpointed(_connect(now, True)), False))
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())

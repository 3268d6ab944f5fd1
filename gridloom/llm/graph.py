"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a few joins and aggregations on node keys; nothing is collected but whether the edges are
stars by now.  Hubs are handled by partial aggregation and by the splitting
of skewed join partitions (see ``apart``).  The edges of a step are deleted when the next ones are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import storage

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node that has none itself."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return sides.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def apart(frame: DataFrame, key: str, name: str) -> DataFrame:
    """The frame with its key under another name, as an expression that the planner does not take for the
    key by which the frame has been aggregated.  A join on it exchanges both sides for itself, and only
    such a join can have a hub's partition split by adaptive execution."""
    return frame.withColumn(name, F.col(key).bitwiseXOR(F.lit(0).cast("long"))).drop(key)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it can reach.

    ``edges`` has two columns u and v; loops, repeats and either direction are allowed.
    """
    first = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    held = storage.Scratch(edges.sparkSession)
    e = held.table(first, "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(e):
            break
        # Large star: every larger neighbour of u is tied to the least of u and its neighbours.
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Its rows are no more than the edges, so they are not made distinct before the next step.
        large = both.join(apart(least, "u", "w"), F.col("u") == F.col("w")).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        step = storage.Scratch(edges.sparkSession)
        e = step.table(small.filter("u <> v").distinct(), "edges")
        held.clear()
        held = step
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

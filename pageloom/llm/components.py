"""Connected components of a graph that no machine holds.

Alternating large-star and small-star steps: every node hands its smallest
neighbour to the others, until all edges of a component lead to its smallest
node. A step is a grouped minimum, combined before the shuffle, and a join; a
node with very many neighbours is a number in one row and a skewed key in a
join, which Spark splits. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import Scratch


def components(edges: DataFrame, run: Scratch | None = None) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for all nodes but the roots.

    ``edges`` has columns u and v of one orderable type. Loops, repeated edges
    and null ends are ignored; no edges give no rows.
    """
    run = run or Scratch(edges.sparkSession)
    step = Scratch(edges.sparkSession)
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    current = step.settle(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(low, high).distinct())
    before = None
    while True:
        # Large star: neighbours above a node are tied to the smallest node it knows.
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # Small star: neighbours below a node, and the node, are tied to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("a"), F.col("u").alias("b")).union(joined.select("m", "v")).where("a < b")
        done, step = step, Scratch(edges.sparkSession)
        current = step.settle(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        done.drop()
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            run.folders += step.folders
            return current.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now

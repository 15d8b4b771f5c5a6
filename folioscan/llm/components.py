"""Connected components of a graph given as edges, by repeated contraction.

Every round each vertex follows its neighbour of smallest random rank (or stays, if its own is smaller), edges are renamed
accordingly and repeats dropped. Local minima alone survive, so the graph shrinks by a constant factor a round whatever
its shape; nothing but two narrow tables a round is kept, both written to the shared folder. Joins are between written
tables, so a vertex with very many edges is split by adaptive skew handling, and counts are aggregated before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``v``, ``root`` for every vertex of ``edges`` (long columns ``a``, ``b``); root is the smallest of its component.

    Loops, repeats and either direction are fine; null ends are ignored; no edges give no rows.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = stored(edges.filter("a <> b").select(low, high).distinct(), "edges")
    steps = []
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b"))
        step = stored(found.select(
            F.col("a").alias("v"),
            F.when(F.xxhash64("a") < F.xxhash64("b"), F.col("a")).otherwise(F.col("b")).alias("p")), "step")
        steps.append(step)
        one = left.join(step.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
        two = one.join(step.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        left = stored(two.filter("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    top = steps.pop()
    while steps:
        further = top.select(F.col("v").alias("p"), F.col("p").alias("q"))
        top = stored(steps.pop().join(further, "p", "left").select(
            "v", F.coalesce("q", "p").alias("p")), "step")
    smallest = stored(top.groupBy("p").agg(F.min("v").alias("root")), "roots")
    return stored(top.join(smallest, "p").select("v", "root"), "components")

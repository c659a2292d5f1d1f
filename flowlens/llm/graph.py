"""Connected components of an edge table by alternating large-star and small-star steps, all as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node that an edge (a, b) touches, with the smallest node it reaches.

    Nodes without an edge, or with a null at one end, have no row. Repeated edges and loops change nothing. Each round
    is stored in the shared folder, so a lost executor costs one round at most; the rounds grow with the logarithm of
    the longest chain.
    """
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(floor.select("u", F.col("m").alias("v"))).distinct())
        after = _state(e)
        if after == state:
            break
        state = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

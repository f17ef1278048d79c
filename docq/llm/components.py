"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docq.llm.scratch import Scratch, skew_join


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Component of each node that has an edge.

    edges: columns a, b (long), any direction, repeats allowed, loops ignored.
    Returns node, root (the smallest node reachable); roots are not listed.
    Rows with a null end take no part; an empty table gives an empty result.

    Each round hangs every larger neighbour on the smallest one (large star),
    then every smaller neighbour (small star); depth falls geometrically.  Minima are
    reduced before the shuffle, and the edges of a node with very many larger
    neighbours meet its minimum by a broadcast (skew_join), so they cost no single
    task.  In the small star a node has one edge for each root it leads to.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = scratch.table(e, "edges")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("held"))
        hung = scratch.table(least, "least")
        large = skew_join(both, hung, "a", "held").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.table(small.union(least).distinct(), "stars")
        now = after.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        scratch.drop(e, hung)
        e = after
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

"""Connected components of a graph of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import keep


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """``edges``: a, b (long). Returns node, component (the least node reachable), one row for each node with an edge.

    Each round re-points every node at the least neighbour seen so far (first from larger nodes, then among smaller
    ones); the graph shrinks to stars in a logarithmic number of rounds in practice. A round's edges are written to
    the shared folder, so the plan stays short and a lost executor loses nothing.
    Self-links and repeated links are ignored; no links: no rows.
    """
    clean = edges.filter(F.col("a") != F.col("b"))
    now = keep(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    for _ in range(rounds):
        # Large star: of u's neighbours, those above u are linked with the least of u and its neighbours.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        # Small star: u and its smaller neighbours are linked with the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = keep(small.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct(), label)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

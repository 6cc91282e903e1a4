"""Connected components over DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialise


def _small_star(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, hang on the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on its smallest one. Edges lead from a to a smaller b,
    so only a node that is some edge's a has a smaller neighbour; the others' edges stay."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
    return e.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    links: columns a, b of one orderable type; either direction, repeats and
    loops are allowed, null ends are ignored. Nodes without links are absent
    from the result. Alternates large-star and small-star, which leave stars
    after O(log^2) rounds; every round is written to the shared folder, so no
    link ever comes to the driver and a lost executor costs one round. Empty
    links give an empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The table and what tells it from another, gathered while it is written."""
        seen = Observation()
        mark = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        kept = materialise(e.observe(seen, *mark), "links")
        return kept, (seen.get["n"], seen.get["sum"])

    edges, seen = written(edges)
    for _ in range(rounds if seen[0] else 0):
        after, now = written(_small_star(_large_star(edges)))
        discard(edges)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )

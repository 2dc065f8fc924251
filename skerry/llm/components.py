"""Connected components by alternating large and small stars.

Every round is a minimum per node and a join of the edges with it; edges stay a DataFrame, nodes are
never gathered, and each round is written to the shared folder.  The minimum is partial before the
shuffle; the joins' hot nodes are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry import workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """(a, b), a > b in; each node's larger neighbours are linked to its least neighbour."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long, neither null) to (node, component): every node's least reachable node.

    Nodes without edges to other nodes don't occur in the result.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = workspace.materialize(edges, "star")
    seen = None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == seen or not now["n"]:
            break
        seen, before = now, edges
        edges = workspace.materialize(_small_star(_large_star(edges)), "star")
        workspace.release(before)
    else:
        raise RuntimeError(f"no fixed point in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

"""Connected components of a graph given by its edges, as a few joins per round.

Rounds of two star operations: every node hands its larger (then its smaller)
neighbours to the smallest node it knows, until all edges point to the smallest node of
their component. A node's minimum is a pre-aggregated ``min``; neighbours are never
gathered. The few nodes with more than a ``HUBS``-th of all edges get their minimum by broadcast, so a
node with a third of them is no hot key of a join. The edges are written to the shared folder after each
star operation: a plan that holds two of them repeats the first wherever the second reads its edges, and
its size on the driver is that of the product.

Defined results: no edges give no rows; loops, repeated edges and edges with a null end
change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smudgelab.llm.common import stored

#: Each round at least halves the length of paths, so this covers any graph in practice.
MOST_ROUNDS = 60
#: A node with more than this part of all edges is a hub.
HUBS = 1000


def _to_minimum(edges: DataFrame, total: int) -> DataFrame:
    """(a, b) with each a's smallest b added as column ``least``; ``total``: the number of edges."""
    found = edges.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
    is_hub = F.col("n") * HUBS > total  # so there are fewer than HUBS of them
    hubs = found.where(is_hub).select("a", F.col("least").alias("least_of_hub"))
    marked = edges.join(F.broadcast(hubs), "a", "left")
    # The edges of hubs go anywhere: what they may meet there is not looked at.
    place = F.when(F.col("least_of_hub").isNull(), F.col("a")).otherwise(F.xxhash64("b"))
    others = found.where(~is_hub).select(F.col("a").alias("place"), "least")
    least = F.coalesce("least_of_hub", "least").alias("least")
    return marked.withColumn("place", place).join(others, "place", "left").select("a", "b", least)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    linked = _to_minimum(both, 2 * total).withColumn("least", F.least("least", "a"))
    return linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    linked = _to_minimum(edges, total)
    pairs = F.array(
        F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b"))
    )
    return linked.select(F.explode(pairs).alias("e")).select("e.*").where("a <> b").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b; returns (node, root) of all nodes but the roots.

    The root of a component is its smallest node.
    """
    oriented = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current, before = stored(oriented.distinct(), "edges"), None
    for _ in range(MOST_ROUNDS):
        state = current.select(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        # The large star keeps the number of edges.
        for star in (_large_star, _small_star):
            current = stored(star(current, state[0]), "edges")
    raise RuntimeError(f"components not found after {MOST_ROUNDS} rounds")

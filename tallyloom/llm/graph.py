"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpointed

#: Far above the number of rounds that any graph needs, which is about the square of the logarithm of its size.
MOST_ROUNDS = 200
#: A node with more edges than this, and than a MOST_HOT-th part of all, is hot: there are at most 2 * MOST_HOT hot nodes.
HOT, MOST_HOT = 64, 100_000
#: Edges up to which a node may have them all in one task, 16 bytes each, and no labels are broadcast.
FEW_EDGES = 1 << 20


def _tied(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(a, b, m) of the edges, with the label m of a: labels of hot nodes are broadcast, so that their edges stay where they are."""
    if total <= FEW_EDGES:
        return edges.join(least, "a").select("a", "b", "m")
    hot = F.broadcast(least.where(F.col("degree") > max(HOT, total // MOST_HOT)).select("a", "m"))
    cold = edges.join(hot, "a", "left_anti").join(least, "a").select("a", "b", "m")
    return cold.union(edges.join(hot, "a").select("a", "b", "m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Tie every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return _tied(both.where(F.col("b") > F.col("a")), least, total).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    return _tied(down, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in the edges (a, b) of long ids; component: the least node that can be reached.

    Each round writes its edges to the checkpoint folder, so a lost executor
    costs a round at most.  Only a count and a hash sum reach the driver.  The
    star of a node with very many links is split: see _tied.
    """
    proper = lambda e: e.where(F.col("a") != F.col("b")).distinct()
    now, before = checkpointed(proper(edges)), None
    for _ in range(MOST_ROUNDS):
        print_of = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if print_of.n == 0 or print_of == before:
            break
        before = print_of
        now = checkpointed(proper(_small_star(_large_star(now, print_of.n), 2 * print_of.n)))
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())

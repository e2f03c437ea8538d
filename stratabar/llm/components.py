"""Connected components by alternating stars, each round cut off in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabar.llm.common import checkpointed

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one ordered type. Returns node, root: the least node of its component, for every node with an
    edge to another. Minima are found by aggregation with map-side combine and given back by joins, so no node's
    neighbours are ever gathered."""
    e = checkpointed(_canonical(edges))
    before = None
    for _ in range(MAX_ROUNDS):
        e = checkpointed(_small_star(_large_star(e)))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
    raise RuntimeError("components did not settle")


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # cut off, so the join deals it anew and can split what meets a node of many neighbours
    least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return _canonical(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = checkpointed(e.groupBy("a").agg(F.min("b").alias("m")))
    tied = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _canonical(tied.unionByName(least.select("a", F.col("m").alias("b"))))

"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation (combined before the shuffle) and an equi-join
that Spark may split where a node is hot; the edge list is written to the shared
folder after each round, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` to ``(node, component)``, the component's smallest node.

    Direction is ignored. Null ends, loops and repeated edges are dropped; a
    node without an edge to another node is absent from the result. The node type
    is any orderable type. An empty input gives an empty result. Raises after
    ``max_rounds`` rounds (a round at least halves path lengths in practice).
    """
    now = materialize(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct(),
        "edges",
    )
    seen = _digest(now)
    if seen[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(now)), "edges")
        digest = _digest(after)
        discard(now)
        now = after
        if digest == seen:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = digest
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(edges: DataFrame, least: DataFrame, node: str) -> DataFrame:
    """``edges`` joined with a row for each node.

    The key is wrapped so that the aggregated side is dealt out once more: only a join between two plain
    exchanges can be split where a node has very many edges.
    """
    key = F.struct(node).alias("key")
    return edges.select("*", key).join(least.select(key, "m"), "key").drop("key")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        _with_least(both, least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, with the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, durable


def _forest(edges: DataFrame) -> DataFrame:
    """Each edge once, its larger node first; loops and null nodes go."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(high.alias("a"), low.alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead to roots: no node has an edge and is one's end, or has edges to two ends."""
    ends = edges.select(F.col("a").alias("n"), F.lit(True).alias("leads"), "b").union(edges.select(F.col("b").alias("n"), F.lit(False).alias("leads"), F.lit(None).alias("b")))
    return ends.groupBy("n").agg(F.bool_or("leads").alias("leads"), F.bool_and("leads").alias("only"), F.min("b").alias("low"), F.max("b").alias("high")).where("leads AND (NOT only OR low < high)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours its least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, its least neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")


def connected_components(edges: DataFrame, rounds: int = 60, stored: bool = False) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; a component's id is its least node.

    Each round is written to the shared folder, so a lost executor never repeats earlier rounds; edges
    that are ``stored`` already needn't be written first. All work is in joins and grouped minima; a node
    with very many edges is pre-aggregated, and its join is split by adaptive execution. An empty table
    gives an empty table.
    """
    current = _forest(edges) if stored else durable(_forest(edges), "edges")
    for _ in range(rounds):
        after = durable(_forest(_small_star(_large_star(current))), "edges")
        discard(current)
        current = after
        if _settled(current):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import cut


def _seal(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(links: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b), any order and repeats, to (node, component): the smallest node that can be reached.

    Every round halves, roughly, the distance to the smallest node; a round is two grouped minima joined back, so
    a node with very many links is pre-aggregated and its join can be split. Nodes without a link to another are
    not returned. An empty table gives no rows."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seal = _seal(edges)
    if not seal[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours and the node itself go to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = cut(small, label)
        new = _seal(edges)
        if new == seal:
            break
        seal = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component")).distinct()

"""Deterministic generated tables for tests, from spark.range and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.expr import draw_key, draw_number


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (draw_number(draw_key(seed, *parts)) + 0.5) / F.lit(float(1 << 32))


def normal(seed: int, *parts: Column | str) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *parts))) * F.cos(2 * F.pi() * uniform(seed + 1, *parts))


def bulk(spark: SparkSession, n_samples: int, features: list[str], seed: int = 42) -> DataFrame:
    """(sample, feature, value): values around 6, cut to 0 ... 15."""
    names = F.explode(F.array(*map(F.lit, features))).alias("feature")
    rows = spark.range(n_samples).select(F.format_string("SAMPLE_%04d", "id").alias("sample"), names)
    return rows.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(15.0), 6 + 2 * normal(seed, "sample", "feature"))))


def clinical(spark: SparkSession, n_samples: int, seed: int = 42) -> DataFrame:
    stages = F.array(*map(F.lit, ("I", "II", "III", "IV")))
    rows = spark.range(n_samples).select(F.format_string("SAMPLE_%04d", "id").alias("sample"))
    return rows.select(
        "sample",
        F.get(stages, F.floor(4 * uniform(seed, "sample")).cast("int")).alias("stage"),
        (-30 * F.log(uniform(seed + 7, "sample"))).alias("os_time"),
        (uniform(seed + 9, "sample") < 0.4).cast("int").alias("os_event"),
        F.when(uniform(seed + 11, "sample") < 0.8, "tumor").otherwise("normal").alias("tissue_type"),
    )


def counts(spark: SparkSession, n_cells: int, features: list[str], density: float = 0.3, seed: int = 42) -> DataFrame:
    """(cell, feature, value) without zeros."""
    names = F.explode(F.array(*map(F.lit, features))).alias("feature")
    rows = spark.range(n_cells).select(F.format_string("cell_%05d", "id").alias("cell"), names)
    return rows.where(uniform(seed, "cell", "feature") < density).withColumn("value", 1 + F.floor(-2 * F.log(uniform(seed + 3, "cell", "feature"))).cast("double"))


def network(spark: SparkSession, n_nodes: int, n_edges: int, types: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges)."""
    nodes = spark.range(n_nodes).select(F.format_string("n%04d", "id").alias("node_id"), F.lit("gene").alias("node_type"))
    end = lambda s: F.format_string("n%04d", F.floor(n_nodes * uniform(s, F.col("id"))).cast("int"))
    kind = F.get(F.array(*map(F.lit, types)), F.floor(len(types) * uniform(seed + 5, F.col("id"))).cast("int"))
    edges = spark.range(n_edges).select(end(seed).alias("src"), end(seed + 2).alias("dst"), kind.alias("edge_type"), F.round(uniform(seed + 6, F.col("id")), 3).alias("weight"))
    return nodes, edges.where("src <> dst")

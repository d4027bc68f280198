"""Sharding by global byte-size prefix sums.

Rows are put in one global order, every partition adds up its own sizes, the running total of those few
sums gives each partition its offset, and the global prefix sum of a row decides its shard. Shards are
contiguous in the order, and each differs from the equal target by less than two rows' sizes.

Defined cases: a null text has size ``overhead`` and checksum 0; a null id comes first; rows with equal ids
are ordered by checksum and size, and equal rows are interchangeable; a very long text is one row; an empty table gives no rows; columns
other than the id and the text are ignored. A row larger than a whole target leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import cut


def global_order(rows: DataFrame, keys: list[str], sums: list[str], label: str) -> DataFrame:
    """``rows`` with ``row_index`` (0, 1, ... in the order of ``keys``) and, for each column c of ``sums``, the sum
    of c over the rows before (``before_c``) and over all rows (``all_c``). One range shuffle of ``rows``; only a row
    for each partition meets in one task."""
    ranged = cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), label)
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{c}").over(upto), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # offsets has one row for each partition of the range shuffle: bounded by spark.sql.shuffle.partitions
    return ranged.join(F.broadcast(offsets), "_part").select(
        *rows.columns,
        (F.col("_n0") + F.count(F.lit(1)).over(inside)).alias("row_index"),
        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
    )


def _placed(docs: DataFrame, n_shards: int, overhead: int, id_col: str, text_col: str, own: list[Column]) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the columns ``own``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + overhead).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *own)
    placed = global_order(rows, ["doc_id", "text_crc32", "size"], ["size"], "sharding").withColumn(
        "shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * before_size + size) * {n_shards}) div (2 * all_size)")).cast("int")
    )
    first = placed.groupBy("shard").agg(F.min("row_index").alias("_first"))
    # first has at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select(*rows.columns, "shard", (F.col("row_index") - F.col("_first")).alias("slot"))


def assign_shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot (gapless from 0 in the shard).

    A row goes to the shard in which the middle of its bytes falls."""
    return _placed(docs, n_shards, overhead, id_col, text_col, [])


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` to ``path``, a folder ``_shard=N`` for each shard, its rows in the order of their slots. Whole rows are placed, so ids may repeat or be null."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    placed = _placed(docs, n_shards, overhead, id_col, text_col, [own]).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select(F.col("shard").alias("_shard"), *[F.col(f"own.`{c}`").alias(c) for c in docs.columns]).write.partitionBy("_shard").parquet(path)

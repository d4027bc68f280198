"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

1. Each document has a size (words). Sources get weights by their place in code-point order, in turn from ``weights``, and share all words by weight; no source's
   target exceeds ``most`` times its size, and what is over goes to the others by weight. The level at which that ends is found from prefix sums over the sources,
   in the order in which they reach their limit.
2. A document of a source is expected (target / source size) times. Expected copies are integers in units of 2^-30, so sums of them are exact in any order.
3. The documents of a source are put in order of size. Their expected copies are added up: per partition of a range shuffle and source first, then inside each. One
   random offset a source is added, and a document is emitted once for each integer that its own stretch of the sum crosses.

Neighbours in the order have almost the same size and any stretch of it gets its expected copies to within one, so the words taken differ from the target by less
than the largest document of the source. No document is emitted more than ``most`` times. No source meets in one task: rows of a hot one lie in as many
partitions as its share of the rows asks for.

Defined cases: a null text has no words; a null source is a source of its own, the last; a null id is an id; documents of equal size go by id and then by a checksum of
the text, and equal rows are interchangeable; a source without words takes none; a very long text is one row, in ``mix`` too; an empty table gives no rows; other columns
are ignored or, in ``mix``, passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import SPACE, cut, split_words
from tallgrass.llm.sharding import global_order

#: One copy, in the units in which expected copies are added up.
UNIT = 1 << 30
_SOURCE = ("no_source", "source")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sources`` (no_source, source, source_size) with ``target`` and ``expected``, the copies of each document in units of 1 / UNIT."""
    named = global_order(sources, list(_SOURCE), [], "mixing-sources")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("row_index") % len(weights) + 1).cast("int"))
    limited = named.select(*sources.columns, turn.cast("long").alias("weight"), (most * F.col("source_size")).alias("cap"))
    limited = limited.withColumn("reach", F.col("cap").cast("double") / F.col("weight"))
    # in the order in which sources reach their limit: those before a source are full, the rest of the words goes to it and those behind by weight
    filled = cut(global_order(limited, ["reach", *_SOURCE], ["weight", "cap", "source_size"], "mixing-levels"), "mixing-filled")
    rest, open_weight = (F.col("all_source_size") - F.col("before_cap")).cast("double"), (F.col("all_weight") - F.col("before_weight")).cast("double")
    opens = F.min_by(F.struct(F.col("row_index").alias("at"), rest.alias("rest"), open_weight.alias("weight")), "row_index")
    level = filled.where(rest * F.col("weight") <= F.col("cap") * open_weight).agg(opens.alias("level")).first()["level"]  # three numbers; the first source that stays open
    at, share, of = (level["at"], level["rest"], level["weight"]) if level else (0, 0.0, 1.0)
    full = F.col("row_index") < at
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.lit(share) * F.col("weight") / F.lit(of))
    size = F.when(F.col("source_size") > 0, F.col("source_size").cast("double"))
    expected = F.when(full, F.lit(most * UNIT)).otherwise(F.least(F.floor(F.col("target") / size * UNIT), F.lit(most * UNIT)))
    return filled.withColumn("target", target).select(*_SOURCE, "source_size", "target", F.coalesce(F.when(size > 0, expected), F.lit(0)).cast("long").alias("expected"))


def _offset(source: str, seed: int) -> Column:
    """A number in [0, UNIT) for each source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(source)).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 2)


def _drawn(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, names: tuple[str, str, str], own: list[Column]) -> DataFrame:
    id_col, text_col, source_col = names
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.size(split_words(F.col(text_col), SPACE)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("check"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        *own,
    )
    order = ["size", "doc_id", "check"]
    counted = cut(rows, "mixing-sizes")  # words are counted once: the range shuffle reads its input twice
    ranged = cut(counted.repartitionByRange(*_SOURCE, *order).withColumn("part", F.spark_partition_id()), "mixing-ranges")
    totals = cut(ranged.groupBy("part", *_SOURCE).agg(F.count("*").alias("n"), F.sum("size").alias("size")), "mixing-totals")
    aims = cut(targets(totals.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size")), weights, most), "mixing-targets")
    upto = Window.partitionBy(*_SOURCE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that has rows of the source
    begins = totals.join(aims, list(_SOURCE)).select(
        "part", *_SOURCE, "source_size", "target", "expected", (_offset("source", seed) + F.coalesce(F.sum(F.col("n") * F.col("expected")).over(upto), F.lit(0))).alias("begin")
    )
    inside = Window.partitionBy("part", *_SOURCE).orderBy(*order)
    at = F.col("begin") + (F.row_number().over(inside) - 1) * F.col("expected")
    placed = ranged.join(begins, ["part", *_SOURCE]).withColumn("at", at)
    copies = F.expr(f"(at + expected) div {UNIT} - at div {UNIT}")
    return placed.select(*rows.columns, "source_size", "target", copies.alias("copies"))


def sample(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken (words)."""
    drawn = _drawn(docs, weights, most, seed, (id_col, text_col, source_col), [])
    return drawn.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` with their own columns, each as often as ``sample`` takes it. Whole rows are placed, so ids may repeat or be null."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    drawn = _drawn(docs, weights, most, seed, (id_col, text_col, source_col), [own]).where("copies > 0")
    return drawn.select("own", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])

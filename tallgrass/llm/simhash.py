"""SimHash near-duplicate classes by deletion-variant signatures.

A 64-bit fingerprint is cut into ``max_distance // 2 + 1`` segments, so that of any two fingerprints that differ in
at most ``max_distance`` bits one segment differs in at most one. Each segment is indexed under itself with one bit
wild, once for every bit; fingerprints that share a variant meet in an equality join and are verified on all bits.

A variant that more than ``most_in_bucket`` distinct fingerprints share would emit all pairs within a group. Its
members are linked by another exact way instead: two fingerprints differ in at most two bits exactly if their balls of
radius one have a point in common, so every member is sent to the 65 points of its ball, and each point's members (at
most 65, all within two bits of each other) are linked to the smallest of them. This joins the same components and
grows with the members, not with their pairs.

Copies never meet as documents: links are between distinct fingerprints, and documents get their class by a join.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; a null id takes part but
is never a class id unless all ids of the class are null; repeated rows get equal results; a very long text is hashed whole, word by word; a bit
that exactly half of the shingles set is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.common import cut, text_key
from tallgrass.llm.components import connected_components

_BITS = 64
#: Shingles whose bits are unpacked at once: bounds memory for very long texts.
_CHUNK = 1 << 15
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the ``hashes`` (">u8") have."""
    counts = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint, unsigned: a bit is set if it is set in over half the shingles' hashes."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return _hash(b" ".join(words))
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(words[i : n + i] for i in range(shingle)), strict=True))), ">u8", n)
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): key is a hash of the text, fp the fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), fp(F.col(text_col)).alias("fp"))



def _signed(x: int) -> int:
    return x - (1 << _BITS) if x >> (_BITS - 1) else x


def variants(fps: DataFrame, n_segments: int) -> DataFrame:
    """(bucket, rest, fp): each segment with one bit wild; ``bucket`` numbers the wild bit, ``rest`` is the segment without it."""
    width = -(-_BITS // n_segments)
    masks = [_signed(((1 << min(width, _BITS - at)) - 1) << at & ~(1 << bit)) for bit in range(_BITS) for at in [bit // width * width]]
    return fps.select("fp", F.posexplode(F.array(*map(F.lit, masks))).alias("bucket", "mask")).select(
        "bucket", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp"
    )


def _ball(fps: DataFrame) -> DataFrame:
    """(fp, point): each fingerprint with itself and the 64 points at one bit's distance."""
    flips = [0, *(_signed(1 << bit) for bit in range(_BITS))]
    return fps.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))


def links(fps: DataFrame, max_distance: int = 2, most_in_bucket: int = 16) -> DataFrame:
    """Verified links (a, b) between the distinct fingerprints ``fps`` (fp): all of them from the smaller buckets, and
    from the larger ones as many as join the same components."""
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance is 0, 1 or 2")
    # fingerprints are few bytes that become 64 rows each, so their partitions are not to be merged by size; the variants are dealt once and serve
    # both the count and the join
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = variants(fps.repartition(n, "fp"), max_distance // 2 + 1).repartition("bucket", "rest")
    sizes = spread.groupBy("bucket", "rest").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(spread.join(sizes, ["bucket", "rest"]), "simhash-members")
    few = members.where(f"n <= {most_in_bucket}")
    met = few.select("bucket", "rest", F.col("fp").alias("a")).join(few.select("bucket", "rest", F.col("fp").alias("b")), ["bucket", "rest"])
    found = met.where(F.expr(f"a < b and bit_count(a ^ b) <= {max_distance}")).select("a", "b").distinct()
    # of one segment with one bit wild there are two fingerprints at most, so only max_distance 2 has crowded buckets
    points = _ball(members.where(f"n > {most_in_bucket}").select("fp").distinct())
    first = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    return found.union(points.join(first, "point").where("fp <> a").select("a", F.col("fp").alias("b")).distinct())


def _rooted(prints: DataFrame, rep: Column, max_distance: int) -> DataFrame:
    """(fp, rep, root): the aggregate ``rep`` of each fingerprint's rows, and the fingerprint that stands for its class."""
    reps = prints.groupBy("fp").agg(rep.alias("rep"))
    edges = cut(links(reps.select("fp"), max_distance), "simhash-links")
    roots = connected_components(edges, "simhash-components").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), fingerprint (hex), component_id (the
    smallest id that can be reached over links, its own included)."""
    prints = cut(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    rooted = _rooted(prints, F.min("doc_id"), max_distance)
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that have the smallest id in their class, one for each class."""
    prints = cut(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    best = _rooted(prints, rep, max_distance).groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.doc_id").alias("_tg_id"), F.col("rep.key").alias("_tg_best"))
    kept = docs.withColumn("_tg_key", text_key(F.col(text_col))).join(best, F.col(id_col).eqNullSafe(F.col("_tg_id")) & (F.col("_tg_key") == F.col("_tg_best")), "left_semi")
    if not prints.groupBy("doc_id", "key").count().where("count > 1").isEmpty():  # rows with equal id and text
        kept = kept.dropDuplicates([id_col, "_tg_key"])
    return kept.drop("_tg_key")

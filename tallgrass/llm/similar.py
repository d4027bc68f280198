"""Near-duplicate classes by SimHash and MinHash, verified by the Jaccard similarity of word shingles on the shingle sets themselves.

SimHash goes first: fingerprints of the shingle sets that differ in at most two bits are found by their deletion variants (``simhash.links``), and the pairs that they propose are verified. What
is in one class by then is not compared again. At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, and a distance of 16, which would find nearly all, leaves segments
that tell nothing apart. So the other candidates come from MinHash: ``BANDS`` bands of ``ROWS`` minima each. A pair of similarity 0.8 shares a band but
for (1 - 0.8 ** 4) ** 24 = 3 in a million, a pair of 0.3 with a probability of 0.18, and unrelated texts with a common passage hardly ever. Every candidate
is verified: its shared shingles are at least ``least`` of its union.

Texts with equal shingle sets are one node. Bands that few nodes share give all pairs. In crowded ones all nodes are compared with four leaders; bands
whose nodes are not of one class after that are compared pair by pair, but for pairs within the largest class, in blocks that are dealt over tasks and return
as many links as join the same classes.

Shingles are taken as 64-bit hashes. Defined cases: a text of fewer words than a shingle is one shingle; null and wordless texts are one class; a null id takes
part and is kept only if all ids of its class are null; of rows with equal id and text one is kept; a very long text is shingled whole; a similarity of exactly
``least`` links, and of equal ids the smallest text hash is kept; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm import simhash
from tallgrass.llm.common import cut, text_key
from tallgrass.llm.components import connected_components

BANDS, ROWS = 24, 4
_CHUNK = 1 << 13
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_rng = np.random.default_rng(20)
_FLIP, _TIMES = (_rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    words = (text or "").encode().lower().split()  # as SimHash has them: only A-Z are lowered, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i : n + i] for i in range(shingle)), strict=True)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(_hash, parts), np.uint64, n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; equal keys mean equal minima in the band."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        low = np.minimum(low, ((hashes[at : at + _CHUNK] ^ _FLIP) * _TIMES).min(1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), seed=b) for b, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def _signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, node, n, fp, bands): node is a hash of the shingle set, n its size, fp its fingerprint."""

    @F.pandas_udf("node long, n int, fp long, bands array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(x, shingle) for x in texts]
            node = np.array([_hash(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fps = np.array([simhash.majority(s.astype(">u8")) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"node": node, "n": np.array([len(s) for s in sets], np.int32), "fp": fps, "bands": [band_keys(s).view(np.int64) for s in sets]})

    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), sign(F.col(text_col)).alias("s"))
    return rows.select("doc_id", "key", "s.*")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """(node, hs) for the ``nodes`` (node, key)."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(x, shingle).view(np.int64) for x in texts])

    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).join(nodes, "key").groupBy("node").agg(F.min("text").alias("text"))
    return cut(texts.select("node", hs("text").alias("hs")), "similar-sets")


def _alike(shared, a, b, least: float):
    return shared >= least * (a + b - shared) - 1e-9


def _blocks(torn: DataFrame, sets: DataFrame, least: float, most_in_block: int) -> DataFrame:
    """(a, b): links between ``torn`` (band, node, root) of one band and different roots, enough to join the same classes."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").reset_index(drop=True)
        size = rows["hs"].map(len).to_numpy()
        spots = np.repeat(np.arange(len(rows)), size)
        ids = np.unique(np.concatenate([np.asarray(x, np.int64) for x in rows["hs"]]), return_inverse=True)[1]
        order = np.argsort(ids, kind="stable")
        holders = np.split(spots[order], np.flatnonzero(np.diff(ids[order])) + 1)
        shared = np.zeros((len(rows), len(rows)), np.int32)
        for h in holders:
            if len(h) > 1:
                shared[np.ix_(h, h)] += 1
        parent = {r: r for r in rows["root"]}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        node, root = rows["node"].tolist(), rows["root"].tolist()
        code = np.unique(rows["root"], return_inverse=True)[1]
        for i, j in np.argwhere(np.triu(_alike(shared, size[:, None], size[None, :], least) & (code[:, None] != code[None, :]), 1)):
            a, b = find(root[i]), find(root[j])
            if a != b:
                parent[a] = b
                found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    # nodes of a band's largest root need no comparison with each other, only with the rest
    each = torn.groupBy("band", "root").agg(F.count("*").alias("k"))
    main = each.groupBy("band").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("all"))
    pieces = [F.ceil(x / most_in_block).cast("long").alias(n) for x, n in ((F.col("main.k"), "n_main"), (F.col("all") - F.col("main.k"), "n_rest"))]
    rows = torn.join(main.select("band", F.col("main.root").alias("main"), *pieces), "band").withColumn("h", F.xxhash64("node"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    ours, rest = rows.where("root = main").withColumn("own", F.expr("pmod(h, n_main)")), rows.where("root <> main").withColumn("own", F.expr("pmod(h, n_rest)"))
    dealt = ours.select("band", F.lit("main").alias("kind"), upto("n_rest").alias("i"), F.col("own").alias("j"), "node", "root")
    dealt = dealt.union(rest.select("band", F.lit("main"), F.col("own"), upto("n_main"), "node", "root"))
    inner = rest.withColumn("other", upto("n_rest")).select("band", F.lit("rest"), F.least("own", "other"), F.greatest("own", "other"), "node", "root")
    return dealt.union(inner).join(sets, "node").groupBy("band", "kind", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _proposed(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, fp) that SimHash proposes. The smallest node of a fingerprint stands for it: it is paired with the others of its fingerprint, and with those that stand for
    the fingerprints within two bits."""
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    first, second = (heads.select(F.col("fp").alias(k), F.col("head").alias(to)) for k, to in (("a", "x"), ("b", "y")))
    near = simhash.links(heads.select("fp")).join(first, "a").join(second, "b").select("x", "y")
    return same.union(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(docs: DataFrame, prints: DataFrame, shingle: int = 5, least: float = 0.8, text_col: str = "text", most_in_band: int = 16, most_in_block: int = 200) -> DataFrame:
    """Verified links (a, b) between the nodes of ``prints``, as many as join all that a band brings together."""
    spark = docs.sparkSession
    nodes = prints.groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bands").alias("bands")).where("n > 0")
    proposed = cut(_proposed(nodes.select("node", "fp")), "similar-proposed")
    shared = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.select("node", "n", F.explode("bands").alias("band")).repartition(shared, "band")
    leaders = [f("node") for f in (F.min, F.max)] + [f("node", F.xxhash64("node")) for f in (F.min_by, F.max_by)]
    sizes = spread.groupBy("band").agg(F.count("*").alias("n_nodes"), *[x.alias(f"to{i}") for i, x in enumerate(leaders)]).where("n_nodes > 1")
    members = cut(spread.join(sizes, "band"), "similar-members")
    few, crowd = members.where(f"n_nodes <= {most_in_band}"), members.where(f"n_nodes > {most_in_band}")
    near = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    pairs = few.select("band", F.col("node").alias("a"), "n").join(few.select("band", F.col("node").alias("b"), F.col("n").alias("m")), "band").where("a < b").where(near).select("a", "b")
    led = crowd.select("node", F.explode(F.array("to0", "to1", "to2", "to3")).alias("to")).where("node <> to")
    pairs = cut(pairs.union(led.select(F.least("node", "to"), F.greatest("node", "to"))).distinct(), "similar-pairs")
    used = pairs.union(proposed).select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).distinct()
    sets = _sets(docs, nodes.join(used, "node", "left_semi").select("node", "key"), shingle, text_col)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b")
        return both.where(_alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), least)).select("a", "b")

    close = cut(verified(proposed), "similar-close")
    root = connected_components(close, "similar-closest").select("node", F.col("component").alias("root"))
    left, right = (root.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    apart = pairs.join(left, "a", "left").join(right, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    found = close.union(cut(verified(apart.select("a", "b")), "similar-links"))
    if crowd.isEmpty():
        return found
    roots = connected_components(found, "similar-led").select("node", F.col("component").alias("root"))
    crowd = crowd.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    torn = crowd.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    rest = cut(crowd.join(torn, "band", "left_semi"), "similar-torn")
    return found if rest.isEmpty() else found.union(cut(_blocks(rest, sets, least, most_in_block), "similar-blocks"))


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that have the smallest id in their class, one for each class."""
    prints = cut(_signatures(docs, shingle, id_col, text_col), "similar-signatures")
    roots = connected_components(links(docs, prints, shingle, least, text_col), "similar-components").select("node", F.col("component").alias("root"))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    reps = prints.groupBy("node").agg(rep.alias("rep")).join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("rep").alias("rep"))
    best = reps.select(F.col("rep.doc_id").alias("_tg_id"), F.col("rep.key").alias("_tg_best"))
    kept = docs.withColumn("_tg_key", text_key(F.col(text_col))).join(best, F.col(id_col).eqNullSafe(F.col("_tg_id")) & (F.col("_tg_key") == F.col("_tg_best")), "left_semi")
    if not prints.groupBy("doc_id", "key").count().where("count > 1").isEmpty():  # rows with equal id and text
        kept = kept.dropDuplicates([id_col, "_tg_key"])
    return kept.drop("_tg_key")

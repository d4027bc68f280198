"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every item-sized window is a set of word shingles, and containing it means having all of its shingles. So one shingle
of a window is a sufficient prefix, and the rarest one in the corpus is taken: shingles are ordered by how often the
documents have them, windows with a shingle that no document has are dropped, and only the rarest is joined. A joined
pair fixes where the window would begin; the length bound (the document has as many words) and the positional bound
(the window begins and ends inside it) come next, and the words themselves are compared last.

Documents take part with the shingles that items have. That set is joined as a broadcast only while its size is
counted to be at most ``most_broadcast``; beyond, the join shuffles.

Defined cases: null and wordless texts have no words, no windows and no hits; an item of fewer words than a window is one
window; equal windows of several items all count; a null item id is left out; rows with equal id and text share one
result; rows with equal id and other text have their own; a very long text is read whole, as one array of words; of equally rare shingles
the one with the smallest hash is joined, which changes no result; empty tables give no hits or no rows; other columns are ignored or, in
``drop_contaminated``, passed through.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import ascii_lower, cut, split_words

#: All ASCII but letters and digits; words are what lies between, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _hash(words: str, size: int, at: Column) -> Column:
    """The hash of the ``size`` words of column ``words`` from ``at`` on."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def _shingles(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The shingles of ``size`` words of column w: keys, w, n_words, pos (0-based), sh (hash)."""
    placed = rows.where(F.size("w") >= size).select(*keys, "w", F.posexplode("w").alias("pos", "_word")).where(F.col("pos") <= F.size("w") - size)
    return placed.select(*keys, "w", F.size("w").alias("n_words"), "pos", _hash("w", size, F.col("pos")).alias("sh"))


def windows_of(items: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: win (hash), ws (words), size (words in a shingle), shs (hashes of the shingles), item_ids (of all items that have it)."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    cutouts = rows.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1)), lambda i: F.slice("w", i, window))).alias("ws"))
    each = cutouts.groupBy("ws").agg(F.collect_set("item_id").alias("item_ids"))
    size = F.least(F.lit(shingle), F.size("ws"))
    hashes = F.lit(None)
    for s in range(1, shingle + 1):
        places = F.sequence(F.lit(0), F.size("ws") - s)
        hashes = F.when(size == s, F.transform(places, partial(_hash, "ws", s))).otherwise(hashes)
    return each.select(F.xxhash64("ws").alias("win"), "ws", size.alias("size"), hashes.alias("shs"), "item_ids")


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, most_broadcast: int = 1_000_000) -> DataFrame:
    """``docs`` (key columns and w) to the key columns, start, n (words of the window) and item_ids, for each window at each place where it occurs."""
    keys = [c for c in docs.columns if c != "w"]
    wins = cut(windows_of(items, window, shingle), "decontaminate-windows")
    wanted = cut(wins.select("size", F.explode("shs").alias("sh")).distinct(), "decontaminate-shingles")
    sizes = [r["size"] for r in wanted.groupBy("size").count().collect()]  # at most ``shingle`` rows
    n_wanted = wanted.count()
    hits = None
    for s in sorted(sizes):
        of = wanted.where(F.col("size") == s).select(F.col("sh").alias("_sh"))
        lead = window - s  # words before a shingle that a window may hold
        begin = F.greatest(F.col("pos") - lead, F.lit(0))
        around = [*keys, "n_words", "pos", "sh", begin.alias("begin"), F.slice("w", begin + 1, lead + window).alias("around")]
        part, same = _shingles(docs, keys, s), F.col("sh") == F.col("_sh")
        if n_wanted <= most_broadcast:
            part = part.join(F.broadcast(of), same, "left_semi").select(*around)
        else:  # only the words around a shingle are shuffled, not its document
            part = part.select(*around).join(of, same, "left_semi")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = docs.select(*keys, F.lit(0).alias("n_words"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("sh"), F.lit(0).alias("begin"), F.col("w").alias("around")).where("false")
    hits = cut(hits, "decontaminate-hits")
    often = hits.groupBy("sh").agg(F.count("*").alias("often"))
    # the rarest shingle of each window that has all of its shingles somewhere
    each = wins.select("win", "ws", "item_ids", F.posexplode("shs").alias("offset", "sh")).join(often, "sh", "left")
    prefix = each.groupBy("win", "ws").agg(F.min(F.struct("often", "sh", "offset")).alias("p"), F.min(F.col("often").isNotNull()).alias("all"), F.first("item_ids").alias("item_ids")).where("all")
    prefix = cut(prefix.select("ws", "item_ids", F.size("ws").alias("n"), F.col("p.sh").alias("_sh"), F.col("p.offset").alias("offset")), "decontaminate-prefixes")
    small = F.broadcast(prefix) if prefix.count() <= most_broadcast // 16 else prefix
    start = F.col("pos") - F.col("offset")
    return (
        hits.join(small, F.col("sh") == F.col("_sh"))
        .where((F.col("n_words") >= F.col("n")) & (start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .where(F.slice("around", start - F.col("begin") + 1, F.col("n")) == F.col("ws"))
        .select(*keys, start.alias("start"), "n", "item_ids")
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("key"), words(text).alias("w"))
    found = occurrences(rows, items, window, shingle).select("doc_id", "key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("word"), "item_ids")
    # a document's own words and items meet: first in a row for each place, so that repeats go before the shuffle
    per = found.groupBy("doc_id", "key", "word").agg(F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
    per = per.groupBy("doc_id", "key").agg(F.count("*").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    per = per.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n_hit", "item_ids")
    base = rows.select("doc_id", "key", F.size("w").cast("long").alias("n_words"))
    return base.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no window occurs, with their own columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text, F.octet_length(text))
    hit = occurrences(docs.select(key.alias("key"), words(text).alias("w")), items, window, shingle).select(F.col("key").alias("_tg_hit")).distinct()
    return docs.join(hit, key == F.col("_tg_hit"), "left_anti")

"""Audit of how sources of a language differ in their words: byte-level terms, counts in sparse matrices, divergences in whole numbers.

1. A task takes the texts of a batch as the one UTF-8 buffer in which Arrow has them. A table of 256 entries says of each byte whether it belongs to a term, and
   as what (A-Z become a-z); where that changes, and where a text begins, a term begins or ends. Terms are grouped by the xxHash of their slices, all bytes of each
   slice are compared with those of the first slice of its group, and slices that differ are grouped by their bytes instead.
2. Counts are added up by (lang, source, term), with the number of documents. A language keeps the terms of ``least_docs`` documents.
3. The kept counts of a language are dealt into blocks of terms of about ``block`` counts, each with the list of all sources of the language. A task makes of a block a
   sparse matrix, sources by terms, in compressed rows. For a source b, the divergence of every source from b is what it would be without the source's own counts, plus
   what each count changes: that is evaluated at the stored counts only and added up within the rows by ``reduceat``. Blocks' sums are added up by pair.
4. Terms that a source has more of than its language are ranked; each block sends the ``top`` of each source only.

Shares and divergences are whole numbers: p = 1 + floor(10^9 (count + 1) / (total + terms)), f = floor((p - q)^2 / q).

The pairs of sources within a language are the result, so it grows with the square of their number; a task makes them for up to ``chunk`` sources b at a time.

Defined cases: null text, language and source are empty strings; a text without terms makes its (language, source) occur; a very long text is read in
pieces that end between terms, and still is one document; equal values are ranked by the item's bytes; repeated rows count as often as they are there; a
language without kept terms has divergences of zero between its sources; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import cut

SCALE_STEPS, STEP = 3, 1000  # shares are in units of 1000^-3
_PIECE = 1 << 22  # bytes that are tokenized at a time
_COMPARED = 1 << 18  # slices that are compared at a time


def _table() -> np.ndarray:
    """What each byte is within a term; zero for bytes between terms."""
    out = np.zeros(256, np.uint8)
    out[0x80:] = np.arange(0x80, 0x100)
    out[0x61:0x7B] = np.arange(0x61, 0x7B)
    out[0x41:0x5B] = out[0x61:0x7B]
    return out


TABLE = _table()


def slices(buffer: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, first, last + 1 of each term) of texts that begin at ``begins`` in a buffer."""
    low = TABLE[buffer]
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = low != 0
    opens, shuts = inside[:-1].copy(), inside[:-1].copy()
    opens[1:] &= ~inside[:-2]
    shuts &= ~inside[1:]
    joints = begins[(begins > 0) & (begins < len(low))]
    opens[joints] = inside[joints]
    shuts[joints - 1] = inside[joints - 1]
    return low, np.flatnonzero(opens), np.flatnonzero(shuts) + 1


def grouped(low: np.ndarray, first: np.ndarray, last: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each slice's group, one slice of each group): slices are in a group if their bytes are equal."""
    data = low.tobytes()
    hashes = np.fromiter((digest(data[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
    group, found = pd.factorize(hashes)
    head = np.zeros(len(found), np.int64)
    head[group[::-1]] = np.arange(len(group) - 1, -1, -1)  # the first slice of each
    length = last - first
    rep = head[group]
    same = length == length[rep]
    for at in range(0, len(first), _COMPARED):
        run = at + np.flatnonzero(same[at : at + _COMPARED])
        # every byte of each slice beside the byte of the group's first slice
        inner = np.arange(length[run].sum()) - np.repeat(np.cumsum(length[run]) - length[run], length[run])
        unlike = low[np.repeat(first[run], length[run]) + inner] != low[np.repeat(first[rep[run]], length[run]) + inner]
        if unlike.any():
            same[np.unique(np.repeat(run, length[run])[unlike])] = False
    if not same.all():
        own: dict[bytes, int] = {}
        heads = head.tolist()
        for i in np.flatnonzero(~same).tolist():
            word = data[first[i] : last[i]]
            if word not in own:
                own[word] = len(heads)
                heads.append(i)
            group[i] = own[word]
        head = np.array(heads)
    return group, head


def _counted(buffer: np.ndarray, begins: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, bytes, int, int]]:
    """(kind, term, n, documents) of texts; ``kind`` is a number for each text."""
    low, first, last = slices(buffer, begins)
    if not len(first):
        return
    group, head = grouped(low, first, last)
    doc = np.searchsorted(begins, first, side="right") - 1
    spot, spots = pd.factorize(kind[doc] * len(head) + group)
    n = np.bincount(spot, minlength=len(spots))
    met, once = pd.factorize(doc * len(head) + group)
    where = np.zeros(len(once), np.int64)
    where[met] = spot  # of each term of a text
    docs = np.bincount(where, minlength=len(spots))
    data = low.tobytes()
    words = [data[first[i] : last[i]] for i in head.tolist()]
    for spot, a, b in zip(spots.tolist(), n.tolist(), docs.tolist(), strict=True):
        yield spot // len(head), words[spot % len(head)], a, b


def _pieces(text: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A text cut at bytes between terms; a piece is longer than ``size`` only if one term is."""
    at = 0
    while at < len(text):
        to = min(at + size, len(text))
        if to < len(text):
            gaps = np.flatnonzero(TABLE[text[at:to]] == 0)
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < len(text) and TABLE[text[to]]:
                    to += 1
        yield text[at:to]
        at = to


def _batch(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    column = pc.cast(batch.column("text"), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
    numbers = {k: i for i, k in enumerate(dict.fromkeys(names))}
    keys, kind = list(numbers), np.array([numbers[k] for k in names])
    at = 0
    while at < len(kind):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        if offsets[to] - offsets[at] > size:  # one long text
            total: Counter = Counter()
            for piece in _pieces(data[offsets[at] : offsets[to]], size):
                for _, word, n, _ in _counted(piece, np.zeros(1, np.int64), np.zeros(1, np.int64)):
                    total[word] += n
            rows = [(int(kind[at]), word, n, 1) for word, n in total.items()]
        else:
            rows = list(_counted(data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at], kind[at:to]))
        if rows:
            which, words, n, docs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i][0] for i in which]), pa.array([keys[i][1] for i in which]), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        at = to


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", piece: int = _PIECE) -> DataFrame:
    """(lang, source, term, n, docs): how often a term is in the texts of a source, and in how many of them."""
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batch(batch, piece)

    counted = clean.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 n / total) for 0 <= n <= total, without a product that a long cannot hold."""
    out, rest = np.zeros_like(n + total), n + np.zeros_like(total)
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        out, rest = out * STEP + rest // total, rest % total
    return 1 + out


def surprise(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def pair_sums(row: np.ndarray, col: np.ndarray, n: np.ndarray, totals: np.ndarray, n_terms: int, kept_terms: int, of: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(b, the divergence of every source from b over these terms). Counts are given by row, a source, and column, a term; ``totals`` are of all ``kept_terms`` terms of the language."""
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    indptr = np.searchsorted(row, np.arange(len(totals) + 1))
    p, none = share(n[order] + 1, totals[row] + kept_terms), share(np.ones_like(totals), totals + kept_terms)
    full = np.flatnonzero(np.diff(indptr))
    for b in of:
        own = slice(indptr[b], indptr[b + 1])
        q = np.full(n_terms, none[b])
        q[col[own]] = p[own]
        value = n_terms * surprise(none, none[b])
        wide = max(1, (1 << 21) // len(totals))  # what b's counts change for sources that have none
        for at in range(own.start, own.stop, wide):
            value += (surprise(none[:, None], p[None, at : min(at + wide, own.stop)]) - surprise(none, none[b])[:, None]).sum(1)
        if len(full):
            value[full] += np.add.reduceat(surprise(p, q[col]) - surprise(none[row], q[col]), indptr[full])
        yield b, value


_FOUND = "lang string, source string, part string, item string, value long"


def _block(top: int):
    def run(key: tuple, counts: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        lang, _, chunk = key
        sources = sources.sort_values("source").reset_index(drop=True)
        names, totals = sources["source"].to_numpy(object), sources["total"].to_numpy(np.int64)
        kept = int(sources["kept"].iloc[0])
        terms, col = np.unique(counts["term"].to_numpy(object).astype(object), return_inverse=True) if len(counts) else (np.array([], object), np.array([], np.int64))
        row = pd.Index(names).get_indexer(counts["source"])
        n = counts["n"].to_numpy(np.int64)
        out = [pd.DataFrame({"lang": [], "source": [], "part": [], "item": [], "value": []})]
        for b, value in pair_sums(row, col, n, totals, len(terms), kept, np.flatnonzero(sources["chunk"] == chunk).tolist()):
            out.append(pd.DataFrame({"lang": lang, "source": np.delete(names, b), "part": "pair", "item": names[b], "value": np.delete(value, b)}))
        if chunk == 0 and len(n):
            q = share(np.bincount(col, n, len(terms)).astype(np.int64) + 1 if n.sum() < 1 << 53 else _exact(col, n, len(terms)) + 1, np.full(len(terms), totals.sum() + kept))[col]
            p = share(n + 1, totals[row] + kept)
            more = np.flatnonzero(p > q)
            value = surprise(p[more], q[more])
            # terms are in the order of their code points, so a stable sort by value leaves ties in the order of their bytes
            order = np.lexsort((col[more], -value, row[more]))
            more, value = more[order], value[order]
            first = np.searchsorted(row[more], np.arange(len(names)))
            near = np.arange(len(more)) - first[row[more]] < top
            more, value = more[near], value[near]
            out.append(pd.DataFrame({"lang": lang, "source": names[row[more]], "part": "term", "item": terms[col[more]], "value": value}))
        return pd.concat(out, ignore_index=True).astype({"value": np.int64})

    return run


def _exact(col: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, col, n)
    return out


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200, block: int = 200_000, chunk: int = 256, piece: int = _PIECE
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source the divergence from every other source of its language, part ``pair``, and its ``top`` terms above the language's share, part ``term``."""
    counts = cut(term_counts(docs, text_col, lang_col, source_col, piece), "divergence-counts")
    term = Window.partitionBy("lang", "term")  # a row for each source that has the term
    kept = cut(
        counts.withColumns({"all": F.sum("docs").over(term), "head": F.min("source").over(term) == F.col("source")}).where(F.col("all") >= least_docs).select("lang", "source", "term", "n", "head"),
        "divergence-kept",
    )
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("stored"), F.count_if("head").alias("heads"))
    within = Window.partitionBy("lang")
    numbered = there.join(sums, ["lang", "source"], "left").select(
        "lang",
        "source",
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum("heads").over(within), F.lit(0)).cast("long").alias("kept"),
        F.ceil(F.coalesce(F.sum("stored").over(within), F.lit(0)) / block).cast("int").alias("blocks"),
        F.floor((F.row_number().over(within.orderBy("source")) - 1) / chunk).cast("int").alias("chunk"),
    )
    sources = cut(numbered.withColumn("blocks", F.greatest("blocks", F.lit(1))), "divergence-sources")
    languages = sources.groupBy("lang").agg(F.max("blocks").alias("blocks"), (F.max("chunk") + 1).alias("chunks"))
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part")
    dealt = kept.join(languages, "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), each)
    lists = sources.join(languages.select("lang", "chunks"), "lang").select("lang", "source", "total", "kept", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunks")
    lists = lists.select("lang", "source", "total", "kept", "chunk", "block", each)
    keys = ["lang", "block", "part"]
    found = cut(dealt.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(_block(top), _FOUND), "divergence-blocks")
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", F.row_number().over(rank).alias("rank")]
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select(*columns)
    terms = found.where("part = 'term'").select(*columns).where(F.col("rank") <= top)
    return pairs.union(terms)

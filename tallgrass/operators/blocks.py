"""Statistics of all pairs of features, from products of blocks.

Features are numbered and cut into blocks, samples are dealt into chunks. A task has the cells of two blocks in one chunk as dense matrices and multiplies them; what the chunks give is
added up row by row, 32 chunks at a time. A cell moves once for each block of features, never once for each other feature of its sample.

Defined cases: a null value is no cell; a pair counts the samples that have both features; a feature that is constant there has a null correlation; a cell that is there twice counts once;
an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.store import stored
from tallgrass.operators.order import running

_SUMS = 6  # n, sums of x, y, xx, yy and xy over samples that have both
_LEVEL = 32
#: Sets of a block at most, and members of a block of sets.
_SETS, _MEMBERS = 2048, 1 << 22


def _pack(width: int):
    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        samples, row = np.unique(cells["sample"].to_numpy(), return_inverse=True)
        data = np.full((len(samples), width), np.nan)
        data[row, cells["col"].to_numpy()] = cells["x"].to_numpy()
        return pd.DataFrame({"chunk": [key[0]], "block": [key[1]], "samples": [samples.tolist()], "data": [data.tobytes()]})

    return run


def _multiply(width: int):
    def run(key: tuple, packed: pd.DataFrame) -> pd.DataFrame:
        chunk, a, b = key
        by = {k: (s, np.frombuffer(d).reshape(-1, width)) for k, s, d in zip(packed["block"], packed["samples"], packed["data"], strict=True)}
        if a not in by or b not in by:
            return pd.DataFrame({"chunk": [], "a": [], "b": [], "row": [], "data": []})
        _, i, j = np.intersect1d(by[a][0], by[b][0], assume_unique=True, return_indices=True)
        x, y = by[a][1][i], by[b][1][j]
        m, k = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        sums = np.stack([m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y], 1)
        used = np.flatnonzero(sums[:, 0].any(1))
        return pd.DataFrame({"chunk": chunk, "a": a, "b": b, "row": used, "data": [sums[r].tobytes() for r in used]})

    return run


def _add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(d) for d in parts["data"]], axis=0)
    return pd.DataFrame({"chunk": [key[3]], "a": [key[0]], "b": [key[1]], "row": [key[2]], "data": [total.tobytes()]})


def pairs(long: DataFrame, least: float | None = None, sample: str = "sample", feature: str = "feature", value: str = "value", width: int = 256, per_chunk: int = 2048) -> DataFrame:
    """(src, dst, n, r, product) of pairs of features, src before dst by name, and of each feature with itself: the samples that have both, Pearson's r over them, and the mean product of
    the values less their features' means. With ``least``, only pairs with |r| over it, and no feature with itself."""
    cells = long.where(F.col(value).isNotNull()).select(F.col(sample).alias("sample"), F.col(feature).alias("feature"), F.col(value).cast("double").alias("value"))
    names = stored(running(cells.groupBy("feature").agg(F.avg("value").alias("mean")), [F.asc("feature")], None, "at"), "block-features")
    size = names.agg(F.max("at").alias("n")).first()["n"] or 0
    n_chunks = max(1, -(-int(cells.agg(F.approx_count_distinct("sample").alias("n")).first()["n"]) // per_chunk))
    n_blocks = max(1, -(-size // width))
    at = F.col("at") - 1
    placed = cells.join(names, "feature").select(
        F.pmod(F.xxhash64("sample"), F.lit(n_chunks)).cast("int").alias("chunk"), F.floor(at / width).cast("int").alias("block"), (at % width).cast("int").alias("col"), "sample", (F.col("value") - F.col("mean")).alias("x")
    )
    kind = dict(placed.dtypes)["sample"]
    packed = placed.groupBy("chunk", "block").applyInPandas(_pack(width), f"chunk int, block int, samples array<{kind}>, data binary")
    sent = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other"))
    keyed = sent.select("chunk", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "samples", "data")
    schema = "chunk int, a int, b int, row int, data binary"
    sums = keyed.groupBy("chunk", "a", "b").applyInPandas(_multiply(width), schema)
    while n_chunks > 1:
        sums = sums.groupBy("a", "b", "row", F.expr(f"chunk div {_LEVEL}").cast("int").alias("chunk")).applyInPandas(_add, schema)
        n_chunks = -(-n_chunks // _LEVEL)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "row", "data")), strict=True):
                n, sx, sy, sxx, syy, sxy = np.frombuffer(data).reshape(_SUMS, width)
                with np.errstate(invalid="ignore", divide="ignore"):
                    spread = np.maximum(sxx - sx * sx / n, 0) * np.maximum(syy - sy * sy / n, 0)
                    r = np.where(spread > 1e-24 * np.maximum(sxx * syy, 1e-300), (sxy - sx * sy / n) / np.sqrt(spread), np.nan)
                keep = (n > 0) & ((np.arange(width) >= row) if a == b else True)
                if least is not None:
                    keep &= (np.abs(r) > least) & ((np.arange(width) != row) if a == b else True)
                j = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), a * width + row + 1), pa.int64()), pa.array(b * width + j + 1, pa.int64()), pa.array(n[j].astype(np.int64)), pa.array(r[j], from_pandas=True), pa.array(sxy[j] / n[j])], ["i", "j", "n", "r", "product"]
                )

    done = sums.mapInArrow(finished, "i long, j long, n long, r double, product double")
    first, second = names.select(F.col("at").alias("i"), F.col("feature").alias("src")), names.select(F.col("at").alias("j"), F.col("feature").alias("dst"))
    return done.join(first, "i").join(second, "j").select("src", "dst", "n", "r", "product")


def shared_items(sets: DataFrame, least: float, term: str = "term", item: str = "item", width: int | None = None, per_chunk: int = 4096) -> DataFrame:
    """(src, dst, shared, jaccard) of pairs of sets (term, item) with a Jaccard similarity of ``least`` (> 0) or more, src before dst by name.

    Sets are cut into blocks and items into chunks. A block's sets in a chunk are a matrix of bits, or a list of its ones where that is shorter. A task has the chunks of two blocks and adds up what their
    sets share, chunk by chunk, by products of 0/1 matrices. Names and sizes travel with the blocks and pairs are written where they are counted, a few rows of a block at a time: what is shuffled are the
    blocks, once for each other block, and never a pair or a count. ``width``: the sets of a block, as many as have about ``_MEMBERS`` members if none is given. Null terms and items are no members."""
    members = stored(sets.where(F.col(term).isNotNull() & F.col(item).isNotNull()).select(F.col(term).alias("term"), F.col(item).alias("item")).distinct(), "set-members")
    names = stored(running(members.groupBy("term").agg(F.count("*").alias("n")), [F.asc("term")], None, "at"), "set-names")
    items = stored(running(members.select("item").distinct(), [F.asc("item")], None, "place"), "set-items")
    seen = names.agg(F.max("at").alias("sets"), F.sum("n").alias("members")).first()
    if width is None:
        width = max(64, min(_SETS, (seen["sets"] or 0) // 16, _MEMBERS * (seen["sets"] or 0) // (seen["members"] or 1)))
    n_blocks = -(-(seen["sets"] or 0) // width) or 1
    kind = dict(names.dtypes)["term"]

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        col, spot = rows["col"].to_numpy("<i4"), rows["spot"].to_numpy("<i4")
        used = int(spot.max()) + 1  # items of the chunk
        bits = width * -(-used // 8) <= 8 * len(col)
        if bits:
            cells = np.zeros((width, used), bool)
            cells[col, spot] = True
            cells = np.packbits(cells, axis=1)
        else:
            cells = np.stack([col, spot])
        return pd.DataFrame({"chunk": [key[0]], "block": [key[1]], "used": [used if bits else -used], "cells": [cells.tobytes()]})

    def name(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("col")  # a block's sets are numbered without a gap
        return pd.DataFrame({"block": [key[0]], "terms": [rows["term"].tolist()], "sizes": [rows["n"].tolist()]})

    def matrix(used: int, cells: bytes, size: int) -> np.ndarray:
        if used > 0:
            x = np.unpackbits(np.frombuffer(cells, np.uint8).reshape(width, -1), axis=1, count=used).astype(np.float32)
        else:
            col, spot = np.frombuffer(cells, "<i4").reshape(2, -1)
            x = np.zeros((width, -used), np.float32)
            x[col, spot] = 1
        return x[:, :size]

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), table = (k.as_py() for k in key), pa.Table.from_batches(batches).combine_chunks()
        total, own, named = np.zeros((width, width), np.int32), {}, {}
        for k, (block, chunk, used) in enumerate(zip(*(table.column(c).to_pylist() for c in ("block", "chunk", "used")), strict=True)):
            if chunk is None:
                named[block] = [table.column(c)[k].values for c in ("terms", "sizes")]
            else:
                own.setdefault(chunk, {})[block] = (used, k)
        for chunk in own.values():
            if a in chunk and b in chunk:
                size = min(abs(chunk[k][0]) for k in (a, b))
                x, y = (matrix(chunk[k][0], table.column("cells")[chunk[k][1]].as_py(), size) for k in (a, b))
                total += (x @ y.T).astype(np.int32)  # below 2 ** 24 in a chunk, so exact
        (src, n1), (dst, n2) = named[a], named[b]
        total, n1, n2 = total[: len(src), : len(dst)], n1.to_numpy(), n2.to_numpy()
        for at in range(0, len(src), 64):
            shared = total[at : at + 64]
            either = n1[at : at + 64, None] + n2[None, :] - shared
            alike = (shared > 0) & (shared / np.maximum(either, 1) >= least)
            i, j = np.nonzero(np.triu(alike, 1 + at) if a == b else alike)
            yield pa.RecordBatch.from_arrays(
                [src.take(pa.array(i + at)), dst.take(pa.array(j)), pa.array(shared[i, j].astype(np.int64)), pa.array(shared[i, j] / either[i, j])], ["src", "dst", "shared", "jaccard"]
            )

    at, place = F.col("at") - 1, F.col("place") - 1
    spot = F.floor(at / width).cast("int").alias("block"), (at % width).cast("int").alias("col")
    placed = members.join(names, "term").join(items, "item").select(F.floor(place / per_chunk).cast("int").alias("chunk"), *spot, (place % per_chunk).cast("int").alias("spot"))
    cells = placed.groupBy("chunk", "block").applyInPandas(pack, "chunk int, block int, used int, cells binary")
    heads = names.select(*spot, "term", "n").groupBy("block").applyInPandas(name, f"block int, terms array<{kind}>, sizes array<long>")
    packed = stored(cells.unionByName(heads, allowMissingColumns=True), "set-blocks")
    sent = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    # as many tasks as pairs of blocks need, a few to each
    dealt = sent.repartition(max(8, n_blocks * (n_blocks + 1) // 2 // 4), "a", "b")
    return dealt.groupBy("a", "b").applyInArrow(count, f"src {kind}, dst {kind}, shared long, jaccard double")

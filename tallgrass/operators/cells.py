"""Cell-level preparation on sparse counts (cell, feature, value): absent entries are zeros."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.expr import draw_key, ratio
from tallgrass.operators.order import tiles

#: Vectors of a block, queries that a task multiplies at a time, and what six digits and the rounding of a product can move a similarity.
_VECTORS, _QUERIES, _MARGIN = 8192, 32, 2e-6


def qc_metrics(counts: DataFrame, prefix: str, cell: str = "cell", feature: str = "feature") -> DataFrame:
    """(cell, n_features, total, pct_prefix): detected features, library size, and the share of features with a prefix."""
    own = F.sum(F.when(F.col(feature).startswith(prefix), F.col("value")).otherwise(0.0))
    per = counts.groupBy(cell).agg(F.count_if(F.col("value") > 0).alias("n_features"), F.sum("value").alias("total"), own.alias("_own"))
    return per.withColumn("pct_prefix", F.coalesce(100 * ratio("_own", "total"), F.lit(0.0))).drop("_own")


def qc_filter(counts: DataFrame, metrics: DataFrame, low: int, high: int, most_pct: float, least_cells: int, cell: str = "cell", feature: str = "feature") -> DataFrame:
    """Cells with low ... high features and at most ``most_pct``, then features in at least ``least_cells`` of those cells."""
    good = metrics.where((F.col("n_features") >= low) & (F.col("n_features") <= high) & (F.col("pct_prefix") <= most_pct)).select(cell)
    kept = counts.join(good, cell, "left_semi")
    features = kept.where("value > 0").groupBy(feature).agg(F.countDistinct(cell).alias("n")).where(F.col("n") >= least_cells).select(feature)
    return kept.join(features, feature, "left_semi")


def retained(before: DataFrame, after: DataFrame, group: str, cell: str = "cell") -> DataFrame:
    """(group, n_before, n_after, share)."""
    a = before.groupBy(group).agg(F.countDistinct(cell).alias("n_before"))
    b = after.groupBy(group).agg(F.countDistinct(cell).alias("n_after"))
    return a.join(b, group, "full_outer").fillna(0, ["n_before", "n_after"]).withColumn("share", ratio("n_after", "n_before"))


def log_normalise(counts: DataFrame, scale: float = 1e4, cell: str = "cell") -> DataFrame:
    """log1p of counts per ``scale``; a cell without counts gives zeros. Totals are an aggregate joined back."""
    totals = counts.groupBy(cell).agg(F.sum("value").alias("_total"))
    return counts.join(totals, cell).withColumn("value", F.log1p(F.coalesce(scale * ratio("value", "_total"), F.lit(0.0)))).drop("_total")


def sparse_moments(counts: DataFrame, n_cells: int | None = None, feature: str = "feature", cell: str = "cell") -> DataFrame:
    """(feature, mean, var) over all cells, absent ones as zeros; without ``n_cells``, the distinct cells of ``counts`` are counted."""
    sums = counts.groupBy(feature).agg(F.sum("value").alias("_sum"), F.sum(F.col("value") * F.col("value")).alias("_squares"))
    if n_cells is None:
        sums = sums.crossJoin(F.broadcast(counts.agg(F.countDistinct(cell).cast("double").alias("_n"))))
    else:
        sums = sums.withColumn("_n", F.lit(float(n_cells)))
    mean, square = F.col("_sum") / F.col("_n"), F.col("_squares") / F.col("_n")
    return sums.select(feature, mean.alias("mean"), (square - mean * mean).alias("var"))


def top_variance(moments: DataFrame, n: int, feature: str = "feature") -> DataFrame:
    return moments.orderBy(F.desc("var"), feature).limit(n)


def binned_dispersion(moments: DataFrame, n_bins: int, feature: str = "feature") -> DataFrame:
    """With dispersion = var / mean, its bin by mean rank, and its z-score in the bin."""
    rows = tiles(moments.where("mean > 0").withColumn("dispersion", F.col("var") / F.col("mean")), [F.asc("mean"), F.asc(feature)], n_bins, "bin").withColumn("bin", F.col("bin").cast("long"))
    of = Window.partitionBy("bin")
    sd = F.stddev_samp("dispersion").over(of)
    return rows.withColumn("z", F.coalesce((F.col("dispersion") - F.avg("dispersion").over(of)) / F.when(sd > 0, sd), F.lit(0.0)))


def marker_scores(counts: DataFrame, markers: DataFrame, cells: DataFrame, cell: str = "cell", feature: str = "feature") -> DataFrame:
    """(cell, module, score): raw mean over a module's markers that are anywhere in the table, zeros included."""
    there = markers.join(counts.select(feature).distinct(), feature, "left_semi").select("module", feature).distinct()
    sizes = there.groupBy("module").agg(F.count("*").alias("_k"))
    sums = counts.join(F.broadcast(there), feature).groupBy(cell, "module").agg(F.sum("value").alias("_s"))
    grid = cells.select(cell).join(F.broadcast(sizes))
    return grid.join(sums, [cell, "module"], "left").select(cell, "module", (F.coalesce("_s", F.lit(0.0)) / F.col("_k")).alias("score"))


def matched_control_score(counts_mean: DataFrame, z: DataFrame, module: DataFrame, n_bins: int, n_controls: int, seed: int, cell: str = "cell", feature: str = "feature") -> DataFrame:
    """(cell, score): mean of the module's features less the mean of control features drawn from the same bins of mean expression."""
    bins = tiles(counts_mean, [F.asc("mean"), F.asc(feature)], n_bins, "_bin")
    own = bins.join(F.broadcast(module.select(feature)), feature, "left_semi")
    pool = bins.join(F.broadcast(module.select(feature)), feature, "left_anti").join(F.broadcast(own.select("_bin").distinct()), "_bin")
    order = Window.partitionBy("_bin").orderBy(draw_key(seed, feature), feature)
    controls = pool.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n_controls).select(feature, F.lit(0).alias("_own"))
    members = own.select(feature, F.lit(1).alias("_own")).union(controls)
    mean = lambda k: F.avg(F.when(F.col("_own") == k, F.col("value")))
    return z.join(F.broadcast(members), feature).groupBy(cell).agg((mean(1) - mean(0)).alias("score"))


def subset(cells: DataFrame, group: str, n_groups: int, n: int, cell: str = "cell") -> DataFrame:
    """The first ``n`` cells of the first ``n_groups`` groups, by name."""
    first = cells.select(group).distinct().orderBy(group).limit(n_groups)
    order = Window.partitionBy(group).orderBy(cell)
    return cells.join(F.broadcast(first), group, "left_semi").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n).drop("_at")


def spot_scores(counts: DataFrame, modules: DataFrame, spots: DataFrame, spot: str = "spot", feature: str = "feature") -> DataFrame:
    """(spot, module, score): log1p(1e4 * module count / library) / module size."""
    library = counts.groupBy(spot).agg(F.sum("value").alias("_lib"))
    sizes = modules.groupBy("module").agg(F.countDistinct(feature).alias("_k"))
    sums = counts.join(F.broadcast(modules), feature).groupBy(spot, "module").agg(F.sum("value").alias("_m"))
    grid = spots.select(spot).join(library, spot, "left").join(F.broadcast(sizes))
    part = F.coalesce(1e4 * ratio(F.coalesce("_m", F.lit(0.0)), "_lib"), F.lit(0.0))
    return grid.join(sums, [spot, "module"], "left").select(spot, "module", (F.log1p(part) / F.col("_k")).alias("score"))


def _filled(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as a matrix, short ones filled up with zeros, and their lengths: -1 for a vector that is null or holds a null."""
    rows = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = pc.list_flatten(rows), np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    size[rows.is_null().to_numpy(zero_copy_only=False)] = -1
    size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, size


def _folded(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The scalar products of rows i of a and j of b, added up from the first place on, as ``graph.dot`` does."""
    out = np.zeros(len(i))
    for k in range(min(a.shape[1], b.shape[1])):
        out = out + a[i, k] * b[j, k]
    return out


def _six_digits(x: np.ndarray) -> np.ndarray:
    """As ``round`` does: halves of the shortest decimal form go up, away from zero."""
    scaled = np.abs(x) * 1e6
    out = np.floor(scaled + 0.5)
    for i in np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)[0]:
        out[i] = int(Decimal(repr(abs(float(x[i])))).scaleb(6).to_integral_value(ROUND_HALF_UP))
    return np.copysign(out, x)


def knn(vectors: DataFrame, queries: DataFrame, k: int, ident: str, vector: str, block: int = 4096) -> DataFrame:
    """(query, neighbour, similarity, rank): the k most similar vectors by cosine for a stated set of queries. Every vector is compared with every query: a block of vectors and one of ``block`` queries are a key,
    and a task multiplies them as matrices, some queries at a time. Pairs within ``_MARGIN`` of the k-th best of a block get their exact cosine, and the k best by it, in six digits, are kept of each block.

    Similarities that are not defined (a vector is zero, null or holds a null, or lengths differ) are null and come last; NaN comes first; rows without id are left out."""
    every = vectors.where(F.col(ident).isNotNull()).select(F.col(ident).alias("_n"), F.col(vector).cast("array<double>").alias("_v"))
    asked = queries.where(F.col(ident).isNotNull()).select(F.col(ident).alias("_q"), F.col(vector).cast("array<double>").alias("_v"))
    n_left, n_right = max(1, -(-every.count() // _VECTORS)), max(1, -(-asked.count() // block))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = every.select(F.pmod(F.xxhash64("_n"), F.lit(n_left)).alias("_i"), F.explode(numbers(n_right)).alias("_j"), "_n", "_v")
    right = asked.select(F.explode(numbers(n_left)).alias("_i"), F.pmod(F.xxhash64("_q"), F.lit(n_right)).alias("_j"), "_q", "_v")

    def best(some: pa.Table, wanted: pa.Table) -> pa.Table:
        (v, nv), (q, nq) = _filled(some.column("_v")), _filled(wanted.column("_v"))
        names, asks = (t.column(c).to_numpy() for t, c in ((some, "_n"), (wanted, "_q")))
        width = min(v.shape[1], q.shape[1])
        lv, lq = (np.sqrt(_folded(x, at, x, at)) for x, at in ((v, np.arange(len(v))), (q, np.arange(len(q)))))
        place = np.argsort(np.argsort(names, kind="stable"), kind="stable")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        with np.errstate(all="ignore"):
            for first in range(0, len(q) if len(v) else 0, _QUERIES):
                at = np.arange(first, min(first + _QUERIES, len(q)))
                size = lq[at][:, None] * lv[None, :]
                near = (q[at, :width] / lq[at][:, None]) @ (v[:, :width] / lv[:, None]).T
                near[~np.isfinite(near)] = np.inf
                none = (nq[at][:, None] != nv[None, :]) | (nq[at] < 0)[:, None] | (size == 0)
                near[none] = -np.inf
                own = asks[at][:, None] == names[None, :]
                near[own] = -np.inf
                least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(at), -np.inf)
                i, j = np.nonzero((near >= (least - _MARGIN)[:, None]) & ~own)
                exact = _folded(q, at[i], v, j) / size[i, j]
                by = np.where(none[i, j], -np.inf, np.where(np.isnan(exact), np.inf, _six_digits(np.where(np.isfinite(exact), exact, 0.0))))
                order = np.lexsort((place[j], -by, i))
                rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
                kept = order[rank < k]
                found.append((at[i[kept]], j[kept], np.where(none[i[kept], j[kept]], np.inf, exact[kept])))
        i, j, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": wanted.column("_q").take(pa.array(i)), "neighbour": some.column("_n").take(pa.array(j)), "similarity": pa.array(s, mask=np.isinf(s))})

    kind = {c: t.schema[c].dataType.simpleString() for t, c in ((every, "_n"), (asked, "_q"))}
    scored = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(best, f"query {kind['_q']}, neighbour {kind['_n']}, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")  # k rows of each block
    rounded = scored.withColumn("similarity", F.round("similarity", 6))
    return rounded.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

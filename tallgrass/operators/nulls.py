"""Null distributions: permutations, matched draws and bootstraps.

Draws are ordered by md5 of (seed, draw, id), so they are the same on every cluster and in other engines. Where scores are means of standardised
features, a draw needs the features' correlation matrix only, computed once: no draw touches the samples again."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.expr import draw_key, partial_corr, ratio
from tallgrass.functions.store import shuffles_dropped, stored
from tallgrass.operators import blocks
from tallgrass.operators.order import running

#: Hashes of a round of permutations, of a task's group and of a permutation's stretch, and places of a chunk.
_ROUND, _PART, _NODES, _CHUNK = 50_000_000, 500_000, 50_000, 16_384


def draws(universe: DataFrame, n: int, seed: int, sizes: dict[str, int], feature: str = "feature") -> DataFrame:
    """(draw, module, feature): disjoint random modules of the given sizes in each of ``n`` draws. A window for each draw over the feature universe."""
    order = Window.partitionBy("draw").orderBy(draw_key(seed, "draw", feature), feature)
    placed = universe.select(feature).distinct().select(feature, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw")).withColumn("_at", F.row_number().over(order))
    module, upto = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        module = F.when((F.col("_at") > upto) & (F.col("_at") <= upto + size), name).otherwise(module)
        upto += size
    return placed.withColumn("module", module).where("module is not null").select("draw", "module", feature)


def correlations(z: DataFrame, sample: str = "sample", feature: str = "feature") -> DataFrame:
    """(f, g, c): the mean product of z-scores for all ordered feature pairs of a panel, from products of blocks; for complete standardised columns this is their correlation."""
    table = stored(blocks.pairs(z, None, sample, feature, "z").select("src", "dst", "product"), "feature-correlations")
    both = table.select(F.col("src").alias("f"), F.col("dst").alias("g"), F.col("product").alias("c"))
    return both.union(table.where("src <> dst").select("dst", "src", "product"))


def module_corr(members: DataFrame, matrix: DataFrame, keys: list[str], pairs: list[tuple[str, str]], feature: str = "feature") -> DataFrame:
    """(keys, r_<a>_<b>): the correlation of the means of modules a and b, from the features' correlations."""
    a = members.select(*keys, F.col("module").alias("_a"), F.col(feature).alias("f"))
    b = members.select(*keys, F.col("module").alias("_b"), F.col(feature).alias("g"))
    joined = a.join(b, keys) if keys else a.crossJoin(b)
    sums = joined.join(matrix, ["f", "g"]).groupBy(*keys)

    def total(x: str, y: str) -> Column:
        return F.sum(F.when((F.col("_a") == x) & (F.col("_b") == y), F.col("c")).otherwise(0.0))

    out = {}
    for x, y in pairs:
        spread = total(x, x) * total(y, y)
        out[f"r_{x}_{y}"] = total(x, y) / F.when(spread > 0, F.sqrt(spread))
    return sums.agg(*[c.alias(k) for k, c in out.items()])


def empirical_p(null: DataFrame, observed: DataFrame, value: str, plus_one: bool = True) -> DataFrame:
    """One row: observed, n, null_mean, p; ``observed`` is a row with ``value``. (1 + #{null >= observed}) / (1 + n), or without the ones."""
    joined = null.select(F.col(value).alias("_null")).join(F.broadcast(observed.select(F.col(value).alias("observed"))))
    n, over = F.count("_null"), F.count_if(F.col("_null") >= F.col("observed"))
    p = ratio(over + 1, n + 1) if plus_one else ratio(over, n)
    return joined.groupBy("observed").agg(n.alias("n"), F.avg("_null").alias("null_mean"), p.alias("p"))


def partial_from(table: DataFrame, x: str, y: str, z: str) -> DataFrame:
    return table.withColumn("rp", partial_corr(f"r_{x}_{y}", f"r_{x}_{z}", f"r_{y}_{z}"))


def matched(null: DataFrame, observed: DataFrame, loading: str, tolerance: float, most: int | None = None, draw: str = "draw") -> DataFrame:
    """Draws whose |loading| is within +-tolerance of the observed one, the first ``most`` of them by number."""
    row = observed.select(F.abs(loading).alias("_o"))
    near = null.join(F.broadcast(row)).where(F.abs(F.abs(loading) - F.col("_o")) <= tolerance * F.col("_o")).drop("_o")
    return near if most is None else near.orderBy(draw).limit(most)


def permuted(values: DataFrame, n: int, seed: int, node: str, columns: list[str]) -> DataFrame:
    """(perm, node, columns): the values dealt anew over the nodes, ``n`` times: the k-th node by name gets those of the k-th in the order of md5(seed:perm:node)."""
    named = stored(running(values.select(node, *columns), [F.asc(node)], None, "_at"), "permuted-values")
    perms = named.select(F.col(node).alias("_node"), *columns, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm")).withColumn("_key", draw_key(seed, "perm", "_node"))
    dealt = running(perms, [F.asc("_key"), F.asc("_node")], ["perm"], "_at").select("perm", "_at", *columns)
    return dealt.join(named.select(node, "_at"), "_at").select("perm", node, *columns)


def _hashed(names: list[bytes], perm: int, seed: int) -> np.ndarray:
    """md5(seed:perm:name) of each name as two numbers, the first counting more."""
    head = f"{seed}:{perm}".encode()
    return np.frombuffer(b"".join([md5(head + x).digest() for x in names]), ">u8").reshape(-1, 2).astype(np.uint64)


def _names(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if x is None else b":" + x for x in batch.column("_name").cast(pa.binary()).to_pylist()]


def _stretch(keys: np.ndarray, stretches: int) -> np.ndarray:
    """Which of equal stretches of the hashes each one is in."""
    return ((keys[:, 0] >> np.uint64(32)) * np.uint64(stretches) >> np.uint64(32)).astype(np.int64)


_DEALT = "part int, stretch int, perm int, start long, keys binary, amounts binary"


def _dealt_sums(nodes: DataFrame, near: DataFrame, first: int, last: int, together: int, stretches: int, seed: int) -> DataFrame:
    """(perm, _s) of the permutations first ... last (last excluded), stored. ``nodes`` (_name, _a), ``near`` (chunk, amounts) by ``_CHUNK`` places."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, amounts = _names(batch), batch.column("_a").to_numpy(zero_copy_only=False)
            for begin in range(first, last, together):
                out: list[list] = [[] for _ in range(6)]
                for perm in range(begin, min(begin + together, last)):
                    keys = _hashed(names, perm, seed)
                    of = _stretch(keys, stretches)
                    order = np.argsort(of, kind="stable")
                    there, at = np.unique(of[order], return_index=True)
                    for stretch, own in zip(there, np.split(order, at[1:])):
                        for column, x in zip(out, ((begin - first) // together, int(stretch), perm, None, keys[own].tobytes(), amounts[own].tobytes())):
                            column.append(x)
                types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["part", "stretch", "perm", "start", "keys", "amounts"])

    def add_up(table: pa.Table) -> pa.Table:
        chunks, starts, packets = {}, {}, {}
        for perm, start, keys, amounts in zip(*(table.column(c).to_pylist() for c in ("perm", "start", "keys", "amounts"))):
            if perm is None:
                chunks[start] = np.frombuffer(amounts)
            elif keys is None:
                starts[perm] = start
            else:
                packets.setdefault(perm, []).append((np.frombuffer(keys, np.uint64).reshape(-1, 2), np.frombuffer(amounts)))
        begin, near = min(chunks), np.concatenate([chunks[k] for k in sorted(chunks)])
        sums = []
        for perm, own in packets.items():
            keys, amounts = np.concatenate([k for k, _ in own]), np.concatenate([x for _, x in own])
            at = starts[perm] - begin
            sums.append(float(np.dot(amounts[np.lexsort((keys[:, 1], keys[:, 0]))], near[at : at + len(amounts)])))
        return pa.table({"perm": pa.array(list(packets), pa.int32()), "_s": pa.array(sums, pa.float64())})

    dealt = nodes.mapInArrow(deal, _DEALT).persist(StorageLevel.DISK_ONLY)
    counts = dealt.groupBy("perm", "stretch").agg((F.sum(F.octet_length("keys")) / 16).cast("long").alias("n"))
    before = Window.partitionBy("perm").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    part = F.floor((F.col("perm") - first) / together).cast("int")
    starts = stored(counts.select(part.alias("part"), "stretch", "perm", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n"), "permuted-starts")
    span = starts.groupBy("part", "stretch").agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("n") - 1).alias("hi"))
    wanted = span.select("part", "stretch", F.explode(F.sequence(F.floor(F.col("lo") / _CHUNK), F.floor(F.col("hi") / _CHUNK))).alias("chunk"))
    slices = wanted.join(near, "chunk").select("part", "stretch", F.lit(None).cast("int").alias("perm"), (F.col("chunk") * _CHUNK).alias("start"), F.lit(None).cast("binary").alias("keys"), "amounts")
    none = F.lit(None).cast("binary")
    rows = dealt.union(starts.select("part", "stretch", "perm", "start", none, none)).union(slices)
    out = stored(rows.groupBy("part", "stretch").applyInArrow(add_up, "perm int, _s double").groupBy("perm").agg(F.sum("_s").alias("_s")), "permuted-sums")
    dealt.unpersist()
    return out


def permuted_products(values: DataFrame, n: int, seed: int, node: str, a: str, b: str) -> DataFrame:
    """(perm, _s): the sum over nodes of a times b, with a dealt anew over the nodes, ``n`` times: the k-th node by name gets the a of the k-th in the order of md5(seed:perm:node). Nulls count as zero.

    Hashes are packed into arrays and go to the task of their stretch of the hashes, for a few permutations together. What lies before a stretch is counted, so the places of its hashes are known, and only b of
    these places is sent to it. No task has a permutation whole, once nodes are more than ``_NODES``. Permutations are taken in rounds of about ``_ROUND`` hashes, and a round's hashes and shuffle files are
    dropped at its end, so the disk that is used does not grow with the nodes nor with ``n``."""
    zero = F.lit(0.0)
    placed = running(values.select(F.col(node), F.coalesce(F.col(a).cast("double"), zero).alias("_a"), F.coalesce(F.col(b).cast("double"), zero).alias("_b")), [F.asc(node)], None, "_at")
    named = stored(placed.select(F.col(node).cast("string").alias("_name"), "_a", "_b", (F.col("_at") - 1).alias("_at")), "permuted-values")
    n_nodes = named.count()
    if not n_nodes:
        return named.select(F.lit(None).cast("int").alias("perm"), F.col("_a").alias("_s")).where("false")

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_at").to_numpy())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "amounts": pa.array([table.column("_b").to_numpy()[order].tobytes()], pa.binary())})

    near = stored(named.select(F.floor(F.col("_at") / _CHUNK).alias("chunk"), "_at", "_b").groupBy("chunk").applyInArrow(pack, "chunk long, amounts binary"), "permuted-near")
    nodes = stored(named.select("_name", "_a").repartition(max(32, -(-n_nodes // _CHUNK))), "permuted-nodes")
    stretches, together, each = -(-n_nodes // _NODES), max(1, _PART // min(n_nodes, _NODES)), max(1, _ROUND // n_nodes)
    out = None
    for first in range(1, n + 1, each):
        last = min(first + each, n + 1)
        with shuffles_dropped(values.sparkSession):
            some = _dealt_sums(nodes, near, first, last, min(together, -(-(last - first) // 8)), stretches, seed)
        out = some if out is None else out.union(some)
    return out


def permuted_adjacency(edges: DataFrame, values: DataFrame, n: int, seed: int, a: str, b: str, node: str) -> DataFrame:
    """(perm, adjacency): the mean over edges of (a b' + a' b) / 2, with a dealt anew over the nodes; permutation 0 is the observed one. A null score adds nothing.

    The sum over edges is half the sum over nodes of a times what the neighbours have of b, so the edges are read once and a permutation is a product by node."""
    ends = edges.select("src", "dst").union(edges.select("dst", "src"))
    near = ends.join(values.select(F.col(node).alias("dst"), F.col(b).alias("_b")), "dst").groupBy(F.col("src").alias(node)).agg(F.sum("_b").alias("_near"))
    size = edges.agg(F.count("*").cast("double").alias("_edges")).where("_edges > 0")
    own = stored(values.select(node, F.col(a).alias("_a")).join(near, node, "left"), "permuted-own")
    observed = own.agg(F.lit(0).alias("perm"), F.sum(F.col("_a") * F.col("_near")).alias("_s"))
    sums = observed.union(permuted_products(own, n, seed, node, "_a", "_near"))
    return sums.join(F.broadcast(size)).select("perm", (F.col("_s") / (2 * F.col("_edges"))).alias("adjacency"))


def partial_many(x: str, y: str, controls: list[str]) -> Column:
    """The correlation of x and y without the controls, from columns r_<a>_<b>, by taking out one control after the other."""

    def r(a: str, b: str, taken: tuple[str, ...]) -> Column:
        if not taken:
            return F.col(f"r_{min(a, b)}_{max(a, b)}")
        last, rest = taken[-1], taken[:-1]
        return partial_corr(r(a, b, rest), r(a, last, rest), r(b, last, rest))

    return r(x, y, tuple(controls))


def grid(null: DataFrame, observed: DataFrame, controls: dict[str, list[str]], bands: dict[str, float | None], most: int, x: str = "a", y: str = "b", loading: str = "c") -> DataFrame:
    """(control, band, observed, null_mean, p95, n, p, specific): each set of controls against each band of loadings.

    ``null`` (draw, r_..) has all correlations of the draws, ``observed`` those of the modules. A draw is in a band if both modules' loadings (absolute) are within +- its tolerance of the observed ones; the
    first ``most`` of a cell by number count. All cells are filled from the draws in one pass."""
    names = [(k, b, t) for k in controls for b, t in bands.items()]
    cells = null.sparkSession.createDataFrame(names, "control string, band string, tolerance double")
    loads = {s: F.col(f"r_{min(s, loading)}_{max(s, loading)}") for s in (x, y)}

    def partial() -> Column:
        out = F.lit(None).cast("double")
        for k, c in controls.items():
            out = F.when(F.col("control") == k, partial_many(x, y, c)).otherwise(out)
        return out

    seen = observed.join(cells).select("control", "band", "tolerance", *[F.abs(c).alias(f"_o{s}") for s, c in loads.items()], partial().alias("observed"))
    inside = F.lit(True)
    for s, c in loads.items():
        inside = inside & (F.abs(F.abs(c) - F.col(f"_o{s}")) <= F.col("tolerance") * F.col(f"_o{s}"))
    met = null.join(F.broadcast(seen)).where(F.col("tolerance").isNull() | inside)  # a stated number of cells
    cells = met.select("draw", "control", "band", "observed", partial().alias("r")).where(F.col("r").isNotNull())
    first = Window.partitionBy("control", "band").orderBy("draw")  # of as many rows as draws
    kept = cells.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= most)
    over = F.count_if(F.col("r") >= F.col("observed"))
    found = kept.groupBy("control", "band", "observed").agg(F.avg("r").alias("null_mean"), F.percentile("r", F.lit(0.95)).alias("p95"), F.count("*").alias("n"), ratio(over + 1, F.count("*") + 1).alias("p"))
    return found.withColumn("specific", (F.col("p") < 0.05) & (F.col("observed") > F.col("null_mean")))


def drawn_means(values: DataFrame, n: int, size: int, seed: int, value: str, feature: str = "feature") -> DataFrame:
    """(draw, mean, mean_abs) of a value over ``size`` features drawn from all of ``values``: what a module of random features would have."""
    picked = draws(values, n, seed, {"drawn": size}, feature)
    return picked.join(values.select(feature, value), feature).groupBy("draw").agg(F.avg(value).alias("mean"), F.avg(F.abs(value)).alias("mean_abs"))

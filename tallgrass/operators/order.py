"""Ranks, running sums and quantiles of a whole table, without a task that sees all of it.

Ranks and running sums: one range shuffle puts the rows in order, each partition counts and adds up its own rows by group, and the few totals before a partition are
what its rows start from. A group may be all rows or a row.

Quantiles: sketches of bounded error bracket each order statistic, one pass counts what lies below, at and inside the bracket, and brackets with too many values are
refined in the same way. The driver gets a few numbers a pass and at last up to ``_FEW`` counted values for each bracket.

Defined cases: nulls come first in ranks, as groups too; null and NaN values have no part in quantiles; ties in the order share no promise about who comes first, so the
order should end with a key; an empty table gives no ranks and null quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.store import stored

#: Values of a bracket that the driver sorts, and the number of parts to one of which a sketch is exact.
_FEW, _ACCURACY = 50_000, 10_000


def running(rows: DataFrame, order: list[Column], groups: list[str] | None = None, rank: str | None = "rank", sums: dict[str, str] | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with their ``rank`` from 1 in the order within each group, with the sum of a column over all rows before (``sums``: new name -> column), and with the sum over the whole
    group (``totals``). A column "1" counts rows."""
    groups, sums, totals = groups or [], sums or {}, totals or {}
    amount = {c: F.lit(1) if c == "1" else F.col(c) for c in {*sums.values(), *totals.values(), "1"}}
    names = {c: f"_tg_{i}" for i, c in enumerate(sorted(amount))}
    ranged = stored(rows.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_tg_part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("_tg_part", *groups).agg(*[F.sum(x).alias(names[c]) for c, x in amount.items()])
    whole = Window.partitionBy(*groups)  # a row for each partition that has rows of the group
    upto = whole.orderBy("_tg_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(
        F.col("_tg_part").alias("_tg_at"),
        *[F.col(g).alias(f"_tg_g{i}") for i, g in enumerate(groups)],
        *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"{n}b") for n in names.values()],
        *[F.sum(n).over(whole).alias(f"{n}t") for n in names.values()],
    )
    same = F.col("_tg_part") == F.col("_tg_at")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_tg_g{i}"))
    inside = Window.partitionBy("_tg_part", *groups).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    added = {s: F.col(f"{names[c]}b") + F.coalesce(F.sum(amount[c]).over(before), F.lit(0)) for s, c in sums.items()}
    added |= {t: F.col(f"{names[c]}t") for t, c in totals.items()}
    if rank:
        added[rank] = (F.col(f"{names['1']}b") + F.row_number().over(inside)).cast("long")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in added]
    return ranged.join(begins, same).select(*kept, *[x.alias(c) for c, x in added.items()])


def tiles(rows: DataFrame, order: list[Column], n: int, out: str = "tile") -> DataFrame:
    """``rows`` with the number (from 1) of their part, when the order is cut into ``n`` parts whose sizes differ by one at most, larger parts first."""
    placed = running(rows, order, None, "_tg_rank", totals={"_tg_all": "1"})
    large = f"(_tg_all % {n}) * (_tg_all div {n} + 1)"  # rows in the larger parts
    part = F.expr(f"case when _tg_rank <= {large} then (_tg_rank - 1) div (_tg_all div {n} + 1) + 1 else _tg_all % {n} + (_tg_rank - 1 - {large}) div (_tg_all div {n}) + 1 end")
    return placed.withColumn(out, part.cast("int")).drop("_tg_rank", "_tg_all")


def average_ranks(rows: DataFrame, columns: list[str], groups: list[str] | None = None, prefix: str = "_rank_") -> DataFrame:
    """``rows`` with the rank of each column's value, ties sharing their mean. Distinct values are ranked with their counts, so ties do not meet in a task.

    The rows are stored first: ranks are joined to them by value, and a sum or mean that is computed again may differ in its last bit."""
    groups, rows = groups or [], stored(rows, "rank-rows")
    for c in columns:
        counted = rows.groupBy(*groups, c).agg(F.count("*").alias("_tg_n"))
        placed = running(counted, [F.asc(c)], groups, None, {"_tg_before": "_tg_n"})
        right = placed.select(*[F.col(g).alias(f"_tg_j{i}") for i, g in enumerate(groups)], F.col(c).alias("_tg_v"), (F.col("_tg_before") + (F.col("_tg_n") + 1) / F.lit(2.0)).alias(prefix + c))
        same = F.col(c).eqNullSafe(F.col("_tg_v"))
        for i, g in enumerate(groups):
            same = same & F.col(g).eqNullSafe(F.col(f"_tg_j{i}"))
        rows = rows.join(right, same).drop("_tg_v", *[f"_tg_j{i}" for i in range(len(groups))])
    return rows


def smallest_from_here(rows: DataFrame, value: str, order: list[Column], groups: list[str] | None = None, out: str = "least") -> DataFrame:
    """``rows`` with the smallest ``value`` of their own and all later rows of the order within their group."""
    groups = groups or []
    ranged = stored(rows.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_tg_part", F.spark_partition_id()), "ranges")
    behind = Window.partitionBy(*groups).orderBy(F.desc("_tg_part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_tg_part", *groups).agg(F.min(value).alias("_tg_least"))
    later = parts.select(F.col("_tg_part").alias("_tg_at"), *[F.col(g).alias(f"_tg_g{i}") for i, g in enumerate(groups)], F.min("_tg_least").over(behind).alias("_tg_later"))
    same = F.col("_tg_part") == F.col("_tg_at")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_tg_g{i}"))
    own = Window.partitionBy("_tg_part", *groups)
    # from the last row down: a frame that grows is added to row by row, one that shrinks is computed anew for each row
    numbered = ranged.join(later, same).withColumn("_tg_row", F.row_number().over(own.orderBy(*order)))
    here = own.orderBy(F.desc("_tg_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns], F.least("_tg_later", F.min(value).over(here)).alias(out))


def _clusters(places: list[int], near: float) -> list[list[int]]:
    """Sorted places, cut where neighbours are further apart than ``near``."""
    out = [[places[0]]]
    for k in places[1:]:
        out[-1].append(k) if k - out[-1][-1] <= near else out.append([k])
    return out


def _selected(rows: DataFrame, wanted: list[int], lo: float, hi: float) -> dict[int, float]:
    """The values of the column v at the places ``wanted`` (from 0) of its order; lo and hi are its smallest and largest value."""
    x, out = F.col("v"), {}

    def narrowed(a: float, b: float, below: int, mid: int, places: list[int], slack: float) -> tuple:
        """A bracket around places that lie among the ``mid`` values strictly between a and b."""
        edges = [max(0.0, (places[0] - below) / mid - slack), min(1.0, (places[-1] - below) / mid + slack)]
        low, high = rows.where((x > a) & (x < b)).agg(F.percentile_approx(x, edges, _ACCURACY).alias("e")).first()["e"]
        return low, high, places, (a, b, below, mid, 4 * slack)

    todo = [(lo, hi, wanted, None)]
    while todo:
        tests = [(f"{k}{i}", t) for i, (a, b, _, _) in enumerate(todo) for k, t in (("under", x < a), ("low", x == a), ("mid", (x > a) & (x < b)), ("high", x == b))]
        seen, again = rows.agg(*[F.count_if(t).alias(k) for k, t in tests]).first(), []
        for i, (a, b, places, wider) in enumerate(todo):
            under, low, mid = seen[f"under{i}"], seen[f"low{i}"], seen[f"mid{i}"]
            first, last = under + low, under + low + mid
            outside = [k for k in places if not under <= k < last + (seen[f"high{i}"] if a < b else 0)]
            if outside:  # the sketch was wrong by more than it promises
                again.append(narrowed(*wider[:4], outside, wider[4]))
            out |= {k: a for k in places if under <= k < first} | {k: b for k in places if last <= k and k not in outside and k >= first}
            inside = [k for k in places if first <= k < last]
            if inside and mid <= _FEW:
                at = first
                for r in rows.where((x > a) & (x < b)).groupBy("v").count().orderBy("v").collect():  # at most _FEW rows
                    out |= {k: r["v"] for k in inside if at <= k < at + r["count"]}
                    at += r["count"]
            elif inside:
                again += [narrowed(a, b, first, mid, c, 2 / _ACCURACY) for c in _clusters(inside, max(1.0, mid / _ACCURACY))]
        todo = again
    return out


def quantiles(rows: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """For each column the exact quantiles at the given shares, interpolated between neighbours as ``percentile`` does."""
    span = rows.agg(
        *[f(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"{k}{i}") for i, c in enumerate(wanted) for k, f in (("n", F.count), ("a", F.min), ("b", F.max))]
    ).first()
    out: dict[str, list[float | None]] = {}
    for i, (c, shares) in enumerate(wanted.items()):
        n = span[f"n{i}"]
        if not n:
            out[c] = [None] * len(shares)
            continue
        places = [(n - 1) * p for p in shares]
        values = rows.select(F.col(c).cast("double").alias("v")).where("v is not null and not isnan(v)")
        at = _selected(values, sorted({k for p in places for k in (math.floor(p), math.ceil(p))}), span[f"a{i}"], span[f"b{i}"])
        # equal neighbours are their own mean, without its rounding
        out[c] = [a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p in places for a, b in [(at[math.floor(p)], at[math.ceil(p)])]]
    return out

"""Ranks, running sums, tiles and quantiles over partitions against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import blocks, graph, order, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["hot"] * 5 + ["b", None]), rng.choice([None, 1.0, 2.0, rng.random(), rng.random() * 1e6, -3.5]), rng.randrange(5)) for i in range(900)]
    return data, spark.createDataFrame(data, "id long, grp string, x double, w long").repartition(7)


def test_ranks_and_running_sums_by_group(rows):
    data, df = rows
    got = {r["id"]: (r["rank"], r["before"], r["total"], r["n"]) for r in order.running(df, [F.asc("x"), F.asc("id")], ["grp"], "rank", {"before": "w"}, {"total": "w", "n": "1"}).collect()}
    assert len(got) == len(data)
    for g in {r[1] for r in data}:
        own = sorted((r for r in data if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0.0, r[0]))
        for k, r in enumerate(own):
            assert got[r[0]] == (k + 1, sum(o[3] for o in own[:k]), sum(o[3] for o in own), len(own))


def test_ranks_over_all_rows_in_falling_order(rows):
    data, df = rows
    got = {r["id"]: r["rank"] for r in order.running(df, [F.desc("w"), F.asc("id")]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r[0] for r in sorted(data, key=lambda r: (-r[3], r[0]))]
    assert order.running(df.where("false"), [F.asc("id")]).count() == 0


def test_smallest_from_here(rows):
    data, df = rows
    got = {r["id"]: r["least"] for r in order.smallest_from_here(df, "w", [F.asc("id")], ["grp"]).collect()}
    for g in {r[1] for r in data}:
        own = sorted(r for r in data if r[1] == g) if g else sorted((r for r in data if r[1] is None), key=lambda r: r[0])
        assert all(got[r[0]] == min(o[3] for o in own[k:]) for k, r in enumerate(own))


@pytest.mark.parametrize("n", [1, 7, 450, 900, 1300])
def test_tiles_are_those_of_ntile(rows, n):
    _, df = rows
    from pyspark.sql import Window

    want = {r["id"]: r["t"] for r in df.withColumn("t", F.ntile(n).over(Window.orderBy("w", "id"))).collect()}
    assert {r["id"]: r["tile"] for r in order.tiles(df, [F.asc("w"), F.asc("id")], n).collect()} == want


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, None), (3, 1.0, 2.0), (4, 9.0, 0.5)], "id int, x double, y double")
    got = {r["id"]: (r["_rank_x"], r["_rank_y"]) for r in order.average_ranks(df, ["x", "y"]).collect()}
    assert got == {1: (2.5, 3.5), 2: (2.5, 1.0), 3: (1.0, 3.5), 4: (4.0, 2.0)}


SHARES = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]


@pytest.mark.parametrize("few", [50_000, 3])
def test_quantiles_are_those_of_percentile(spark, rows, few, monkeypatch):
    monkeypatch.setattr(order, "_FEW", few)  # brackets are refined to the end
    _, df = rows
    frames = {"x": df, "w": df.select(F.col("w").cast("double").alias("w")), "one": df.select(F.lit(7.0).alias("one")), "cents": df.select((F.col("w") * 0.01 + 0.02).alias("cents")), "two": df.select(F.when(F.col("w") < 3, -1.0).otherwise(1e12).alias("two"))}
    for c, frame in frames.items():
        want = frame.agg(F.percentile(c, F.array(*map(F.lit, SHARES))).alias("q")).first()["q"]
        assert order.quantiles(frame, {c: SHARES})[c] == want


def test_quantiles_of_nothing_and_of_odd_numbers(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), -1e300), (float("nan"), 1e300), (3.0, None)], "a double, b double")
    assert order.quantiles(df, {"a": [0.5], "b": [0.5, 1.0]}) == {"a": [3.0], "b": [1.0, 1e300]}
    assert order.quantiles(df.where("false"), {"a": [0.1, 0.9]}) == {"a": [None, None]}


def test_a_sketch_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(order, "_FEW", 3)
    real, calls = F.percentile_approx, []

    def wrong(x, edges, accuracy):
        calls.append(1)
        return real(x, [0.9, 0.95] if len(calls) == 1 else edges, accuracy)  # the first bracket is far off

    monkeypatch.setattr(order.F, "percentile_approx", wrong)
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert order.quantiles(df, {"v": [0.1]})["v"] == [pytest.approx(99.9)]


def test_benjamini_hochberg_over_partitions(spark):
    rng = random.Random(2)
    data = [(i, "ab"[i % 2], None if i % 37 == 0 else round(rng.random() ** 3, 3)) for i in range(400)]
    df = spark.createDataFrame(data, "id int, grp string, p double").repartition(6)
    got = {r["id"]: r["q"] for r in stats.benjamini_hochberg(df, "p", "id", ["grp"]).collect()}
    for g in "ab":
        own = sorted((r for r in data if r[1] == g and r[2] is not None), key=lambda r: (r[2], r[0]))
        for k, r in enumerate(own):
            assert got[r[0]] == pytest.approx(min(1.0, min(o[2] * len(own) / (j + 1) for j, o in enumerate(own) if j >= k)))
    assert all(got[r[0]] is None for r in data if r[2] is None)


def test_pairs_by_blocks_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = rng.standard_normal((60, 23)) + 100
    values[:, 5] = 7.0  # constant
    values[:, 9] = values[:, 8] * 2 + 1
    there = rng.random((60, 23)) < 0.8
    there[:, 20] = False
    there[:3, 20] = True
    long = spark.createDataFrame([(f"s{i}", f"f{j:02d}", float(values[i, j]) if there[i, j] else None) for i in range(60) for j in range(23)], "sample string, feature string, value double").repartition(5)
    got = {(r["src"], r["dst"]): (r["n"], r["r"], r["product"]) for r in blocks.pairs(long, width=4, per_chunk=7).collect()}
    assert len(got) == sum(1 for a in range(23) for b in range(a, 23) if (there[:, a] & there[:, b]).any())
    for (a, b), (n, r, product) in got.items():
        i, j = int(a[1:]), int(b[1:])
        both = there[:, i] & there[:, j]
        x, y = values[both, i], values[both, j]
        assert n == both.sum()
        assert product == pytest.approx(((x - values[there[:, i], i].mean()) * (y - values[there[:, j], j].mean())).mean(), abs=1e-9)
        if n > 1 and x.std() > 1e-9 and y.std() > 1e-9:
            assert r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
        else:
            assert r is None
    strong = {(r["src"], r["dst"]) for r in graph.corr_edges(long, 0.5).collect()}
    assert strong == {k for k, v in got.items() if k[0] != k[1] and v[1] is not None and abs(v[1]) > 0.5} and ("f08", "f09") in strong
    assert blocks.pairs(long.where("false")).count() == 0


@pytest.mark.parametrize("least", [0.05, 0.4])
def test_jaccard_by_counts_equals_the_prefix_join(spark, least):
    rng = random.Random(9)
    sets = spark.createDataFrame([(t, i) for t in range(25) for i in range(40) if rng.random() < 0.3] + [(99, 1), (99, 1)], "term int, item int")
    a, b = (sorted((r["src"], r["dst"], r["shared"], round(r["jaccard"], 12)) for r in f(sets, least).collect()) for f in (graph.jaccard_counts, graph.jaccard_join))
    assert a == b and a


def test_many_features_need_no_self_join(spark):
    """5,000 features: 12.5 million pairs from products, of which only strong ones leave the tasks."""
    cells = spark.range(5000 * 20).select((F.col("id") % 20).alias("sample"), F.floor(F.col("id") / 20).alias("feature"), (F.xxhash64("id") % 1000).cast("double").alias("value"))
    edges = blocks.pairs(cells, 0.9)
    assert 0 <= edges.count() < 100_000
    assert not math.isnan(edges.agg(F.coalesce(F.max("r"), F.lit(0.0)).alias("r")).first()["r"])

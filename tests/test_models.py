"""Tabular baselines, transfer, residuals, and neighbours by blocks of queries."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.operators import cells, evaluation, graph, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((90, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.standard_normal(90) > 0).astype(int)
    return x, spark.createDataFrame([(i, int(y[i]), i % 2, *map(float, x[i])) for i in range(90)], "id int, y int, fold int, a double, b double, c double").repartition(3)


def test_baselines_on_folds(rows):
    _, df = rows
    names = ["elastic_net", "linear_svm"]
    assert set(names) < set(models.baselines(3))
    scored = models.cross_validated(df, ["a", "b", "c"], names, 2, "id")
    assert scored.groupBy("method").count().collect() and {(r["method"], r["count"]) for r in scored.groupBy("method").count().collect()} == {(n, 90) for n in names}
    auc = {(r["method"], r["fold"]): r["auroc"] for r in evaluation.auroc(scored, ["method", "fold"], "y", "score").collect()}
    assert len(auc) == 4 and all(auc[n, k] > 0.8 for n in names for k in (0, 1))


def test_transfer_and_residuals(rows):
    x, df = rows
    moved = models.transferred(df.where("fold = 0"), df.where("fold = 1"), ["a", "b", "c"], "elastic_net", "id")
    assert moved.count() == 45 and evaluation.auroc(moved.withColumn("all", F.lit(1)), ["all"], "y", "score").first()["auroc"] > 0.85
    left = {r["id"]: r["residual"] for r in models.residualised(df, "c", ["a", "b"]).collect()}
    design = np.c_[np.ones(90), x[:, :2]]
    want = x[:, 2] - design @ np.linalg.lstsq(design, x[:, 2], rcond=None)[0]
    assert np.array([left[i] for i in range(90)]) == pytest.approx(want, abs=1e-8)
    assert models.latent(df, ["a", "b", "c"], 2, "id").select(F.size("latent").alias("n")).distinct().collect()[0]["n"] == 2


@pytest.mark.parametrize("block", [4096, 3])
def test_neighbours_of_stated_queries(spark, rows, block):
    x, _ = rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(4)
    got = {(r["query"], r["rank"]): (r["neighbour"], r["similarity"]) for r in cells.knn(df, df.where("id % 10 = 0"), 4, "id", "v", block).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 9 * 4
    for q in range(0, 90, 10):
        near = sorted(((round(float(unit[q] @ unit[j]), 6), j) for j in range(90) if j != q), key=lambda p: (-p[0], p[1]))[:4]
        assert [got[q, k + 1] for k in range(4)] == [(j, pytest.approx(s)) for s, j in near]
    assert cells.knn(df, df.where("false"), 4, "id", "v").count() == 0


def test_neighbours_by_products_of_blocks(spark, monkeypatch):
    """Copies, zero vectors, nulls and lengths that differ, by blocks that are much smaller than the table; and no join of vectors with queries is left."""
    rng = np.random.default_rng(4)
    x = [rng.integers(-2, 3, 3).astype(float).tolist() for _ in range(120)] + [[0.0, 0.0, 0.0], None, [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(x)), "id int, v array<double>").repartition(3)
    for name, size in (("_VECTORS", 25), ("_QUERIES", 4)):
        monkeypatch.setattr(cells, name, size, raising=False)
    found = cells.knn(df, df.where("id % 10 = 0"), 6, "id", "v", 5)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
    pairs = df.select("id", "v").alias("a").join(df.alias("b"), F.expr("a.id % 10 = 0 and a.id <> b.id")).select(F.col("a.id").alias("query"), F.col("b.id").alias("neighbour"), F.col("a.v").alias("p"), F.col("b.v").alias("q"))
    scored = pairs.select("query", "neighbour", F.round(graph.cosine("p", "q"), 6).alias("similarity"))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    want = scored.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 6")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(found.columns).collect()))


def test_cross_validated_scores_are_stored(rows):
    """Reading the scores again does not score again: no model is left in the plan."""
    _, df = rows
    plan = models.cross_validated(df, ["a", "b", "c"], ["elastic_net"], 2, "id")._jdf.queryExecution().toString()
    assert "UDF" not in plan and "cross-validated" in plan

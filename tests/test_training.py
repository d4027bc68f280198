"""Classifiers fitted together against single fits, the matrix of variants, search with stored rungs, and importance by brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import fusion, importance


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((240, 6))
    y = (x @ np.array([2.0, -1.0, 0.5, 0, 0, 0]) + rng.standard_normal(240) * 0.5 > 0).astype(int)
    rows = [(f"s{i:03d}", int(y[i]), x[i].tolist()) for i in range(240)]
    odd = [(None, 1, [0.0] * 6), ("n1", None, [0.0] * 6), ("n2", 1, None), ("n3", 0, [1.0])]
    df = spark.createDataFrame(rows + odd, "id string, label int, features array<double>").repartition(5)
    design = fusion.Design({"a": rng.standard_normal((6, 3)), "b": rng.standard_normal((6, 3)), "merged": rng.standard_normal((6, 3))}, {"full": np.ones(6), "masked": np.r_[0.0, np.ones(5)]})
    return x, y, fusion.prepared(df, "id", "label", "features"), design


def alone(design, run, x, y, draw, steps):
    """One run by itself, with all rows in memory."""
    g = design.columns(x, run.mode)
    out = fusion.held_out(draw, run)
    mean, sd = g[~out].mean(0), g[~out].std(0)
    z = (g - mean) / np.where(sd > 1e-8, sd, 1.0)
    w, b = np.zeros(design.width), 0.0
    u, c = (np.full(design.dim, 0.01), np.zeros(len(run.views))) if run.views else (np.zeros(0), np.zeros(0))
    best, kept = np.inf, None
    for _ in range(steps + 1):
        views = [z[:, design.place(v)] for v in run.views]
        a = np.exp(c) / np.exp(c).sum() if len(c) else c
        fused = sum((k * v for k, v in zip(a, views)), np.zeros((len(z), len(u))))
        logit = b + z[:, :6] @ w + (fused @ u if len(u) else 0)
        p = 1 / (1 + np.exp(-logit))
        held = -np.mean((y * np.log(p) + (1 - y) * np.log(1 - p))[out])
        if held < best:
            best, kept = held, p
        e = (p - y)[~out]
        gu = fused[~out].T @ e / len(e) if len(u) else 0
        slope = np.array([(v[~out] @ u) @ e for v in views]) / len(e) if run.fused == "learned" else np.zeros(len(c))
        b, w, u, c = b - run.rate * e.mean(), w - run.rate * (z[~out, :6].T @ e / len(e) + run.penalty * w), (u - run.rate * (gu + run.penalty * u) if len(u) else u), (c - run.rate * a * (slope - a @ slope) if len(c) else c)
    return kept, best


def test_all_runs_together_equal_single_fits(cohort):
    x, y, rows, design = cohort
    draws = {r["key"]: r["draw"] for r in rows.collect()}
    draw = np.array([draws[f"s{i:03d}"] for i in range(240)])
    runs = fusion.matrix_of_runs(["a", "b"], ["full", "masked"], [1, 2])
    fitted = fusion.fit(rows, design, runs, 15)
    got = {}
    for r in fusion.predict(rows, fitted).collect():
        got.setdefault((r["variant"], r["mode"], r["seed"]), {})[r["key"]] = r["probability"]
    assert len(got) == len(runs) == 2 * 2 * 8
    for run, loss in zip(runs, fitted.held_out_loss):
        p, best = alone(design, run, x, y, draw, 15)
        own = got[run.name, run.mode, run.seed]
        assert len(own) == 240 and np.array([own[f"s{i:03d}"] for i in range(240)]) == pytest.approx(p, abs=1e-9) and loss == pytest.approx(best)
    assert fusion.missing_runs(fusion.predict(rows, fitted), runs).count() == 0


def test_variants_are_the_whole_matrix(spark, cohort):
    v = fusion.variants(["a", "b", "c"])
    assert set(v) == {"no_graph", "merged_svd", "uniform_multiview", "learned_multiview", *(f"{k}__{n}" for k in ("single", "leave_out") for n in "abc")}
    assert v["leave_out__b"] == (("a", "c"), "learned") and v["no_graph"] == ((), None) and v["single__a"] == (("a",), "uniform")
    runs = fusion.matrix_of_runs(["a"], ["full", "masked"], [1, 2])
    there = spark.createDataFrame([(r.name, r.mode, r.seed) for r in runs[:-1]], "variant string, mode string, seed int")
    assert [tuple(r) for r in fusion.missing_runs(there, runs).collect()] == [(runs[-1].name, "masked", 2)]


def test_weights_of_views_and_odd_tables(spark, cohort):
    _, _, rows, design = cohort
    runs = [fusion.Run("learned", "full", ("a", "b"), "learned", 1), fusion.Run("all", "full", (), None, 1, 0.0, 0.0)]
    fitted = fusion.fit(rows, design, runs, 5)
    table = fusion.fusion_weights(spark, fitted).collect()
    assert [r["view"] for r in table] == ["a", "b"] and sum(r["weight"] for r in table) == pytest.approx(1)
    assert fitted.best_step == [5, 5] or fitted.best_step[1] == 5  # without held-out rows the last step counts
    empty = fusion.fit(rows.where("false"), design, runs, 2)
    assert all(not t.w.any() and t.b == 0 for t in empty.weights) and fusion.predict(rows.where("false"), empty).count() == 0


def test_search_goes_on_from_its_rungs(spark, cohort, tmp_path, monkeypatch):
    _, _, rows, design = cohort
    trials = {f"r{k}": {"mode": "full", "views": (), "fused": None, "rate": rate} for k, rate in enumerate((0.001, 0.01, 0.1, 0.5))}
    calls, fit = [], fusion.fit
    monkeypatch.setattr(fusion, "fit", lambda *a: calls.append(len(a[2])) or fit(*a))
    path = f"file://{tmp_path}/search"
    first = sorted(map(tuple, fusion.halving(rows, design, trials, 2, path, 2, 2).collect()))
    assert calls == [8, 4, 2] and [r[0] for r in first] == [0] * 8 + [1] * 4 + [2] * 2
    assert {r[1] for r in first if r[0] == 2} == {"r3"} and {r[3] for r in first if r[0] == 2} == {8}
    assert all(b[4] <= a[4] for a in first for b in first if a[1] == b[1] and a[2] == b[2] and b[0] == a[0] + 1)  # it goes on, not anew
    assert sorted(map(tuple, fusion.halving(rows, design, trials, 2, path, 2, 2).collect())) == first and calls == [8, 4, 2]


def test_importance_by_brute_force(spark):
    rng = np.random.default_rng(4)
    n, features = 60, ["f0", "f1", "f2", "f3"]
    x = rng.standard_normal((n, 4))
    y, fold = (x[:, 0] + 0.2 * rng.standard_normal(n) > 0).astype(int), np.arange(n) % 2
    there = rng.random((n, 4)) < 0.9
    weights = {0: [2.0, 0.1, -0.5, 0.0], 1: [1.5, -0.2, 0.3, 0.1]}
    groups = {"g": ["f0", "f1"], "h": ["f2", "f3"], "none": ["f9"]}
    rows = spark.createDataFrame([(i, int(fold[i]), int(y[i])) for i in range(n)], "id int, fold int, y int")
    long = spark.createDataFrame([(i, f, float(x[i, j])) for i in range(n) for j, f in enumerate(features) if there[i, j]], "id int, feature string, value double")
    coef = spark.createDataFrame([(k, f, w) for k, ws in weights.items() for f, w in zip(features, ws)] + [(0, None, 0.25)], "fold int, feature string, weight double")
    member = spark.createDataFrame([(g, f) for g, fs in groups.items() for f in fs], "grp string, feature string")
    got = {(r["fold"], r["grp"], r["perm"]): (r["auroc"], r["auroc_drop"]) for r in importance.permutation_importance(rows, long, coef, member, 3, 5).collect()}
    v = np.where(there, x, 0.0)

    def auc(score, own):
        up, down = score[own & (y == 1)], score[own & (y == 0)]
        return np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])

    score = np.array([v[i] @ weights[fold[i]] + (0.25 if fold[i] == 0 else 0) for i in range(n)])
    assert len(got) == 2 * 3 * 3
    for (k, g, perm), (value, drop) in got.items():
        own = fold == k
        ids = np.flatnonzero(own)
        dealt = sorted(ids, key=lambda i: (hashlib.md5(f"5:{g}:{perm}:{i}".encode()).hexdigest(), i))
        cols = [features.index(f) for f in groups[g] if f in features]
        w = np.array(weights[k])[cols]
        moved = score.copy()
        moved[ids] += v[dealt][:, cols] @ w - v[ids][:, cols] @ w
        assert value == pytest.approx(auc(moved, own)) and drop == pytest.approx(auc(score, own) - value)
        assert g != "none" or drop == 0
    assert not any(math.isnan(a) for a, _ in got.values())
    assert importance.permutation_importance(rows.where("false"), long, coef, member, 2).where(F.col("auroc").isNotNull()).count() == 0

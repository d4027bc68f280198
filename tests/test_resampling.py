"""Bootstraps by hashed Poisson weights, permutations and null grids against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from tallgrass.operators import bootstrap, nulls


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def weight(key, boot, seed):
    if boot == 0:
        return 1
    a, c = 1 + number(f"{seed}:a:{boot}") % (bootstrap.PRIME - 1), number(f"{seed}:c:{boot}") % bootstrap.PRIME
    place = (a * (number(f"{seed}:{key}") % bootstrap.PRIME) + c) % bootstrap.PRIME
    return sum(place >= s for s in bootstrap.STEPS)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(2), round(rng.random(), 1), rng.random()) for i in range(1500)]
    rows = [(i, y, s + 0.05 * y, t) for i, y, s, t in rows]
    odd = [(None, 1, 0.5, 0.5), (9001, None, 0.5, 0.5), (9002, 1, None, 0.5)]
    return rows, spark.createDataFrame(rows + odd, "id long, y int, s double, t double").repartition(5)


def test_weights_are_poisson(spark):
    keys = np.array([number(f"1:{i}") % bootstrap.PRIME for i in range(4000)])
    a, c = np.array(bootstrap.coefficients(50, 1), np.int64).T
    w = bootstrap.weights(keys, a, c)
    assert w[:20, 3].tolist() == [weight(i, 4, 1) for i in range(20)]
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.05)
    assert abs(np.corrcoef(w.T)[np.triu_indices(50, 1)]).max() < 0.1


def auc(pairs):
    """pairs: (score, y, weight)."""
    up = [(s, w) for s, y, w in pairs if y == 1]
    down = [(s, w) for s, y, w in pairs if y != 1]
    wins = sum(w * v * (1.0 if s > r else 0.5 if s == r else 0.0) for s, w in up for r, v in down if w and v)
    return wins / (sum(w for _, w in up) * sum(w for _, w in down))


def test_auroc_of_each_replicate(scored):
    rows, df = scored
    got = {r["boot"]: r["auroc"] for r in bootstrap.auroc(df, "y", "s", "id", 3, 7).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for b, v in got.items():
        assert v == pytest.approx(auc([(s, y, weight(i, b, 7)) for i, y, s, _ in rows]))
    assert bootstrap.auroc(df.where("y = 1"), "y", "s", "id", 2).where("auroc is not null").count() == 0
    assert bootstrap.auroc(df.where("false"), "y", "s", "id", 2).count() == 0


def test_mcc_and_its_difference(scored):
    rows, df = scored
    values = {r["boot"]: (r["mcc_s"], r["mcc_t"]) for r in bootstrap.mcc(df.where("s is not null"), "y", ["s", "t"], "id", 40, 7).collect()}
    for b in (0, 5):
        for k, at in ((0, 2), (1, 3)):
            n = {(p, u): sum(weight(r[0], b, 7) for r in rows if r[1] == p and (r[at] >= 0.5) == u) for p in (0, 1) for u in (False, True)}
            tp, fp, tn, fn = n[1, True], n[0, True], n[0, False], n[1, False]
            assert values[b][k] == pytest.approx((tp * tn - fp * fn) / ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5)
    d = np.array([values[b][0] - values[b][1] for b in range(1, 41)])
    seen = values[0][0] - values[0][1]
    got = bootstrap.difference(bootstrap.mcc(df.where("s is not null"), "y", ["s", "t"], "id", 40, 7), "mcc_s", "mcc_t").first()
    assert (got["n"], got["observed"], got["mean"], got["sd"]) == (40, pytest.approx(seen), pytest.approx(d.mean()), pytest.approx(d.std()))
    assert (got["low"], got["high"]) == tuple(pytest.approx(v) for v in np.percentile(d, [2.5, 97.5]))
    assert (got["p_two"], got["p_one"]) == (pytest.approx((abs(d - seen) >= abs(seen)).mean()), pytest.approx((d <= 0).mean()))


def test_positions_of_the_best(scored):
    rows, df = scored
    got = {r["place"]: r for r in bootstrap.top_positions(df, "id", "t", 25, 3, 4).collect()}
    best = sorted(rows, key=lambda r: (-r[3], r[0]))[:3]
    assert [got[k]["key"] for k in (1, 2, 3)] == [r[0] for r in best] and got[0]["key"] is None
    every = [*((r[0], r[3]) for r in rows), (9001, 0.5), (9002, 0.5)]
    for place, least in ((0, None), (2, best[1][3])):
        v = []
        for b in range(1, 26):
            w = [weight(i, b, 4) for i, _ in every]
            v.append(sum(k * (s if least is None else s >= least) for k, (_, s) in zip(w, every)) / sum(w))
        assert (got[place]["low"], got[place]["high"]) == tuple(pytest.approx(x) for x in np.percentile(v, [2.5, 97.5]))


def test_permuted_adjacency_equals_the_edges(spark):
    rng = random.Random(3)
    nodes = [(i, rng.random(), rng.random()) for i in range(25)]
    edges = [(i, j) for i in range(25) for j in range(i) if rng.random() < 0.2]
    values, links = spark.createDataFrame(nodes, "node int, a double, b double"), spark.createDataFrame(edges, "src int, dst int")
    got = {r["perm"]: r["adjacency"] for r in nulls.permuted_adjacency(links, values, 5, 42, "a", "b", "node").collect()}
    assert sorted(got) == list(range(6))
    for perm, value in got.items():
        dealt = sorted(range(25), key=lambda i: (hashlib.md5(f"42:{perm}:{i}".encode()).hexdigest(), i)) if perm else range(25)
        a = {i: nodes[j][1] for i, j in zip(range(25), dealt)}
        assert value == pytest.approx(np.mean([(a[i] * nodes[j][2] + a[j] * nodes[i][2]) / 2 for i, j in edges]))


def test_grid_keeps_the_first_draws_of_each_cell(spark):
    rng = random.Random(6)
    names = ["r_a_b", "r_a_c", "r_a_d", "r_b_c", "r_b_d", "r_c_d"]
    table = [(k, *(rng.uniform(-0.3, 0.3) for _ in names)) for k in range(1, 200)]
    seen = (0.5, 0.2, 0.1, 0.15, 0.2, 0.25)
    null = spark.createDataFrame(table, "draw int, " + ", ".join(f"{n} double" for n in names))
    observed = spark.createDataFrame([seen], ", ".join(f"{n} double" for n in names))
    got = {(r["control"], r["band"]): r for r in nulls.grid(null, observed, {"one": ["c"], "two": ["c", "d"]}, {"near": 0.5, "any": None}, 20).collect()}

    def value(r, two):
        c = dict(zip(names, r))
        m = np.array([[1, c["r_a_b"], c["r_a_c"], c["r_a_d"]], [c["r_a_b"], 1, c["r_b_c"], c["r_b_d"]], [c["r_a_c"], c["r_b_c"], 1, c["r_c_d"]], [c["r_a_d"], c["r_b_d"], c["r_c_d"], 1]])
        inverse = np.linalg.inv(m if two else m[:3, :3])
        return -inverse[0, 1] / (inverse[0, 0] * inverse[1, 1]) ** 0.5

    for control, two in (("one", False), ("two", True)):
        for band in ("near", "any"):
            rows = [r[1:] for r in table if band == "any" or all(abs(abs(r[1:][k]) - seen[k]) <= 0.5 * seen[k] for k in (1, 3))][:20]
            v, o = np.array([value(r, two) for r in rows]), value(seen, two)
            r = got[control, band]
            assert (r["n"], r["observed"], r["null_mean"]) == (len(v), pytest.approx(o), pytest.approx(v.mean()))
            assert r["p"] == pytest.approx((1 + (v >= o).sum()) / (1 + len(v))) and r["p95"] == pytest.approx(np.percentile(v, 95))

"""Steps whose work has to follow their input: what they give, and that no task or pass has more than its share."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 (registers the queries)
from tallgrass.operators import blocks, graph, nulls, order, spectral, stats
from tallgrass.plans import base

DATA = "/root/testdata/sf0.001"


def test_ranks_are_joined_to_the_values_that_were_ranked(spark):
    """A value that is computed anew may differ: here a second reading has other values."""
    drawn = F.udf(lambda i: int.from_bytes(os.urandom(6), "big") / 2.0, "double").asNondeterministic()
    rows = spark.range(200).select("id", drawn("id").alias("x"))
    got = order.average_ranks(rows, ["x"]).collect()
    assert sorted(r["_rank_x"] for r in got) == [float(i + 1) for i in range(200)]


def test_smallest_from_here_looks_back_only(spark):
    rows = spark.range(50).select("id", ((F.col("id") * 7) % 13).alias("w"))
    found = order.smallest_from_here(rows, "w", [F.asc("id")])
    assert "UnboundedFollowing" not in found._jdf.queryExecution().toString().replace("unboundedfollowing$", "UnboundedFollowing")
    want = [min((j * 7) % 13 for j in range(i, 50)) for i in range(50)]
    assert [r["least"] for r in found.orderBy("id").collect()] == want


def effects(spark, rows):
    return spark.createDataFrame(rows, "sample long, effect double, se double")


def brute_left_out(rows):
    out = {}
    for own in rows:
        e, s = (np.array([r[i] for r in rows if r[0] != own[0]]) for i in (1, 2))
        w, k = 1 / s**2, len(e)
        q, c = max(0.0, (w * e * e).sum() - (w * e).sum() ** 2 / w.sum()), w.sum() - (w * w).sum() / w.sum()
        tau2 = max(0.0, (q - (k - 1)) / c) if k > 1 and c > 0 else 0.0
        v = 1 / (s**2 + tau2)
        out[own[0]] = (k, q if k > 1 else 0.0, tau2, (v * e).sum() / v.sum(), (1 / v.sum()) ** 0.5)
    return out


@pytest.mark.parametrize("n", [2, 3, 60])
def test_leave_one_out_is_the_meta_analysis_of_the_others(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, float(rng.normal(0, 1)), float(rng.choice([0.1, 0.2, 0.5, 0.31]))) for i in range(n)]
    got = {r["excluded"]: (r["k"], r["q"], r["tau2"], r["pooled"], r["pooled_se"]) for r in stats.leave_one_out(effects(spark, rows), "sample").collect()}
    want = brute_left_out(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)


def test_leave_one_out_never_pairs_the_groups(spark):
    """10,000 groups with four standard errors are 40,000 rows, not 100,000,000."""
    rows = spark.range(10_000).select(F.col("id").alias("sample"), ((F.col("id") % 7) / 7.0).alias("effect"), (0.1 + (F.col("id") % 4) / 10.0).alias("se"))
    plan = stats.leave_one_out(rows, "sample")._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (sample" not in plan
    assert stats.leave_one_out(rows, "sample").count() == 10_000


def test_an_infinite_effect_touches_the_others_only(spark):
    rows = [(0, math.inf, 0.1), (1, 0.5, 0.1), (2, 0.7, 0.2)]
    got = {r["excluded"]: r["pooled"] for r in stats.leave_one_out(effects(spark, rows), "sample").collect()}
    assert got[0] == pytest.approx(brute_left_out(rows[1:] + [(9, 0, 1)])[9][3]) and math.isnan(got[1]) and math.isnan(got[2])


def test_groups_are_paired_part_by_part(spark, monkeypatch):
    rows = [(g, f"n{k:03}") for g in range(2) for k in range(40) for _ in range(3)] + [(None, "x"), (1, None)]
    members = spark.createDataFrame(rows, "g int, n string")
    want = sorted((f"n{i:03}", f"n{j:03}") for i in range(40) for j in range(i + 1, 40))
    for part in (2048, 7):
        monkeypatch.setattr(graph, "_PART", part, raising=False)
        found = graph.inside_groups(members, "g", "n", "axis", 0.3)
        assert sorted((r["src"], r["dst"]) for r in found.collect()) == want
    # copies of members are gone before they are paired: the join has no copy of a pair but for the two groups
    assert "group-members" in " ".join(found.inputFiles())


def test_views_do_not_deal_edges_by_type(spark):
    edges = spark.createDataFrame([("a", "b", "A", 1.0), ("b", "a", "A", 2.0), ("a", "c", "N", 3.0), ("a", "a", "N", 3.0)], "src string, dst string, edge_type string, weight double")
    assigned = spark.createDataFrame([("A", "open"), ("N", "open")], "edge_type string, view string")
    found = graph.views(edges, assigned)
    assert sorted(tuple(r) for r in found.collect()) == [("open", "a", "b", 2.0), ("open", "a", "c", 3.0)]
    assert "hashpartitioning(edge_type" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("width", "per_chunk"), [(256, 4096), (4, 3), (4, 1)])
def test_sets_are_counted_block_by_block(spark, width, per_chunk):
    rng = np.random.default_rng(5)
    rows = [(f"t{k:02}", int(i)) for k in range(23) for i in rng.choice(40, rng.integers(1, 25))]
    own = {}
    for t, i in rows:
        own.setdefault(t, set()).add(i)
    want = {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b and len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.2}
    found = blocks.shared_items(spark.createDataFrame([*rows, (None, 1), ("t00", None)], "term string, item long"), 0.2, width=width, per_chunk=per_chunk)
    got = {(r["src"], r["dst"]): r["shared"] for r in found.collect()}
    assert got == want and found.schema.simpleString() == "struct<src:string,dst:string,shared:bigint,jaccard:double>"


def test_pairs_of_sets_are_never_shuffled(spark):
    """Blocks of bits travel once for each other block; counts and pairs stay where they are counted, whatever the number of chunks."""
    rng = np.random.default_rng(6)
    own = {t: set(map(int, rng.choice(500, 300, replace=False))) for t in range(40)} | {40: {7}, 41: {499, 3}}
    sets = spark.createDataFrame([(t, i) for t, items in own.items() for i in items], "term long, item long")
    want = {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b and len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.05}
    for per_chunk in (4096, 100):
        found = blocks.shared_items(sets, 0.05, width=16, per_chunk=per_chunk)
        assert {(r["src"], r["dst"]): r["shared"] for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange ") == 1
    packed = spark.read.parquet(*found.inputFiles()).where("chunk is not null").agg(F.sum(F.octet_length("cells")).alias("n")).first()["n"]
    assert packed <= 48 * 5 * 13  # a bit for each set and item, where cells were eight bytes


def test_blocks_of_nodes_give_the_singular_values(spark, monkeypatch):
    """More blocks than are added up at a time, and one view without most of them."""
    monkeypatch.setattr(spectral, "_BLOCK", 2)
    rng = np.random.default_rng(1)
    rows = [("a", f"n{i:02}", f"n{j:02}", float(rng.random() + 0.1)) for i in range(68) for j in range(i) if rng.random() < 0.2] + [("b", "x", "y", 1.0), ("b", "y", "z", 1.0)]
    found = spectral.embed(spark.createDataFrame(rows, "view string, src string, dst string, weight double"), 4, rounds=3)
    m = np.zeros((68, 68))
    for v, s, d, w in rows:
        if v == "a":
            m[int(s[1:]), int(d[1:])] = m[int(d[1:]), int(s[1:])] = w
    root = np.sqrt(m.sum(1))
    want = np.sort(np.abs(np.linalg.eigvalsh(m / root[:, None] / root)))[::-1][:3]
    assert found.values["a"][:3] == pytest.approx(want, rel=1e-3) and found.values["b"][:2] == pytest.approx([1, 1], rel=1e-9)
    assert found.vectors.count() == 71


def test_permutations_share_their_edges(spark, monkeypatch):
    """Edges are stored once for all permutations; blocks, rows of several permutations, nodes of one view only and repeated edges give what whole matrices give."""
    monkeypatch.setattr(spectral, "_BLOCK", 4)
    monkeypatch.setattr(spectral, "_COLUMNS", 36, raising=False)  # two permutations a row
    seen, kept = {}, spectral.stored
    monkeypatch.setattr(spectral, "stored", lambda rows, name: (out := kept(rows, name), seen.update({name: out.count()}))[0])
    rng = random.Random(9)
    names = [f"n{i:02}" for i in range(11)]
    rows = [(v, a, b, rng.randint(1, 9) / 8) for v in "xy" for i, a in enumerate(names[: 11 if v == "x" else 7]) for b in names[:i] if rng.random() < 0.5] + [("x", "n01", "n00", 0.5), ("y", "n03", "n03", 2.0), ("y", "lost", "n01", 0.0), ("x", "n04", "only", 1.5)]
    df = spark.createDataFrame(rows, "view string, src string, dst string, weight double").repartition(3)
    members = spark.createDataFrame([("a", n) for n in names[:3]] + [("b", n) for n in [*names[3:6], "lost"]], "module string, node string")
    got = {r["perm"]: r["coupling"] for r in spectral.contextual_coupling(df, "x", members, "a", "b", 4, 10, seed=6).collect()}
    every = sorted({n for _, a, b, _ in rows for n in (a, b)})
    assert sorted(got) == list(range(5)) and seen["contextual-edges"] <= len(rows)
    for perm, value in got.items():
        image = dict(zip(every, every if perm == 0 else sorted(every, key=lambda n: (hashlib.md5(f"6:{perm}:{n}".encode()).hexdigest(), n))))
        m = np.zeros((len(every), len(every)))
        for v, a, b, w in rows:
            i, j = (every.index(image[n] if v == "x" else n) for n in (a, b))
            if i != j:
                m[i, j] += w
                m[j, i] += w
        there = m.sum(1) > 0
        root = np.sqrt(np.where(there, m.sum(1), 1))
        u, s, _ = np.linalg.svd(m / root[:, None] / root)
        e = (u * np.sqrt(s))[:, :10]
        e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
        left, right = ([every.index(n) for n in own if there[every.index(n)]] for own in (names[:3], [*names[3:6], "lost"]))
        assert s[9] - s[10] > 1e-4 and value == pytest.approx((e[left] @ e[right].T).mean(), abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_labels_are_read_from_the_scores_that_were_fitted(spark):
    for name in ("state_labels", "state_labels_frozen_thresholds", "state_distribution"):
        assert all("wide-scores" in f for f in base.QUERIES[name](spark, DATA).inputFiles())


def test_permutations_over_a_grid_in_rounds_and_stretches(spark, monkeypatch):
    """Rows that are ranked do not grow with the number of permutations; stretches, chunks and rounds give what the whole gives."""
    rng, seen, ranked = random.Random(5), [], nulls.running
    nodes = [(i * 3, rng.random() if i % 9 else None, float(i % 4)) for i in range(90)]
    edges = [(i * 3, j * 3) for i in range(90) for j in range(i) if rng.random() < 0.05]
    for name, size in (("_NODES", 20), ("_CHUNK", 8), ("_ROUND", 270), ("_PART", 40)):
        monkeypatch.setattr(nulls, name, size, raising=False)
    monkeypatch.setattr(nulls, "running", lambda rows, *a, **k: (seen.append(rows.count()), ranked(rows, *a, **k))[1])
    values, links = spark.createDataFrame(nodes, "node long, a double, b double"), spark.createDataFrame(edges, "src long, dst long")
    got = {r["perm"]: r["adjacency"] for r in nulls.permuted_adjacency(links, values, 7, 42, "a", "b", "node").collect()}
    b, names, want = {i: x for i, _, x in nodes}, [i for i, _, _ in nodes], {}
    for perm in range(8):
        dealt = names if perm == 0 else sorted(names, key=lambda i: (hashlib.md5(f"42:{perm}:{i}".encode()).hexdigest(), i))
        a = {i: dict((k, v or 0.0) for k, v, _ in nodes)[j] for i, j in zip(names, dealt)}
        want[perm] = sum(a[i] * b[j] + a[j] * b[i] for i, j in edges) / (2 * len(edges))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert max(seen) <= 90
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert nulls.permuted_adjacency(links.where("false"), values, 2, 42, "a", "b", "node").count() == 0

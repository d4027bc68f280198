"""Operators on small fixtures with known results, edge cases first."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import special
from tallgrass.functions.expr import corr, partial_corr
from tallgrass.operators import cells, evaluation, evidence, graph, labels, nulls, scores, stats
from tallgrass.operators import matrix as mx


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_t_pvalue_known():
    # two-sided p of Student's t, from printed tables
    t, df, p = [2.228, 1.96, 12.706, 0.0], [10, 1e7, 1, 5], [0.05, 0.05, 0.05, 1.0]
    assert np.allclose(special.t_two_sided(np.array(t), np.array(df)), p, atol=2e-4)


def test_wilcoxon_exact():
    assert special.wilcoxon_two_sided(15, 5) == 2 / 32
    assert special.wilcoxon_two_sided(7, 5) == 1.0


def test_corr_of_constant_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert rows.agg(corr("x", "y").alias("r")).first()["r"] is None
    assert rows.limit(1).agg(corr("x", "y").alias("r")).first()["r"] is None


def test_partial_corr_with_a_copy_as_covariate(spark):
    assert spark.range(1).select(partial_corr(F.lit(0.5), F.lit(1.0), F.lit(0.5)).alias("r")).first()["r"] is None


@pytest.mark.parametrize(("policy", "expected"), [("label", 0.0), ("unit_sd", 0.0), ("sample_skip", None), ("eps", 0.0)])
def test_constant_feature_under_each_policy(spark, policy, expected):
    long = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 1.0)], "sample string, feature string, value double")
    p = scores.POLICIES[policy]
    out = scores.module_scores(scores.z_scores(long, ["feature"], p), spark.createDataFrame([("m", "f")], "module string, feature string"), ["sample"], p)
    assert [r["score"] for r in out.collect()] == [expected, expected]


def test_module_score_closed_form(spark):
    long = spark.createDataFrame([(s, f, v) for f, vs in {"f": [0.0, 1.0, 2.0], "g": [2.0, 1.0, 0.0]}.items() for s, v in zip("abc", vs)], "sample string, feature string, value double")
    m = spark.createDataFrame([("m", "f"), ("n", "f"), ("n", "g"), ("m", "absent")], "module string, feature string")
    out = {(r["sample"], r["module"]): r["score"] for r in scores.module_scores(scores.z_scores(long, ["feature"]), m, ["sample"]).collect()}
    assert out["a", "m"] == pytest.approx(-math.sqrt(1.5)) and out["a", "n"] == pytest.approx(0.0)


def test_benjamini_hochberg_is_not_below_p(spark):
    p = [0.03, 0.001, 0.5, 0.02, 0.2]
    rows = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    q = [r["q"] for r in stats.benjamini_hochberg(rows, "p", "id").orderBy("id").collect()]
    assert q == pytest.approx([0.05, 0.005, 0.5, 0.05, 0.25]) and all(a >= b for a, b in zip(q, p))


def test_random_effects_of_one_and_of_alike_studies(spark):
    one = stats.random_effects(spark.createDataFrame([("g", 0.3, 0.1)], "g string, effect double, se double"), ["g"]).first()
    assert (one["k"], one["tau2"], one["i2"]) == (1, 0.0, 0.0) and one["pooled"] == pytest.approx(0.3)
    two = stats.random_effects(spark.createDataFrame([("g", 0.3, 0.1), ("g", 0.31, 0.2)], "g string, effect double, se double"), ["g"]).first()
    assert two["tau2"] == 0.0 and two["pooled"] == pytest.approx((0.3 * 100 + 0.31 * 25) / 125)


def test_cohen_d_closed_form(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 6.0)], "arm string, x double")
    out = stats.cohen_d(stats.two_arms(rows, [], "x", F.col("arm") == "a")).first()
    assert out["d"] == pytest.approx(-2 / math.sqrt(5))


def test_state_rule_at_the_threshold_takes_the_first_branch(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0)], "i double, c double, d double, e double")
    t = labels.fit_thresholds(rows, ["i", "c", "d", "e"])
    assert labels.immune_states(rows, t, "i", "c", "d", "e").first()["state"] == "cytotoxic"


def test_duplicates_keep_one_probe_on_ties(spark):
    rows = spark.createDataFrame([("S", "p2", 1.0), ("S", "p1", 1.0), ("T", "q", 2.0)], "symbol string, probe string, value double")
    assert values(mx.highest_mean(rows), "symbol", "probe") == [("S", "p1"), ("T", "q")]


def test_empty_and_aliased_names(spark):
    rows = spark.createDataFrame([("tp53",), (" ",), ("P53",)], "feature string")
    aliases = spark.createDataFrame([("p53", "TP53")], "alias string, canonical string")
    assert values(mx.standardise_names(rows, aliases), "feature") == [("TP53",), ("TP53",)]


def test_auroc_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([("x", 1, 0.5), ("x", 0, 0.5), ("y", 1, 0.9), ("z", 1, 0.9), ("z", 0, 0.1), ("z", 0, 0.95)], "g string, y int, s double")
    out = {r["g"]: r["auroc"] for r in evaluation.auroc(rows, ["g"], "y", "s").collect()}
    assert out == {"x": 0.5, "y": None, "z": 0.5}
    assert {r["g"]: r["auprc"] for r in evaluation.auprc(rows, ["g"], "y", "s").collect()}["z"] == 0.5


def test_jaccard_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    sets = {t: {int(x) for x in rng.integers(0, 30, rng.integers(1, 12))} for t in range(40)}
    rows = spark.createDataFrame([(t, i) for t, s in sets.items() for i in s], "term int, item int")
    for least in (0.05, 0.3, 1.0):
        want = sorted((a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least - 1e-12)
        assert [(a, b, round(j, 9)) for a, b, j in values(graph.jaccard_join(rows, least), "src", "dst", "jaccard")] == want


def test_hex_grid_does_not_bridge_holes(spark):
    spots = spark.createDataFrame([(0, 0, 0), (1, 0, 2), (2, 1, -1), (3, 1, 1), (4, 0, 8)], "spot int, array_row int, array_col int")
    assert values(graph.hex_edges(spots), "src", "dst") == [(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)]


def test_edges_with_unknown_ends_go(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "x", 2.0), ("x", "b", 3.0), (None, "b", 4.0), ("c", None, 5.0), ("c", "c", 6.0), ("a", "b", 1.0)], "src string, dst string, weight double")
    assert sorted(values(graph.within(e, nodes), "src", "dst", "weight")) == [("a", "b", 1.0), ("a", "b", 1.0), ("c", "c", 6.0)]
    assert graph.within(e, nodes.where("false")).count() == 0


def test_multi_edges(spark):
    e = spark.createDataFrame([("a", "b", "t", 0.2, 1), ("b", "a", "t", 0.1, 2), ("a", "a", "t", 9.0, 3), ("a", "b", "u", 0.5, 4)], "src string, dst string, edge_type string, weight double, at int")
    assert values(graph.reduce_max(e), "src", "dst", "weight") == [("a", "b", 0.5)]
    c = spark.createDataFrame([("t", 1.0), ("u", 2.0)], "edge_type string, coefficient double")
    assert values(graph.reduce_last(e, "at", c), "weight") == [(1.1,)]


def test_mean_coupling_is_the_mean_over_pairs(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 1.0]), ("b", [0.0, 2.0]), ("b", [0.0, 0.0])], "grp string, v array<double>")
    out = {(r["a"], r["b"]): r["coupling"] for r in graph.mean_coupling(rows, "grp", "v").collect()}
    assert out["a", "b"] == pytest.approx(math.sqrt(0.5) / 2) and out["a", "a"] == pytest.approx(math.sqrt(0.5)) and out["b", "b"] is None


def test_verdict_flips_with_one_interval(spark):
    rows = [("c", "m", 0.1, 0.01), ("c", "n", 0.1, 0.01)]
    schema = "comparator string, metric string, observed_delta double, ci_low double"
    need = spark.createDataFrame([("c", "m"), ("c", "n")], "comparator string, metric string")
    assert evidence.gain_verdict(spark.createDataFrame(rows, schema), need).first()["verdict"] == "stable_gain"
    assert evidence.gain_verdict(spark.createDataFrame([rows[0], ("c", "n", 0.1, -0.01)], schema), need).first()["verdict"] == "no_stable_gain"
    assert evidence.gain_verdict(spark.createDataFrame(rows[:1], schema), need).first()["verdict"] == "no_stable_gain"


def test_factorial_gap_is_found(spark):
    rows = spark.createDataFrame([(a, b) for a in "xy" for b in (1, 2) if (a, b) != ("y", 2)], "a string, b long")
    assert values(evidence.factorial_gaps(rows, ["a", "b"]), "a", "b", "n") == [("y", 2, 0)]


def test_matrix_shortcut_equals_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(s, f"f{j}", float(v)) for s, r in enumerate(rng.normal(size=(30, 6))) for j, v in enumerate(r)]
    z = scores.z_scores(spark.createDataFrame(rows, "sample int, feature string, value double"), ["feature"])
    members = spark.createDataFrame([("a", "f0"), ("a", "f1"), ("b", "f2"), ("b", "f3"), ("b", "f4")], "module string, feature string")
    short = nulls.module_corr(members, nulls.correlations(z), [], [("a", "b")]).first()["r_a_b"]
    table = scores.score_table(scores.module_scores(z, members, ["sample"]), ["sample"], ["a", "b"])
    assert short == pytest.approx(table.agg(corr("a", "b").alias("r")).first()["r"])


def test_permutation_keeps_values(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(20)], "node int, v double")
    out = nulls.permuted(rows, 3, 1, "node", ["v"]).collect()
    assert len(out) == 60 and all(sorted(r["v"] for r in out if r["perm"] == p) == [float(i) for i in range(20)] for p in (1, 2, 3))
    assert any(r["v"] != float(r["node"]) for r in out)


def test_sparse_moments_count_absent_cells(spark):
    out = cells.sparse_moments(spark.createDataFrame([("c1", "f", 2.0), ("c2", "f", 4.0)], "cell string, feature string, value double"), 4).first()
    assert out["mean"] == 1.5 and out["var"] == pytest.approx(2.75)


def test_mad_filter_of_equal_values_is_strict(spark):
    assert labels.mad_filter(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").count() == 0

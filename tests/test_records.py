"""Small operators, readers and writers on fixtures with known values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import special
from tallgrass.functions.expr import mean_if
from tallgrass.operators import evaluation, evidence, labels, matrix, stats
from tallgrass.sources import formats, sinks, specs, tabular


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in (df if isinstance(df, list) else df.collect()))


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([("s1", "A", 1.0), ("s1", "B", 2.0), ("s2", "A", 3.0), ("s3", "C", 4.0)], "sample string, feature string, value double")


def test_shapes_of_a_matrix(spark, long):
    wide = matrix.to_wide(long, ["sample"], ["A", "B", "absent"])
    assert rows(wide, "sample", "A", "B", "absent") == [("s1", 1.0, 2.0, None), ("s2", 3.0, None, None), ("s3", None, None, None)]
    turned = matrix.transpose(long)
    assert rows(turned, "sample", "feature") == sorted((f, s) for s, f, _ in map(tuple, long.collect()))
    full = matrix.zero_complete(long, long.select("sample").distinct(), long.select("feature").distinct())
    assert full.count() == 9 and full.agg(F.sum("value").alias("v")).first()["v"] == 10.0
    modules = spark.createDataFrame([("m", "A"), ("n", "A"), ("n", "Z")], "module string, feature string")
    assert rows(matrix.pick(long, modules), "module", "sample") == [("m", "s1"), ("m", "s2"), ("n", "s1"), ("n", "s2")]
    assert [r["feature"] for r in matrix.varying(long).collect()] == ["A"]
    assert rows(matrix.check_one_to_one(long, ["sample"]), "sample", "n") == [("s1", 2)]
    text = spark.createDataFrame([("a", "1.5"), ("b", "x"), ("c", None)], "sample string, value string")
    assert rows(matrix.coerce(text).na.fill(-1.0), "sample", "value") == [("a", 1.5), ("b", -1.0), ("c", -1.0)]
    assert text.select(matrix.split_ids(F.lit("TCGA-01-XY"), "-", 3).alias("p")).first()["p"] == "XY"
    assert long.agg(mean_if(F.col("feature") == "A", "value").alias("m")).first()["m"] == 2.0


@pytest.mark.parametrize("how, want", [("mean", [("s1", "X", 2.0), ("s1", "Y", 9.0), ("s2", "X", 6.0)]), ("highest_mean", [("s1", "X", 3.0), ("s1", "Y", 9.0), ("s2", "X", 6.0)])])
def test_probes_become_symbols(spark, how, want):
    probes = spark.createDataFrame([("s1", "p1", 1.0), ("s1", "p2", 3.0), ("s2", "p2", 6.0), ("s1", "p3", 9.0), ("s1", "p4", 5.0)], "sample string, probe string, value double")
    mapping = formats.clean_mapping(spark.createDataFrame([("p1", "X"), ("p2", " X /// Q"), ("p3", "Y"), ("p4", "---"), ("p9", "Z")], "probe string, symbol string"))
    assert rows(matrix.to_symbols(probes, mapping, how), "sample", "symbol", "value") == want


def test_malignant_cells_and_what_stands_in(spark):
    cells = spark.createDataFrame([(1, "Other", "tumor", 0.1), (2, "NK", "tumor", 0.2), (3, "Other", "normal", 0.9), (4, None, "tumor", None)], "id int, kind string, condition string, score double")
    annotated, tumor = (F.col("kind") == "Other") & (F.col("condition") == "tumor"), F.col("condition") == "tumor"
    flags = lambda df, rule: {r["id"]: r["malignant"] for r in labels.malignant(df, rule, "score", tumor).collect()}
    assert flags(cells, annotated) == {1: True, 2: False, 3: True, 4: False}
    plain = cells.withColumns({"kind": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    assert flags(plain, (F.col("kind") == "Other") & tumor) == {1: True, 2: True, 3: False, 4: True}
    codes = spark.createDataFrame([("T-1-1-01A",), ("T-1-1-11A",), ("T-1",)], "b string")
    assert [r["c"] for r in codes.select(labels.barcode_condition("b").alias("c")).collect()] == ["tumor", "normal", "unknown"]


def test_populations_meet_by_sample(spark):
    table = [(s, p, v) for s, a, b in (("1", 1.0, 2.0), ("2", 2.0, 4.5), ("3", 3.0, 5.0), ("4", 9.0, None)) for p, v in (("a", a), ("b", b)) if v is not None]
    df = spark.createDataFrame(table, "sample string, kind string, v double")
    got = stats.population_corr(df, "sample", F.col("kind") == "a", "v", F.col("kind") == "b", "v").first()
    assert got["n"] == 3 and got["r"] == pytest.approx(0.9332565253)
    assert stats.population_corr(df.where("sample < '3'"), "sample", F.col("kind") == "a", "v", F.col("kind") == "b", "v").first()["r"] is None
    outcomes = spark.createDataFrame([(0.5, 3.0, 1), (0.5, 1.0, 1), (-0.5, -3.0, 1), (-0.5, -3.0, -1), (None, None, 1)], "r double, t double, e int")
    assert [r["o"] for r in outcomes.select(stats.replication_outcome("r", "t", "e").alias("o")).collect()] == ["recovered", "weak", "wrong_sign", "recovered", "unresolved"]


def test_tail_probabilities(spark):
    df = spark.createDataFrame([(1.959964, 0.0, 6, 2, 10, 4, 3)], "z double, w double, n int, k int, total int, good int, drawn int")
    r = df.select(special.normal_pvalue("z").alias("z"), special.wilcoxon_pvalue("w", "n").alias("w"), special.hypergeometric_tail("k", "total", "good", "drawn").alias("h"), special.t_pvalue(F.lit(2.0), F.lit(10.0)).alias("t")).first()
    assert (r["z"], r["w"], r["h"], r["t"]) == (pytest.approx(0.05, abs=1e-6), 2 / 64, pytest.approx((math.comb(4, 2) * 6 + 4) / math.comb(10, 3)), pytest.approx(0.0733880, abs=1e-6))
    sets = spark.createDataFrame([("t", "A"), ("t", "B"), ("u", "C"), ("t", "outside")], "term string, feature string")
    universe = spark.createDataFrame([(c,) for c in "ABCDE"], "feature string")
    assert rows(evidence.over_representation(sets, universe.where("feature in ('A', 'B', 'D')"), universe), "term", "k", "good", "drawn", "total") == [("t", 2, 2, 3, 5)]
    folds = spark.createDataFrame([("x", 1, 0.7), ("x", 2, 0.8), ("ref", 1, 0.6), ("ref", 2, 0.9)], "method string, fold int, v double")
    assert rows(evaluation.metric_pairs(folds, "method", "ref", ["fold"], "v"), "fold", "a", "b") == [(1, 0.7, 0.6), (2, 0.8, 0.9)]


def test_readers_of_small_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("R1\tPW:1\turl\tGlycolysis\tTAS\tHomo sapiens\nR2\tPW:2\turl\tOther\tTAS\tMus musculus\n")
    assert [r["name"] for r in formats.read_pathways(spark, str(tmp_path / "p.txt")).collect()] == ["Glycolysis"]
    (tmp_path / "t.csv").write_text("barcode,1,0,2,10,20\nother,0,1,1,5,5\n")
    (tmp_path / "c.csv").write_text("gene,c1,c2\nCD3,1,0\nTP53,2,3\n")
    (tmp_path / "r.csv").write_text("cell,CD3,TP53\nc1,1,2\nc2,0,3\n")
    want = [("c1", "CD3", 1.0), ("c1", "TP53", 2.0), ("c2", "TP53", 3.0)]
    assert rows(tabular.read_cells_csv(spark, str(tmp_path / "c.csv")), "cell", "feature", "value") == want
    for name in ("c.csv", "r.csv"):
        assert rows(tabular.read_oriented(spark, str(tmp_path / name), ["TP53", "EPCAM"]), "cell", "feature", "value") == want
    with pytest.raises(ValueError, match="orientation"):
        tabular.read_oriented(spark, str(tmp_path / "c.csv"), ["EPCAM"])
    (tmp_path / "j.json").write_text(json.dumps({"a": 1, "b": [1, 2]}, indent=1))
    assert tabular.read_json(spark, str(tmp_path / "j.json")).first()["b"] == [1, 2]
    (tmp_path / "d.tsv").write_text("SYMBOL\tCANCER_TYPE\nA\tSTAD\nA\tSTAD\nB\tBRCA\n")
    assert [r["feature"] for r in tabular.read_compendium(spark, str(tmp_path / "d.tsv"), "STAD").collect()] == ["A"]
    (tmp_path / "l.csv").write_text("ligand,receptor,pathway\nL,R,W\n")
    assert rows(formats.read_ligand_receptor(spark, str(tmp_path / "l.csv")), "ligand", "receptor", "pathway") == [("L", "R", "W")]


def test_dependencies_of_the_first_release_that_is_there(spark, tmp_path):
    (tmp_path / "s.csv").write_text("model,TP53 (7157),CD3E (916)\nm1,-1.0,0.2\nm2,-0.4,\nm3,0.9,0.9\n")
    (tmp_path / "m.csv").write_text("model_id,lineage\nm1,Gastric\nm2,gastric cancer\nm3,Lung\n")
    scores, models, label = tabular.first_release(spark, [(str(tmp_path / "no.csv"), str(tmp_path / "m.csv"), "new"), (str(tmp_path / "s.csv"), str(tmp_path / "m.csv"), "old")])
    assert label == "old"
    long = tabular.dependency_scores(scores, models, "Gastric")
    got = tabular.dependency_summary(long, spark.createDataFrame([("TP53",), ("CD3E",), ("NONE",)], "feature string"))
    assert rows(got, "feature", "n", "verdict") == [("CD3E", 1, "not_essential"), ("NONE", 0, "no_data"), ("TP53", 2, "pan_essential")]
    with pytest.raises(FileNotFoundError, match="new"):
        tabular.first_release(spark, [("/no/a", "/no/b", "new")])
    ids = spark.createDataFrame([("TCGA-AA-0001-01",)], "id string")
    samples = spark.createDataFrame([("TCGA-AA-0001-01A", 1), ("TCGA-AA-0002-01A", 2)], "sample string, v int")
    assert [r["v"] for r in tabular.subset_samples(samples, ids).collect()] == [1]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b|c", 2.5)], "k string, v double").repartition(2)
    sinks.write_tsv_with_provenance(df, str(tmp_path / "p"), {"script": "test", "key": "x"}, "NA")
    assert rows(tabular.read_tsv(spark, str(tmp_path / "p")), "k", "v") == [("a", "NA"), ("b|c", "2.5")]
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert rows(tabular.read_tsv(spark, str(tmp_path / "t")).na.fill(""), "k", "v") == [("a", ""), ("b|c", "2.5")]
    paths = [sinks.write_version(df, str(tmp_path / "v")) for _ in range(2)]
    assert paths[0] != paths[1] and all(spark.read.parquet(p).count() == 2 for p in paths)
    sinks.write_verdict(df.agg(F.count("*").alias("n")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["n"] == 2
    assert sinks.markdown(df.orderBy("k")) == "| k | v |\n| --- | --- |\n| a |  |\n| b\\|c | 2.5000 |"
    (tmp_path / "in.txt").write_text("x")
    sinks.write_bundle({"one": df, "two": df.select("k")}, str(tmp_path / "b"), "test", specs.digests(spark, str(tmp_path / "in.txt")))
    log = spark.read.parquet(str(tmp_path / "b" / "provenance")).collect()
    assert sorted((r["kind"], r["rows"]) for r in log if r["kind"] == "table") == [("table", 2), ("table", 2)]
    assert [r["sha256"] for r in log if r["kind"] == "input"] == ["2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"]
    with pytest.raises(ValueError, match="not finite"):
        sinks.write_bundle({"one": df}, str(tmp_path / "c"), "test", finite={"one": ["v"]})
    for resolution in ("bulk", "cell"):
        sinks.append_outcomes(spark.createDataFrame([(resolution, 0.5)], "resolution string, r double"), str(tmp_path / "o"))
    sinks.append_outcomes(spark.createDataFrame([(0.1,)], "r double"), str(tmp_path / "o"))
    assert rows(spark.read.parquet(str(tmp_path / "o")).na.fill(""), "resolution", "r") == [("", 0.1), ("bulk", 0.5), ("cell", 0.5)]


def test_specs_from_files_and_tables(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("x: {role: driver, genes: [A, B]}\ny: {role: readout, genes: [B]}\n")
    frame = specs.modules_frame(spark, {"card": specs.load_yaml(str(tmp_path / "c.yaml"))})
    stored = specs.members(frame).join(frame.select("card", "module", "role", "direction"), ["card", "module"])
    for cards in (frame, specs.registry(stored)):
        assert rows(specs.card_summary(cards), "card", "n_modules", "n_features", "roles") == [("card", 2, 2, "driver;readout")]
    manifest, found = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string")
    assert rows(specs.bind_paths(manifest, found, "k"), "k", "problem") == [("a", "file missing"), ("c", "not in manifest")]
    gaps = spark.createDataFrame([("x", "auroc", 0.1, 0.05)], "comparator string, metric string, observed_delta double, ci_low double")
    required = spark.createDataFrame([("x", "auroc"), ("x", "auprc")], "comparator string, metric string")
    assert evidence.gain_verdict(gaps, required).first()["verdict"] == "no_stable_gain" and evidence.gain_verdict(gaps, required.limit(1)).first()["verdict"] == "stable_gain"

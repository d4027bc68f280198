"""Readers and writers on small files."""

import gzip

from pyspark.sql import functions as F

from tallgrass.operators import labels, scores
from tallgrass.sources import formats, sinks, specs, synthetic, tabular
from tallgrass.streaming import frozen


def test_matrix_tsv_with_comment_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write("# made by a test\ngene\ts1\ts2\nA\t1\tx\nB\t2\t3\n")
    rows = tabular.read_matrix(spark, str(tmp_path / "m.tsv.gz")).collect()
    assert sorted((r["sample"], r["feature"], r["value"]) for r in rows if r["value"] is not None) == [("s1", "A", 1.0), ("s1", "B", 2.0), ("s2", "B", 3.0)]
    assert tabular.sniff_gzip(spark, str(tmp_path)).first()["gzipped"]


def test_series_matrix(spark, tmp_path):
    (tmp_path / "s.txt").write_text('!title\tx\n!series_matrix_table_begin\n"ID_REF"\t"GSM1"\t"GSM2"\n"p1"\t1.5\tnull\n"p2"\t\t\n!series_matrix_table_end\n')
    rows = formats.read_series_matrix(spark, str(tmp_path / "s.txt")).collect()
    assert sorted((r["sample"], r["probe"], r["value"]) for r in rows if r["value"] is not None) == [("GSM1", "p1", 1.5)]
    assert {r["probe"] for r in rows} == {"p1"}


def test_platform_symbols(spark, tmp_path):
    (tmp_path / "g.soft").write_text("^P\n!platform_table_begin\nID\tGene Symbol\np1\tA /// B\np2\t---\np3\tC\n!platform_table_end\n")
    assert sorted(map(tuple, formats.read_platform(spark, str(tmp_path / "g.soft")).collect())) == [("p1", "A"), ("p3", "C")]


def test_network_and_sets(spark, tmp_path):
    (tmp_path / "p.txt").write_text("protein1 protein2 combined_score\n9606.A 9606.B 700\n9606.A C 100\n")
    assert [tuple(r) for r in formats.read_ppi(spark, str(tmp_path / "p.txt"), 0.5).collect()] == [("A", "B", 0.7)]
    (tmp_path / "t.txt").write_text("TF1\tA\tB\t\nTF2\tC\n\n")
    assert sorted(map(tuple, formats.read_sets(spark, str(tmp_path / "t.txt")).collect())) == [("TF1", "A"), ("TF1", "B"), ("TF2", "C")]
    (tmp_path / "l.csv").write_text("x,y\n1,2\n")
    assert formats.read_ligand_receptor(spark, str(tmp_path / "l.csv")).count() == 0


def test_coordinates(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%c\n2 2 2\n1 1 5\n2 2 7\n")
    (tmp_path / "f.tsv").write_text("E1\tA\nE2\tB\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\n")
    got = formats.read_coordinates(spark, *(str(tmp_path / x) for x in ("m.mtx", "f.tsv", "b.tsv")))
    assert sorted(map(tuple, got.collect())) == [("A", "c1", 5.0), ("B", "c2", 7.0)]


def test_manifest_and_comparison_rules(spark):
    good = ("a", "GSE1", "u", "rna", "Homo sapiens", 3, "0" * 64, "data/a.tsv", "verified")
    bad = ("b", None, "u", "rna", "Mus musculus", 0, "zz", "synthetic/b.tsv", "verified")
    found = {(r["asset"], r["problem"]) for r in specs.asset_problems(spark.createDataFrame([good, bad], specs.ASSETS)).collect()}
    assert found == {("b", p) for p in ("missing field", "species", "sample count", "digest", "forbidden path")}
    rows = specs.comparisons_frame(spark, [{"card": "c", "comparison": "x", "a": "m", "b": "n", "expected": 0}, {"card": "c", "comparison": "y", "a": "m", "b": "n", "expected": 1}])
    assert [r["comparison"] for r in specs.comparison_problems(rows).collect()] == ["x"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    sinks.write_table(df, str(tmp_path / "t"), {"script": "test"})
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and "script" in spark.read.parquet(str(tmp_path / "t_provenance")).first()["details"]
    assert sorted(r["v"] for r in sinks.fill_not_applicable(df, ["v"]).collect()) == ["2.0", "not_applicable"]
    assert sinks.log_row(df, "step", "OK").first()["status"] == "OK"


def test_synthetic_is_repeatable(spark):
    a, b = (synthetic.bulk(spark, 20, ["A", "B"]).orderBy("sample", "feature").collect() for _ in range(2))
    assert a == b and all(0 <= r["value"] <= 15 for r in a)
    assert synthetic.clinical(spark, 10).count() == 10 and synthetic.counts(spark, 20, ["A"]).where("value < 1").count() == 0


def test_stream_with_frozen_thresholds(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), float(i % 3), float(i % 5), float(i % 2), f"2024-01-01 0{i % 4}:00:00") for i in range(40)], "a double, b double, c double, e double, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    t = labels.fit_thresholds(rows, ["a", "b", "c", "e"])
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scored = frozen.score_stream(stream, scores.fit_wide(rows, ["a"]), ["a"])
    out = frozen.windowed_states(frozen.label_stream(scored, t, "a", "b", "c", "e"), "ts")
    query = out.writeStream.outputMode("complete").format("memory").queryName("states").start()
    query.processAllAvailable()
    query.stop()
    want = frozen.label_stream(rows, t, "a", "b", "c", "e").groupBy("state").count().collect()
    got = spark.sql("select state, sum(n) as n from states group by state").collect()
    assert {r["state"]: r["count"] for r in want} == {r["state"]: r["n"] for r in got}

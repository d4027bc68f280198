"""Sections from archives to spots, and sparse sets from their arrays."""

import gzip
import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import cells, graph
from tallgrass.sources import sections

SPOTS = [("AAA-1", 1, 0, 0), ("BBB-1", 1, 0, 2), ("CCC-1", 1, 1, 1), ("DDD-1", 0, 5, 5), ("EEE-1", 1, 9, 9)]
GENES = ["Tp53", "cd8a", "Nkg7"]
COUNTS = [(1, 1, 5), (2, 1, 2), (3, 2, 7), (1, 3, 1), (2, 4, 9), (3, 5, 4)]


def archive(path, spots=SPOTS, barcodes=None, counts=COUNTS, packed=True, leave_out=(), twice=(), end="\n"):
    barcodes = [s[0] for s in spots] if barcodes is None else barcodes
    texts = {
        "x_matrix.mtx.gz": "%%MatrixMarket matrix coordinate integer general\n%\n" + f"{len(GENES)} {len(barcodes)} {len(counts)}\n" + "\n".join(f"{i} {j} {v}" for i, j, v in counts) + end,
        "x_barcodes.tsv.gz": "\n".join(barcodes) + end,
        "x_features.tsv.gz": "\n".join(f"ENSG{k}\t{g}\tGene Expression" for k, g in enumerate(GENES)) + end,
        "x_tissue_positions_list.csv": "\n".join(f"{b},{t},{r},{c},{r * 10},{c * 10}" for b, t, r, c in spots) + end,
        "x_readme.txt": "nothing",
    }
    with tarfile.open(path, "w:gz" if packed else "w") as tar:
        for name, text in texts.items():
            if name in leave_out:
                continue
            data = gzip.compress(text.encode()) if name.endswith(".gz") else text.encode()
            for k in range(2 if name in twice else 1):
                info = tarfile.TarInfo(f"d{k}/{name}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))


@pytest.mark.parametrize("piece", [sections.PIECE, 16])
def test_sections_end_to_end(spark, tmp_path, piece):
    archive(tmp_path / "GSM11_a.tar.gz")
    archive(tmp_path / "GSM12_b.tar", packed=False, end="", counts=[(1, 2, 3)])
    spots, counts = sections.read_sections(spark, f"file://{tmp_path}/*", piece=piece)
    assert sorted((r["section"], r["spot"], r["array_row"], r["array_col"]) for r in spots.collect()) == sorted((s, b, r, c) for s in ("GSM11", "GSM12") for b, t, r, c in SPOTS if t)
    got = {(r["section"], r["spot"], r["feature"]): r["value"] for r in counts.collect()}
    assert got == {("GSM11", "AAA-1", "TP53"): 5, ("GSM11", "AAA-1", "CD8A"): 2, ("GSM11", "BBB-1", "NKG7"): 7, ("GSM11", "CCC-1", "TP53"): 1, ("GSM11", "EEE-1", "NKG7"): 4, ("GSM12", "BBB-1", "TP53"): 3}
    own = counts.where("section = 'GSM11'")
    scores = cells.spot_scores(own, spark.createDataFrame([("m", "TP53"), ("m", "CD8A")], "module string, feature string"), spots.where("section = 'GSM11'"))
    assert {r["spot"]: round(r["score"], 6) for r in scores.collect()}["AAA-1"] == pytest.approx(round(np.log1p(1e4) / 2, 6))
    assert sorted(tuple(r) for r in graph.hex_edges(spots.where("section = 'GSM11'")).collect()) == [("AAA-1", "BBB-1"), ("AAA-1", "CCC-1"), ("BBB-1", "CCC-1")]


@pytest.mark.parametrize(
    "change, problem",
    [
        ({"barcodes": ["AAA-1", "BBB-1", "CCC-1", "DDD-1", "ZZZ-1"]}, "spot without expression"),
        ({"barcodes": ["AAA-1", "BBB-1", "CCC-1", "DDD-1", "EEE-1", "AAA-1"]}, "duplicate expression barcode"),
        ({"spots": [*SPOTS, ("FFF-1", 1, 0, 0)]}, "duplicate grid position"),
        ({"spots": [*SPOTS, ("AAA-1", 1, 3, 3)], "barcodes": [s[0] for s in SPOTS]}, "duplicate spot barcode"),
        ({"leave_out": ("x_features.tsv.gz",)}, "members: features"),
        ({"twice": ("x_barcodes.tsv.gz",)}, "members: barcodes"),
        ({"counts": [], "leave_out": ("x_matrix.mtx.gz", "x_barcodes.tsv.gz", "x_features.tsv.gz", "x_tissue_positions_list.csv")}, "no spots in tissue"),
        ({"spots": [(b, 0, r, c) for b, _, r, c in SPOTS]}, "no spots in tissue"),
    ],
)
def test_sections_with_problems_are_refused(spark, tmp_path, change, problem):
    archive(tmp_path / "GSM1.tar.gz", **change)
    with pytest.raises(ValueError, match=problem):
        sections.read_sections(spark, f"file://{tmp_path}/GSM1.tar.gz")


def test_a_matrix_of_another_shape_is_a_problem(spark, tmp_path):
    archive(tmp_path / "s.tar", barcodes=[s[0] for s in SPOTS])
    parts = sections.section_parts(spark, f"file://{tmp_path}/s.tar")
    assert sections.section_problems(parts).count() == 0
    short = {**parts, "entries": parts["entries"].where("i > 1")}
    assert [(r["problem"], r["n"]) for r in sections.section_problems(short).collect()] == [("shape", 1)]


def test_index_reads_headers(spark, tmp_path):
    archive(tmp_path / "a.tar", packed=False)
    rows = sections.archive_index(spark, f"file://{tmp_path}/a.tar").collect()
    raw = (tmp_path / "a.tar").read_bytes()
    readme = next(r for r in rows if r["member"].endswith("readme.txt"))
    assert len(rows) == 5 and all(r["seekable"] for r in rows) and raw[readme["offset"] : readme["offset"] + readme["size"]] == b"nothing"


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_sparse_rows_expand(spark, tmp_path, bucket):
    rng = np.random.default_rng(1)
    dense = rng.random((40, 30)) * (rng.random((40, 30)) < 0.2)
    dense[7] = 0
    dense[9] = rng.random(30) + 0.1
    row, col = np.nonzero(dense)
    np.savez_compressed(tmp_path / "sets.npz", data=dense[row, col], indices=col.astype(np.int32), indptr=np.r_[0, np.cumsum((dense != 0).sum(1))].astype(np.int32), shape=np.array(dense.shape), format=np.array(b"csr"))
    arrays = sections.read_arrays(spark, f"file://{tmp_path}/sets.npz")
    got = {(r["row"], r["col"]): r["value"] for r in sections.expand_rows(arrays, bucket).collect()}
    assert got == {(i, j): dense[i, j] for i, j in zip(row.tolist(), col.tolist())}
    names = spark.range(40).select(F.col("id").alias("row"), F.concat(F.lit("g"), "id").alias("feature"))
    panel = spark.createDataFrame([("g9",), ("g7",), ("g8",), ("absent",)], "feature string")
    sets = sections.read_sparse_sets(spark, f"file://{tmp_path}/sets.npz", names, panel)
    assert sorted((r["feature"], r["set"]) for r in sets.collect()) == sorted((f"g{i}", j) for i, j in got if i in (7, 8, 9))

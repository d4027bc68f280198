"""Archives that are read as streams: spatial sections in tar files, and sparse sets in npz files.

A task reads an archive a piece at a time and gives each member as pieces of whole lines, or each array as stretches of numbers; no archive and no member is a row. Members of a plain tar file are found by
their headers and read from their offsets by any task; a compressed one has no offsets to go to, so one task runs through it. The store has to be one that Arrow opens.

Defined cases: an empty member has no lines; a last line without an end counts; an archive without a member, or with two of a kind, is a problem of the section and refused; blank lines are kept, so that
numbers of lines are right."""

from __future__ import annotations

import contextlib
import gzip
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.store import stored
from tallgrass.sources.lines import PIECE, dealt, files, numbered, open_file, whole_lines

_STRETCH = 1 << 16  # numbers in a batch

#: What the members of a section's archive end with.
MEMBERS = {"matrix": "_matrix.mtx.gz", "barcodes": "_barcodes.tsv.gz", "features": "_features.tsv.gz", "positions": "_tissue_positions_list.csv"}


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, offset, size, seekable) of the files in tar archives; only headers are read where the archive is not compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                with open_file(p) as f:
                    packed = f.read(2) == b"\x1f\x8b"
                    f.seek(0)
                    with tarfile.open(fileobj=f, mode="r|gz" if packed else "r:") as tar:
                        rows = [(p, m.name, m.offset_data, m.size, not packed) for m in tar if m.isfile()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "member", "offset", "size", "seekable"])

    return dealt(files(spark, path).select("path"), "path").mapInArrow(run, "path string, member string, offset long, size long, seekable boolean")


class _Stretch:
    """A part of an open file, as a file."""

    def __init__(self, f, offset: int, size: int):
        f.seek(offset)
        self._f, self._left = f, size

    def read(self, n: int = -1) -> bytes:
        n = self._left if n is None or n < 0 else min(n, self._left)
        data = self._f.read(n)
        self._left -= len(data)
        return data


def archive_lines(spark: SparkSession, path: str, suffixes: list[str], piece: int = PIECE) -> DataFrame:
    """(path, member, at, line) of the members that end with one of ``suffixes``; members in gzip are opened. ``at`` counts from 0."""
    wanted = archive_index(spark, path).where(F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith("member", s)))
    # seekable members are work of their own; those of a packed archive stay together
    key = F.when(F.col("seekable"), F.concat_ws("/", "path", "member")).otherwise(F.col("path"))
    tasks = stored(wanted, "archive-members").groupBy(key.alias("key"), "path", "seekable").agg(F.array_sort(F.collect_list(F.struct("offset", "member", "size"))).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, seekable, members in zip(*(batch.column(c).to_pylist() for c in ("path", "seekable", "members")), strict=True):
                with open_file(p) as f, contextlib.ExitStack() as stack:
                    if seekable:
                        opened = ((m["member"], _Stretch(f, m["offset"], m["size"])) for m in members)
                    else:
                        names = {m["member"] for m in members}
                        tar = stack.enter_context(tarfile.open(fileobj=f, mode="r|gz"))
                        opened = ((m.name, tar.extractfile(m)) for m in tar if m.isfile() and m.name in names)
                    for name, stream in opened:
                        for k, text in enumerate(whole_lines(gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream, piece)):
                            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([name]), pa.array([0]), pa.array([k]), pa.array([text])], ["path", "member", "first", "piece", "text"])

    work = dealt(tasks, "key").select("path", "seekable", "members")
    return numbered(work.mapInArrow(run, "path string, member string, first long, piece long, text string"), ["path", "member"])


def section_parts(spark: SparkSession, path: str, piece: int = PIECE) -> dict[str, DataFrame]:
    """The tables of all sections at ``path``: members (path, kind, member), shape (path, n_features, n_barcodes, n_entries), entries (path, i, j, value), features (path, i, feature), barcodes (path, j, barcode),
    positions (path, barcode, in_tissue, array_row, array_col, pixel_row, pixel_col), the last of spots in tissue."""
    lines = archive_lines(spark, path, list(MEMBERS.values()), piece)
    kind = F.coalesce(*[F.when(F.endswith("member", F.lit(s)), F.lit(k)) for k, s in MEMBERS.items()])
    lines = stored(lines.withColumn("kind", kind), "section-lines")
    body = lines.where("kind = 'matrix' and line <> '' and not startswith(line, '%')").withColumn("f", F.split(F.trim("line"), r"\s+"))
    first = body.groupBy("path", "member").agg(F.min("at").alias("at"), F.min_by("f", "at").alias("s"))
    number = lambda c, k, t: F.get(c, F.lit(k)).try_cast(t)
    entries = body.join(first.select("path", "member", F.col("at").alias("_shape")), ["path", "member"]).where(F.col("at") > F.col("_shape"))
    tab = lines.withColumn("f", F.split("line", "\t")).where("line <> ''")
    csv = lines.where("kind = 'positions' and line <> ''").withColumn("f", F.split("line", ","))
    names = {"in_tissue": "int", "array_row": "int", "array_col": "int", "pixel_row": "double", "pixel_col": "double"}
    placed = csv.select("path", F.col("f")[0].alias("barcode"), *[number("f", k, t).alias(c) for k, (c, t) in enumerate(names.items(), 1)])
    return {
        "members": lines.select("path", "kind", "member").distinct(),
        "shape": first.select("path", number("s", 0, "long").alias("n_features"), number("s", 1, "long").alias("n_barcodes"), number("s", 2, "long").alias("n_entries")),
        "entries": entries.select("path", number("f", 0, "long").alias("i"), number("f", 1, "long").alias("j"), F.coalesce(number("f", 2, "double"), F.lit(1.0)).alias("value")),
        "features": tab.where("kind = 'features'").select("path", (F.col("at") + 1).alias("i"), F.upper(F.get("f", F.lit(1))).alias("feature")),
        "barcodes": tab.where("kind = 'barcodes'").select("path", (F.col("at") + 1).alias("j"), F.col("f")[0].alias("barcode")),
        "positions": placed.where("in_tissue = 1 and array_row is not null and array_col is not null"),
    }


def section_problems(parts: dict[str, DataFrame], paths: DataFrame | None = None) -> DataFrame:
    """(path, problem, n): members missing or twice, a shape that the lists do not have, features without names, repeated barcodes or grid positions, spots without expression, no spots.
    ``paths`` (path) are the archives that have to be there."""
    members = parts["members"]
    every = (members.select("path") if paths is None else members.select("path").union(paths.select("path"))).distinct()
    found = members.groupBy("path", "kind").agg(F.count("*").alias("n"))
    kinds = every.select("path", F.explode(F.array(*map(F.lit, MEMBERS))).alias("kind"))
    wrong = kinds.join(found, ["path", "kind"], "left").fillna(0, ["n"]).where("n <> 1").select("path", F.concat(F.lit("members: "), F.col("kind")).alias("problem"), F.col("n").cast("long").alias("n"))

    def stated(rows: DataFrame, problem: str) -> DataFrame:
        return rows.groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit(problem).alias("problem"), "n")

    def twice(rows: DataFrame, keys: list[str], problem: str) -> DataFrame:
        return stated(rows.groupBy("path", *keys).agg(F.count("*").alias("n")).where("n > 1"), problem)

    count = lambda rows, name: rows.groupBy("path").agg(F.count("*").alias(name))
    sizes = parts["shape"].join(count(parts["features"], "a"), "path", "left").join(count(parts["barcodes"], "b"), "path", "left").join(count(parts["entries"], "c"), "path", "left").fillna(0, ["a", "b", "c"])
    unlike = sizes.where(~(F.col("n_features").eqNullSafe(F.col("a")) & F.col("n_barcodes").eqNullSafe(F.col("b")) & F.col("n_entries").eqNullSafe(F.col("c"))))
    orphans = parts["positions"].join(parts["barcodes"], ["path", "barcode"], "left_anti")
    empty = every.join(parts["positions"].select("path").distinct(), "path", "left_anti")
    checks = [
        wrong,
        stated(unlike, "shape"),
        stated(parts["features"].where("feature is null"), "feature without a name"),
        twice(parts["barcodes"], ["barcode"], "duplicate expression barcode"),
        twice(parts["positions"], ["barcode"], "duplicate spot barcode"),
        twice(parts["positions"], ["array_row", "array_col"], "duplicate grid position"),
        stated(orphans, "spot without expression"),
        stated(empty, "no spots in tissue"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def read_sections(spark: SparkSession, path: str, accession: str = r"(GSM\d+)", piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(spots, counts) of all sections: spots (section, spot, array_row, array_col, pixel_row, pixel_col) in tissue, and counts (section, spot, feature, value) of those. The section is the accession in the
    archive's path, or the path. Any problem of any section refuses them all."""
    parts = section_parts(spark, path, piece)
    problems = section_problems(parts, files(spark, path)).limit(20).collect()  # to be shown
    if problems:
        raise ValueError("; ".join(f"{r['path']}: {r['problem']} ({r['n']})" for r in problems))
    found = F.regexp_extract("path", accession, 1)
    section = F.when(found == "", F.col("path")).otherwise(found).alias("section")
    spots = parts["positions"].select(section, F.col("barcode").alias("spot"), "array_row", "array_col", "pixel_row", "pixel_col")
    seen = parts["barcodes"].join(parts["positions"].select("path", "barcode"), ["path", "barcode"], "left_semi")
    counts = parts["entries"].join(seen, ["path", "j"]).join(parts["features"], ["path", "i"]).select(section, F.col("barcode").alias("spot"), "feature", "value")
    return spots, counts.groupBy("section", "spot", "feature").agg(F.sum("value").alias("value"))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, at, value) of the one-dimensional numeric arrays in npz files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                with open_file(p) as f, zipfile.ZipFile(f) as z:
                    for member in z.namelist():
                        with z.open(member) as stream:
                            version = np.lib.format.read_magic(stream)
                            shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
                            if len(shape) != 1 or dtype.kind not in "iufb":
                                continue
                            at, name = 0, member.removesuffix(".npy")
                            while data := stream.read(_STRETCH * dtype.itemsize):
                                v = np.frombuffer(data, dtype).astype(float)
                                yield pa.RecordBatch.from_arrays([pa.array([p] * len(v)), pa.array([name] * len(v)), pa.array(np.arange(at, at + len(v))), pa.array(v)], ["path", "name", "at", "value"])
                                at += len(v)

    return dealt(files(spark, path).select("path"), "path").mapInArrow(run, "path string, name string, at long, value double")


def expand_rows(arrays: DataFrame, bucket: int = 64) -> DataFrame:
    """(path, row, col, value) of compressed sparse rows: ``arrays`` (path, name, at, value) named indptr, indices and data.

    A row's stretch of entries meets the entries in a join by range: both are cut into buckets of places, a stretch is in each bucket that it touches, and a bucket has ``bucket`` entries."""
    named = lambda n: arrays.where(F.col("name") == n).select("path", "at", "value")
    entries = named("indices").withColumnRenamed("value", "col").join(named("data"), ["path", "at"])
    begin = named("indptr").select("path", F.col("at").alias("row"), F.col("value").cast("long").alias("lo"))
    end = begin.select("path", (F.col("row") - 1).alias("row"), F.col("lo").alias("hi"))
    stretch = begin.join(end, ["path", "row"]).where("hi > lo")
    each = stretch.select("path", "row", "lo", "hi", F.explode(F.expr(f"sequence(lo div {bucket}, (hi - 1) div {bucket})")).alias("bucket"))
    met = entries.withColumn("bucket", F.expr(f"at div {bucket}")).join(each, ["path", "bucket"]).where("lo <= at and at < hi")
    return met.select("path", "row", F.col("col").cast("long").alias("col"), "value")


def read_sparse_sets(spark: SparkSession, path: str, names: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """(feature, set) of an npz file of features x sets, its features named by ``names`` (row, feature) and restricted to ``panel`` (feature)."""
    kept = names if panel is None else names.join(panel.select("feature").distinct(), "feature", "left_semi")
    arrays = stored(read_arrays(spark, path), "sparse-arrays")
    return expand_rows(arrays).where("value <> 0").join(kept, "row").select("feature", F.col("col").alias("set"))

"""Delimited tables and JSON: Spark's readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions.expr import to_double
from tallgrass.operators.matrix import to_long


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, comment: str = "#", sep: str = "\t") -> DataFrame:
    """A table with a header; lines that begin with ``comment`` are skipped. Compression goes by the file's extension. Without a schema all columns are strings."""
    reader = spark.read.option("sep", sep).option("header", True).option("comment", comment)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_matrix(spark: SparkSession, path: str, feature: str = "feature", sample: str = "sample", sep: str = "\t") -> DataFrame:
    """A features x samples table, its first column the features, as long rows (sample, feature, value); what is no number is null."""
    wide = read_tsv(spark, path, sep=sep)
    first, *samples = wide.columns
    numbers = wide.select(F.col(f"`{first}`").alias(feature), *[to_double(F.col(f"`{c}`")).alias(c) for c in samples])
    return to_long(numbers, [feature], samples, sample, "value").select(sample, feature, "value")


def read_cells_csv(spark: SparkSession, path: str, cells_in: str = "columns") -> DataFrame:
    """A counts table as (cell, feature, value) without zeros. Its orientation is declared, not guessed."""
    names = ("feature", "cell") if cells_in == "columns" else ("cell", "feature")
    return read_matrix(spark, path, *names, sep=",").select("cell", "feature", "value").where("value <> 0")


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def sniff_gzip(spark: SparkSession, path: str) -> DataFrame:
    """(path, gzipped): by the first two bytes, for files without a telling extension."""
    return spark.read.format("binaryFile").load(path).select("path", (F.hex(F.substring("content", 1, 2)) == "1F8B").alias("gzipped"))


def subset_samples(matrix: DataFrame, ids: DataFrame, width: int = 15, sample: str = "sample") -> DataFrame:
    """The samples of a list, compared by the first ``width`` characters of their ids (vial suffixes differ)."""
    wanted = ids.select(F.substring("id", 1, width).alias("_id")).distinct()
    return matrix.join(F.broadcast(wanted), F.substring(sample, 1, width) == F.col("_id"), "left_semi")


def first_release(spark: SparkSession, releases: list[tuple[str, str, str]], sep: str = ",") -> tuple[DataFrame, DataFrame, str]:
    """(scores, models, label) of the first release (scores path, models path, label) of which both files are there."""
    for scores, models, label in releases:
        try:
            return read_tsv(spark, scores, sep=sep), read_tsv(spark, models, sep=sep), label
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError("; ".join(r[2] for r in releases))


def dependency_summary(scores: DataFrame, wanted: DataFrame, essential: float = -0.5) -> DataFrame:
    """(feature, n, mean, median, essential_share, verdict) of ``scores`` (model_id, feature, value) for each wanted feature; one without scores has no_data."""
    v = F.col("value")
    found = scores.where(v.isNotNull()).groupBy("feature").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.avg(F.when(v < essential, 1.0).otherwise(0.0)).alias("essential_share"))
    mean = F.col("mean")
    verdict = F.when(mean.isNull(), "no_data").when(mean < essential, "pan_essential").when(mean < essential / 2, "moderately_essential").when(mean < 0, "weakly_essential").otherwise("not_essential")
    return wanted.select("feature").distinct().join(found, "feature", "left").fillna(0, ["n"]).withColumn("verdict", verdict)


def read_compendium(spark: SparkSession, path: str, code: str, code_column: str = "CANCER_TYPE", symbol_column: str = "SYMBOL") -> DataFrame:
    """(feature): the distinct symbols of one code of a compendium of driver genes."""
    return read_tsv(spark, path).where(F.col(code_column) == code).select(F.col(symbol_column).alias("feature")).distinct()


def read_oriented(spark: SparkSession, path: str, markers: list[str], sep: str = ",") -> DataFrame:
    """(cell, feature, value) of a counts table whose orientation is not known: features lie where more of the ``markers`` are, in the header or in the first column."""
    wide = read_tsv(spark, path, sep=sep)
    first, *others = wide.columns
    across = len(set(others) & set(markers))
    down = wide.select(F.col(f"`{first}`").alias("name")).where(F.col("name").isin(markers)).distinct().count()
    if across == down:
        raise ValueError(f"markers do not tell the orientation of {path}: {across} in the header, {down} in the first column")
    return read_cells_csv(spark, path, "columns" if down > across else "rows")


def dependency_scores(scores: DataFrame, models: DataFrame, lineage: str) -> DataFrame:
    """(model_id, feature, value) of one lineage from a wide table whose columns are 'SYMBOL (number)'."""
    key, *genes = scores.columns
    named = scores.select(F.col(f"`{key}`").alias("model_id"), *[to_double(F.col(f"`{c}`")).alias(c.split(" (")[0]) for c in genes])
    long = to_long(named, ["model_id"], named.columns[1:])
    return long.join(F.broadcast(models.where(F.lower("lineage").contains(lineage.lower())).select("model_id")), "model_id", "left_semi")

"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word rules of the operators name it.
SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="tallgrass-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tallgrass/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation of what came before. ``folders``: columns with a folder for each value."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path, partitionBy=list(folders) or None)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The words between runs of ``separators`` (a regular expression); null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text, F.octet_length(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

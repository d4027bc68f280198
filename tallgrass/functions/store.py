"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local master that names none gets a temporary one; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tallgrass-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back. What follows does not compute them again, and a lost executor does not either."""
    path = f"{shared_folder(rows.sparkSession)}/tallgrass/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def overwritten(rows: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """``rows`` written over what is at ``path`` and read back: for rounds, whose older tables nothing needs. ``rows`` must not come from there."""
    rows.write.mode("overwrite").option("compression", codec).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind: for rounds whose tables are stored and whose steps are not run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)

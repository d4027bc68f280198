"""Writers: Parquet with provenance, delimited export, verdicts and run logs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, provenance: dict[str, str] | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet at ``path``, and a row of provenance at ``path``_provenance."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    row = df.sparkSession.createDataFrame([(json.dumps(provenance or {}, sort_keys=True),)], "details string").withColumn("written_at", F.current_timestamp())
    row.write.mode("overwrite").parquet(f"{path}_provenance")


def write_version(df: DataFrame, folder: str) -> str:
    """Write to a new path in ``folder`` and return it; what is there stays."""
    path = f"{folder}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def write_tsv(df: DataFrame, path: str, missing: str = "") -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", missing).csv(path)


def write_tsv_with_provenance(df: DataFrame, path: str, provenance: dict[str, str], missing: str = "") -> None:
    """Delimited text whose files each begin with a comment line for each item of ``provenance``, and the header. ``read_tsv`` skips the comments."""
    import pyarrow as pa

    names = "\t".join(df.columns)
    head = [*(f"# {k}: {v}" for k, v in provenance.items()), names]
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) for c in df.columns]).alias("value")

    def run(batches):
        yield pa.RecordBatch.from_pydict({"value": pa.array(head)})
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": batch.column("value")})

    df.select(line).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_bundle(tables: dict[str, DataFrame], path: str, script: str, inputs: DataFrame | None = None, finite: dict[str, list[str]] | None = None) -> None:
    """Each table as Parquet at ``path``/name, and at ``path``/provenance a row for each table (kind, name, rows) and each input (kind, name, sha256) of ``inputs`` (path, sha256). Tables with metrics that are null or not
    finite (``finite``: table -> columns) are refused before anything is written."""
    for name, columns in (finite or {}).items():
        bad = tables[name].where(F.exists(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).limit(1).count()
        if bad:
            raise ValueError(f"{name} has metrics that are not finite")
    log = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = df.sparkSession.read.parquet(f"{path}/{name}").agg(F.lit("table").alias("kind"), F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(None).cast("string").alias("sha256"))
        log = row if log is None else log.union(row)
    if inputs is not None:
        log = log.union(inputs.select(F.lit("input"), "path", F.lit(None).cast("long"), "sha256"))
    log.withColumns({"script": F.lit(script), "written_at": F.current_timestamp()}).write.mode("overwrite").parquet(f"{path}/provenance")


def markdown(df: DataFrame, most: int = 50, digits: int = 4) -> str:
    """The first ``most`` rows as a Markdown table; numbers with ``digits`` places. For summaries, so the number of rows is stated."""
    kinds = dict(df.dtypes)
    shown = df.limit(most).select(*[F.when(F.col(f"`{c}`").isNull(), "").otherwise(F.format_string(f"%.{digits}f", F.col(f"`{c}`").cast("double")) if kinds[c] in ("double", "float") else F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    rows = [list(r) for r in shown.collect()]
    return "\n".join("| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def append_outcomes(df: DataFrame, path: str) -> None:
    """Rows added to an outcome table; columns that it has and ``df`` has not are null in them."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).limit(0)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = df.limit(0)
    there.unionByName(df, allowMissingColumns=True).write.mode("append").parquet(path)


def write_verdict(row: DataFrame, path: str) -> None:
    """A table of one row as one JSON object."""
    row.coalesce(1).write.mode("overwrite").json(path)


def fill_not_applicable(df: DataFrame, columns: list[str], word: str = "not_applicable") -> DataFrame:
    """Null, NaN and empty strings become a word; for export only."""
    return df.withColumns({c: F.when(F.col(c).isNull() | (F.col(c).cast("string").isin("", "NaN")), F.lit(word)).otherwise(F.col(c).cast("string")) for c in columns})


def log_row(df: DataFrame, step: str, status: str, note: str = "") -> DataFrame:
    """A row for the append-only run log; status is OK, SKIPPED, FAILED, NEEDS_REVIEW or DATA_UNAVAILABLE."""
    if status not in ("OK", "SKIPPED", "FAILED", "NEEDS_REVIEW", "DATA_UNAVAILABLE"):
        raise ValueError(status)
    return df.sparkSession.createDataFrame([(step, status, note)], "step string, status string, note string").withColumn("at", F.current_timestamp())


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): the aggregate behind a histogram; bin 0 and bins + 1 hold what lies outside."""
    return df.groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def search(df: DataFrame, column: str, text: str = "", prefix_column: str | None = None, prefix: str = "", order: str | None = None, descending: bool = False) -> DataFrame:
    """A table browser's query: text anywhere in a column, a prefix of another, and an order."""
    out = df.where(F.lower(column).contains(text.lower()))
    if prefix_column:
        out = out.where(F.col(prefix_column).startswith(prefix))
    return out.orderBy(F.desc(order) if descending else F.asc(order)) if order else out

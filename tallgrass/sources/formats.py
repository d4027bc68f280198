"""Text formats of expression archives, gene sets, networks and spatial sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions.expr import first_field, last_field, to_double
from tallgrass.sources.lines import read_lines

_NO_SYMBOL = ("", "---", "NA", "nan", "NaN")


def between(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """The lines after the one that begins with ``begin`` and before ``end``, of each file."""
    marks = lines.groupBy("path").agg(F.min(F.when(F.col("line").startswith(begin), F.col("at"))).alias("_b"), F.min(F.when(F.col("line").startswith(end), F.col("at"))).alias("_e"))
    return lines.join(marks, "path").where((F.col("at") > F.col("_b")) & (F.col("at") < F.col("_e"))).drop("_b", "_e")


def read_series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(sample, probe, value) of series-matrix files: the table between its markers, quotes stripped, numbers coerced; probes without any number are left out."""
    rows = between(read_lines(spark, path), "!series_matrix_table_begin", "!series_matrix_table_end")
    cells = rows.withColumn("cells", F.transform(F.split("line", "\t"), lambda x: F.trim(F.translate(x, '"', ""))))
    first = cells.groupBy("path").agg(F.min_by("cells", "at").alias("names"), F.min("at").alias("_first"))
    body = cells.join(first, "path").where(F.col("at") > F.col("_first"))
    pairs = F.posexplode(F.slice(F.col("cells"), 2, F.size("cells")))
    long = body.select("path", F.col("cells")[0].alias("probe"), "names", pairs.alias("_i", "_v"))
    values = long.select("path", F.get("names", F.col("_i") + 1).alias("sample"), "probe", to_double("_v").alias("value"))
    any_value = F.count("value").over(Window.partitionBy("path", "probe"))
    return values.withColumn("_n", any_value).where("_n > 0").select("sample", "probe", "value")


def clean_mapping(pairs: DataFrame) -> DataFrame:
    """(probe, symbol): the first of several symbols, trimmed; sentinels left out."""
    symbol = first_field(first_field("symbol", "///"), "//")
    return pairs.select(F.trim("probe").alias("probe"), symbol.alias("symbol")).where(~F.col("symbol").isin(*_NO_SYMBOL)).distinct()


def read_platform(spark: SparkSession, path: str, symbol_names: tuple[str, ...] = ("Gene Symbol", "Symbol", "ILMN_Gene", "GENE_SYMBOL")) -> DataFrame:
    """(probe, symbol) of platform annotation files; the symbol column is the first of the names that the header has, in any case and with blanks or underscores. A file with none of
    them is an error when it is read."""
    cells = between(read_lines(spark, path), "!platform_table_begin", "!platform_table_end").withColumn("cells", F.split("line", "\t"))
    heads = cells.groupBy("path").agg(F.min_by("cells", "at").alias("names"), F.min("at").alias("_first"))
    plain = F.transform("names", lambda x: F.lower(F.translate(F.trim(x), "_", " ")))
    place = F.coalesce(*[F.nullif(F.array_position(plain, n.lower().replace("_", " ")), F.lit(0)) for n in symbol_names], F.raise_error(F.concat(F.lit("no symbol column in "), F.col("path"))))
    body = cells.join(heads.withColumn("_s", place), "path").where(F.col("at") > F.col("_first"))
    return clean_mapping(body.select(F.col("cells")[0].alias("probe"), F.get("cells", F.col("_s").cast("int") - 1).alias("symbol")).na.drop())


def read_ppi(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """(src, dst, weight) of a blank-separated protein network; the species prefix before the last dot is stripped, scores are per thousand."""
    rows = spark.read.option("sep", " ").option("header", True).schema("protein1 string, protein2 string, combined_score double").csv(path)
    out = rows.select(last_field("protein1", ".").alias("src"), last_field("protein2", ".").alias("dst"), (F.col("combined_score") / 1000).alias("weight"))
    return out.where(F.col("weight") >= least)


def read_pathways(spark: SparkSession, path: str, species: str = "Homo sapiens") -> DataFrame:
    names = "id string, pathway string, url string, name string, evidence string, species string"
    return spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").schema(names).csv(path).where(F.col("species").contains(species))


def read_sets(spark: SparkSession, path: str, drop_first: int = 0) -> DataFrame:
    """(term, feature) of ragged lines: a term and its members; ``drop_first`` fields after the term are no members."""
    fields = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("f"))
    members = F.slice("f", 2 + drop_first, F.greatest(F.size("f"), F.lit(1)))
    return fields.select(F.trim(F.col("f")[0]).alias("term"), F.explode(members).alias("feature")).select("term", F.trim("feature").alias("feature")).where("feature <> ''").distinct()


def read_ligand_receptor(spark: SparkSession, path: str) -> DataFrame:
    """(ligand, receptor, pathway); empty if the file has not those columns."""
    rows = spark.read.option("header", True).csv(path)
    if {"ligand", "receptor"} <= set(rows.columns):
        return rows.select("ligand", "receptor", (F.col("pathway") if "pathway" in rows.columns else F.lit(None).cast("string")).alias("pathway"))
    return spark.createDataFrame([], "ligand string, receptor string, pathway string")


def read_coordinates(spark: SparkSession, matrix: str, rows: str, columns: str) -> DataFrame:
    """(feature, cell, value) of a coordinate matrix and its two name lists (1-based places). The first line that is no comment has the shape."""
    body = read_lines(spark, matrix).where("line <> '' and not startswith(line, '%')")
    shape = body.groupBy("path").agg(F.min("at").alias("_shape"))
    entries = body.join(shape, "path").where(F.col("at") > F.col("_shape")).select(F.split(F.trim("line"), r"\s+").alias("e"))
    places = entries.select(F.get("e", F.lit(0)).try_cast("long").alias("i"), F.get("e", F.lit(1)).try_cast("long").alias("j"), F.coalesce(F.get("e", F.lit(2)).try_cast("double"), F.lit(1.0)).alias("value"))
    names = [read_lines(spark, p).where("line <> ''").select((F.col("at") + 1).alias(k), F.split("line", "\t").alias(n)) for p, k, n in ((rows, "i", "f"), (columns, "j", "c"))]
    return places.join(names[0], "i").join(names[1], "j").select(F.coalesce(F.get("f", F.lit(1)), F.col("f")[0]).alias("feature"), F.col("c")[0].alias("cell"), "value")

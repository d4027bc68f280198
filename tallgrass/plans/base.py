"""The query registry, and the test tables seen as matrices, sets and graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the same in SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


# order lines as cells with four features
CELLS = """cells AS (SELECT l_suppkey AS sample, l_returnflag AS condition, l_linestatus AS tissue, l_quantity AS qty,
  l_extendedprice AS price, l_discount AS disc, l_tax AS tax FROM lineitem)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    names = {"sample": "l_suppkey", "condition": "l_returnflag", "tissue": "l_linestatus", "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}
    return read(spark, d, "lineitem").select(*[F.col(c).alias(k) for k, c in names.items()])


# suppliers by brands
MATRIX = """m AS (SELECT l_suppkey AS sample, p_brand AS feature, sum(l_extendedprice) / 1000.0::DOUBLE AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def matrix(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = read(spark, d, "lineitem"), read(spark, d, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return joined.groupBy(F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("feature")).agg((F.sum("l_extendedprice") / 1000.0).alias("value"))


MODULE_ROWS = [(m, f"Brand#{b}") for m, bs in {"m1": (1, 2, 3, 4, 5), "m2": (6, 7, 8, 9, 10), "m3": (1, 11, 12, 13, 14, 15), "m4": (16, 99)}.items() for b in bs]
MODULES = "modules AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{f}')" for m, f in MODULE_ROWS) + ") AS t(module, feature))"
#: z-scores of the matrix (population sd), and the module scores of the first policy.
Z = """z AS (SELECT sample, feature, value, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM m WINDOW w AS (PARTITION BY feature))"""
SCORES = "scores AS (SELECT sample, module, avg(coalesce(z, 0)) AS score, count(*) AS n_features FROM z JOIN modules USING (feature) GROUP BY 1, 2)"
WIDE = """wide AS (SELECT sample, coalesce(max(CASE WHEN module = 'm1' THEN score END), 0) AS m1, coalesce(max(CASE WHEN module = 'm2' THEN score END), 0) AS m2,
  coalesce(max(CASE WHEN module = 'm3' THEN score END), 0) AS m3, coalesce(max(CASE WHEN module = 'm4' THEN score END), 0) AS m4 FROM scores GROUP BY sample)"""
SCORED = f"{MATRIX}, {MODULES}, {Z}, {SCORES}"
WIDED = f"{SCORED}, {WIDE}"


def modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODULE_ROWS, "module string, feature string")


# users by event types
EVENTS = "ev AS (SELECT user_id AS cell, event_type AS feature, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2)"


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("feature")).agg(F.count("*").cast("double").alias("value"))


# parts, suppliers: a typed graph whose edges come from order lines; the type is the shipping state, the weight the discount
EDGES = """edges AS (SELECT 'p' || (l_partkey % 200) AS src, 's' || l_suppkey AS dst, l_returnflag AS edge_type, l_discount AS weight FROM lineitem)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    return lines.select(
        F.concat(F.lit("p"), F.col("l_partkey") % 200).alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("edge_type"), F.col("l_discount").alias("weight")
    )


# customers on a hexagonal grid of 50 columns
SPOTS = """spots AS (SELECT c_custkey AS spot, CAST(c_custkey // 50 AS INTEGER) AS array_row, CAST(2 * (c_custkey % 50) + (c_custkey // 50) % 2 AS INTEGER) AS array_col,
  c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)"""


def spots(spark: SparkSession, d: str) -> DataFrame:
    row = F.expr("c_custkey div 50")
    place = read(spark, d, "customer")
    return place.select(F.col("c_custkey").alias("spot"), row.cast("int").alias("array_row"), (2 * (F.col("c_custkey") % 50) + row % 2).cast("int").alias("array_col"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"))


# labelled documents with a score from their length
LABELLED = """lab AS (SELECT doc_id, lang, quality AS y, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(n_chars::DOUBLE - 1500.0::DOUBLE) / 1000.0::DOUBLE)), 3) AS s1,
  round((doc_id % 97)::DOUBLE / 96.0::DOUBLE, 3) AS s2 FROM labels JOIN documents USING (doc_id))"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    s1 = 1.0 / (1.0 + F.exp(-(F.col("n_chars").cast("double") - 1500.0) / 1000.0))
    return rows.select("doc_id", "lang", F.col("quality").alias("y"), F.round(s1, 3).alias("s1"), F.round((F.col("doc_id") % 97).cast("double") / 96.0, 3).alias("s2"))

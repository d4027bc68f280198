"""Declared analyses: modules, comparisons and assets as data, checked before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = "card string, module string, role string, direction string, features array<string>"
COMPARISONS = "card string, comparison string, a string, b string, expected int"


def load_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def modules_frame(spark: SparkSession, cards: dict[str, dict]) -> DataFrame:
    """(card, module, role, direction, features) of cards {card: {module: {role, expected_direction, genes}}}; specs are small and come from the driver."""
    rows = [(c, m, s.get("role"), s.get("expected_direction"), list(s["genes"])) for c, ms in cards.items() for m, s in ms.items()]
    return spark.createDataFrame(rows, MODULES)


def registry(rows: DataFrame) -> DataFrame:
    """What ``modules_frame`` gives, from a stored table of cards: (card, module, role, direction, feature), a row for each feature."""
    return rows.groupBy("card", "module", "role", "direction").agg(F.collect_set("feature").alias("features"))


def members(modules: DataFrame) -> DataFrame:
    """(card, module, feature)."""
    return modules.select("card", "module", F.explode("features").alias("feature")).distinct()


def card_summary(modules: DataFrame) -> DataFrame:
    """(card, n_modules, n_features, roles)."""
    one = modules.select("card", "module", "role", F.explode("features").alias("feature"))
    return one.groupBy("card").agg(F.countDistinct("module").alias("n_modules"), F.countDistinct("feature").alias("n_features"), F.array_join(F.array_sort(F.collect_set("role")), ";").alias("roles"))


def comparisons_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r.get("card"), r.get("comparison"), r.get("a"), r.get("b"), r.get("expected")) for r in rows], COMPARISONS)


def comparison_problems(comparisons: DataFrame) -> DataFrame:
    """(comparison, problem): missing fields, signs that are not +1 or -1."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("card", "comparison", "a", "b", "expected")]), lambda x: x.isNotNull())
    sign = F.when(~F.col("expected").isin(1, -1), F.array(F.lit("sign is not explicit"))).otherwise(F.array().cast("array<string>"))
    return comparisons.select("comparison", F.explode(F.concat(missing, sign)).alias("problem"))


ASSETS = "asset string, accession string, source_url string, modality string, species string, sample_count int, sha256 string, local_path string, status string"
STATUSES = ("verified", "pending", "failed")


def asset_problems(assets: DataFrame, species: str = "Homo sapiens", forbidden: tuple[str, ...] = ("synthetic", "mock", "demo", "dummy")) -> DataFrame:
    """(asset, problem) of a manifest."""
    rules = {
        "missing field": F.exists(F.array("accession", "source_url", "modality", "species", "local_path"), lambda x: x.isNull() | (x == "")),
        "species": F.coalesce(F.col("species") != species, F.lit(False)),
        "sample count": F.coalesce(F.col("sample_count") <= 0, F.lit(True)),
        "status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "digest": (F.col("status") == "verified") & ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "forbidden path": F.exists(F.array(*map(F.lit, forbidden)), lambda t: F.lower("local_path").contains(t)),
    }
    return assets.select("asset", F.explode(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()])).alias("problem")).where("problem is not null")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def bind_paths(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem): what is only in the manifest or only among the files; empty for an exact match."""
    a, b = manifest.select(key).withColumn("_m", F.lit(1)), found.select(key).withColumn("_f", F.lit(1))
    problem = F.when(F.col("_m").isNull(), "not in manifest").when(F.col("_f").isNull(), "file missing")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")

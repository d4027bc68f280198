"""The long matrix (sample, feature, value): reshaping, coverage, duplicates, detection and scaling.

A wide table becomes a matrix by ``unpivot`` and stays long; selecting features is then a join and dropping them an anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.expr import ratio, to_double


def to_long(wide: DataFrame, ids: list[str], features: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    return wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in features]).unpivot(ids, features, feature, value)


def to_wide(long: DataFrame, ids: list[str], features: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """A column for each of the named features; a pivot that names its values needs no pass to find them."""
    return long.groupBy(*ids).pivot(feature, features).agg(F.first(value))


def transpose(long: DataFrame, sample: str = "sample", feature: str = "feature") -> DataFrame:
    """Samples and features change places: nothing but names in long form."""
    names = {sample: feature, feature: sample}
    return long.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in long.columns])


def coerce(long: DataFrame, value: str = "value") -> DataFrame:
    return long.withColumn(value, to_double(value))


def zero_complete(long: DataFrame, samples: DataFrame, features: DataFrame, value: str = "value") -> DataFrame:
    """Every (sample, feature); absent entries are zero. For small feature panels: rows are samples times features."""
    return samples.crossJoin(features).join(long, [*samples.columns, *features.columns], "left").fillna({value: 0.0})


def pick(long: DataFrame, modules: DataFrame, feature: str = "feature") -> DataFrame:
    """The entries of features that modules name, once for each module that names them."""
    return long.join(modules, feature)


def coverage(long: DataFrame, modules: DataFrame, module: str = "module", feature: str = "feature") -> DataFrame:
    """(module, n_named, n_present, coverage): absent features are reported, not skipped in silence."""
    present = long.select(feature).distinct().withColumn("_there", F.lit(1))
    per = modules.select(module, feature).distinct().join(present, feature, "left").groupBy(module)
    return per.agg(F.count("*").alias("n_named"), F.count("_there").alias("n_present"), ratio(F.count("_there"), F.count("*")).alias("coverage"))


def mask(long: DataFrame, features: DataFrame, feature: str = "feature") -> DataFrame:
    """Without the named features."""
    return long.join(features.select(feature).distinct(), feature, "left_anti")


def standardise_names(rows: DataFrame, aliases: DataFrame, name: str = "feature") -> DataFrame:
    """Upper-case, alias to canonical name, else itself; empty names go. ``aliases`` has alias and canonical."""
    upper = rows.withColumn(name, F.upper(F.trim(name)))
    known = aliases.select(F.upper("alias").alias("_alias"), "canonical")
    return upper.join(F.broadcast(known), F.col(name) == F.col("_alias"), "left").withColumn(name, F.coalesce("canonical", name)).drop("_alias", "canonical").where(F.col(name) != "")


def highest_mean(long: DataFrame, symbol: str = "symbol", probe: str = "probe", value: str = "value") -> DataFrame:
    """The one probe of each symbol with the highest mean (ties: first by name): symbol, probe, mean."""
    means = long.groupBy(symbol, probe).agg(F.avg(value).alias("mean"))
    best = Window.partitionBy(symbol).orderBy(F.desc("mean"), probe)
    return means.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def to_symbols(long: DataFrame, mapping: DataFrame, how: str = "mean", sample: str = "sample", probe: str = "probe", symbol: str = "symbol", value: str = "value") -> DataFrame:
    """(sample, symbol, value, n): probes named by ``mapping`` (probe, symbol), those without a symbol left out. Several probes of a symbol are averaged, or ``how`` is highest_mean and the probe with the highest mean
    over all samples stands for it. ``n`` probes of the sample are in a value. A probe with several symbols counts for each; the mapping has a row for each pair."""
    named = long.join(mapping.select(probe, symbol).where(F.col(symbol).isNotNull()).distinct(), probe)
    if how == "highest_mean":
        named = named.join(highest_mean(named, symbol, probe, value).select(symbol, probe), [symbol, probe], "left_semi")
    return named.groupBy(sample, symbol).agg(F.avg(value).alias(value), F.count("*").alias("n"))


def mean_collapse(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(value).alias(value))


def detection(long: DataFrame, feature: str = "feature", value: str = "value", n_samples: Column | None = None) -> DataFrame:
    """(feature, rate): the share of samples with a value over zero, of all samples if their number is given (sparse tables)."""
    seen = F.count_if(F.col(value) > 0)
    return long.groupBy(feature).agg(ratio(seen, F.count("*") if n_samples is None else n_samples).alias("rate"))


def varying(long: DataFrame, feature: str = "feature", value: str = "value", least: float = 1e-10) -> DataFrame:
    """Features that are not constant."""
    return long.groupBy(feature).agg(F.stddev_pop(value).alias("sd")).where(F.col("sd") > least).select(feature)


def in_all_groups(long: DataFrame, group: str, feature: str = "feature", least: int | None = None) -> DataFrame:
    """(feature, n_groups): features in every group, or in at least ``least``."""
    per = long.groupBy(feature).agg(F.countDistinct(group).alias("n_groups"))
    total = long.agg(F.countDistinct(group).alias("_all"))
    return per.join(F.broadcast(total)).where(F.col("n_groups") >= (F.col("_all") if least is None else least)).drop("_all")


def min_max(rows: DataFrame, columns: list[str], least: float = 1e-12) -> DataFrame:
    """Each column scaled to 0 ... 1 over all rows, as <column>_scaled; zero where the range is nothing. The ranges are one broadcast row."""
    ends = rows.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    out = rows.join(F.broadcast(ends))
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(f"{c}_scaled", F.when(span > least, ratio(F.col(c) - F.col(f"_lo_{c}"), span)).otherwise(0.0))
    return out.drop(*ends.columns)


def split_ids(ids: Column, mark: str, field: int) -> Column:
    return F.split_part(ids, F.lit(mark), F.lit(field))


def check_one_to_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that are there more than once; empty for a proper key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def concat(frames: list[DataFrame], how: str = "outer") -> DataFrame:
    """The rows of all frames, with the columns that all of them have (``inner``) or that any of them has (``outer``, null where a frame lacks one)."""
    if how not in ("inner", "outer"):
        raise ValueError("how is inner or outer")
    if how == "inner":
        shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        frames = [f.select(*shared) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=how == "outer")
    return out


def not_finite(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n_null, n_not_finite) of each of the ``metrics``, counted in one pass."""
    odd = [F.struct(F.lit(m).alias("metric"), F.count_if(F.col(m).isNull()).alias("n_null"), F.count_if(F.isnan(m) | (F.abs(F.col(m)) == float("inf"))).alias("n_not_finite")) for m in metrics]
    return rows.agg(F.array(*odd).alias("m")).select(F.inline("m"))

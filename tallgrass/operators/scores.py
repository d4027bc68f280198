"""Module scores: the mean over a module's features of their z-scores, with every convention a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ZPolicy:
    """ddof: 0 or 1. constant: what a feature without variance gives: "zero" (z is 0), "null", "one" (divide by 1) or "eps" (divide by
    sd + eps). null_z: "zero" counts a missing z as 0 in the mean, "skip" leaves it out. empty: the score without any feature, 0.0 or None."""

    ddof: int = 0
    constant: str = "zero"
    null_z: str = "zero"
    empty: float | None = 0.0
    eps: float = 1e-10


#: The conventions in use, by name.
POLICIES = {
    "label": ZPolicy(),
    "unit_sd": ZPolicy(constant="one", null_z="skip", empty=None),
    "sample_zero": ZPolicy(ddof=1, constant="null", null_z="zero", empty=None),
    "sample_skip": ZPolicy(ddof=1, constant="null", null_z="skip", empty=None),
    "coverage": ZPolicy(constant="one", null_z="skip", empty=None),
    "eps": ZPolicy(constant="eps", null_z="skip", empty=None),
    "sample_eps": ZPolicy(ddof=1, constant="eps", null_z="skip", empty=None),
}


def feature_stats(long: DataFrame, by: list[str], ddof: int = 0, value: str = "value") -> DataFrame:
    """(by, mu, sd, n): one small row for each feature; fitted on one cohort, it can be used on others."""
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    return long.groupBy(*by).agg(F.avg(value).alias("mu"), sd.alias("sd"), F.count(value).alias("n"))


def z_column(policy: ZPolicy, value: str = "value") -> Column:
    v, mu, sd = F.col(value), F.col("mu"), F.col("sd")
    if policy.constant == "eps":
        return (v - mu) / (sd + policy.eps)
    z = (v - mu) / F.when(sd > 0, sd)
    if policy.constant == "one":
        return F.when(sd > 0, z).otherwise(v - mu)
    return F.when(sd > 0, z).otherwise(0.0 if policy.constant == "zero" else None)


def z_scores(long: DataFrame, by: list[str], policy: ZPolicy = ZPolicy(), stats: DataFrame | None = None) -> DataFrame:
    """``long`` with z. The statistics are a grouped aggregate, joined back: a row for each feature goes to every task, the matrix stays."""
    stats = feature_stats(long, by, policy.ddof) if stats is None else stats
    return long.join(stats.select(*by, "mu", "sd"), by).withColumn("z", z_column(policy)).drop("mu", "sd")


def module_scores(z: DataFrame, modules: DataFrame, samples: list[str], policy: ZPolicy = ZPolicy()) -> DataFrame:
    """(samples, module, score, n_features): modules (module, feature) may overlap."""
    part = F.coalesce("z", F.lit(0.0)) if policy.null_z == "zero" else F.col("z")
    scored = z.join(F.broadcast(modules.select("module", "feature")), "feature").groupBy(*samples, "module")
    mean = F.avg(part)
    return scored.agg((mean if policy.empty is None else F.coalesce(mean, F.lit(policy.empty))).alias("score"), F.count("*").alias("n_features"))


def raw_means(long: DataFrame, modules: DataFrame, samples: list[str]) -> DataFrame:
    """Module means without scaling."""
    return long.join(F.broadcast(modules.select("module", "feature")), "feature").groupBy(*samples, "module").agg(F.avg("value").alias("score"))


def score_table(scores: DataFrame, samples: list[str], modules: list[str], empty: float | None = 0.0) -> DataFrame:
    """A column for each module."""
    wide = scores.groupBy(*samples).pivot("module", modules).agg(F.first("score"))
    return wide if empty is None else wide.fillna(empty, modules)


def composites(table: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Derived scores from declared expressions over module columns, such as {"balance": "a - b"}."""
    return table.withColumns({name: F.expr(text) for name, text in formulas.items()})


def apply_wide(rows: DataFrame, stats: DataFrame, columns: list[str], floor: float = 1e-8) -> DataFrame:
    """Standardise wide columns with one row of fitted statistics (mu_<c>, sd_<c>); sd up to ``floor`` counts as 1."""
    out = rows.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"mu_{c}")) / F.when(F.col(f"sd_{c}") > floor, F.col(f"sd_{c}")).otherwise(1.0))
    return out.drop(*stats.columns)


def fit_wide(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The one row that ``apply_wide`` takes; fit it on training rows only."""
    return rows.agg(*[F.avg(c).alias(f"mu_{c}") for c in columns], *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns])

"""Permutation importance of groups of features for a linear score that is fitted already.

The values of a group are dealt anew among the rows of a fold, all features of the group together: the row with rank k by id takes those of the row with rank k in the order of
md5(seed:group:perm:id). A linear score changes by the difference of the group's own part, so a permuted copy is a join on (fold, rank) of one number for each row and group, and nothing is fitted again.

Defined cases: a feature that is absent from a row counts as zero; a row without any feature of a group has a part of zero; groups may share features; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.expr import draw_key
from tallgrass.functions.store import stored
from tallgrass.operators import evaluation
from tallgrass.operators.order import running


def permutation_importance(rows: DataFrame, long: DataFrame, coefficients: DataFrame, groups: DataFrame, n: int, seed: int = 42, at: float = 0.0) -> DataFrame:
    """(fold, grp, perm, auroc, mcc, auroc_drop, mcc_drop). ``rows`` (id, fold, y), ``long`` (id, feature, value), ``coefficients`` (fold, feature, weight; the feature null is the intercept),
    ``groups`` (grp, feature)."""
    known = long.join(rows.select("id", "fold"), "id")
    part = known.join(coefficients.where("feature is not null"), ["fold", "feature"]).withColumn("part", F.col("value") * F.col("weight"))
    base = part.groupBy("id").agg(F.sum("part").alias("sum"))
    start = coefficients.where("feature is null").select("fold", F.col("weight").alias("intercept"))
    scored = stored(
        rows.join(base, "id", "left").join(start, "fold", "left").select("id", "fold", "y", (F.coalesce("sum", F.lit(0.0)) + F.coalesce("intercept", F.lit(0.0))).alias("score")), "importance-scores"
    )
    # the group's part of every row's score, zero where it has none
    own = part.join(groups, "feature").groupBy("id", "grp").agg(F.sum("part").alias("own"))
    names = groups.select("grp").distinct()
    each = stored(scored.select("id", "fold").join(names).join(own, ["id", "grp"], "left").fillna(0.0, ["own"]), "importance-parts")  # rows x groups: the size of the result
    named = running(scored.select("id", "fold"), [F.asc("id")], ["fold"], "at")
    perms = each.select("id", "fold", "grp", "own", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm")).withColumn("key", draw_key(seed, "grp", "perm", "id"))
    dealt = running(perms, [F.asc("key"), F.asc("id")], ["fold", "grp", "perm"], "at").select("fold", "grp", "perm", "at", F.col("own").alias("given"))
    moved = named.join(dealt, ["fold", "at"]).join(each, ["id", "fold", "grp"]).join(scored.select("id", "y", "score"), "id")
    shifted = stored(moved.select("fold", "grp", "perm", "y", (F.col("score") - F.col("own") + F.col("given")).alias("score")), "importance-permuted")

    def measured(frame: DataFrame, keys: list[str], suffix: str) -> DataFrame:
        a, m = evaluation.auroc(frame, keys, "y", "score"), evaluation.confusion(frame, keys, "y", "score", at).select(*keys, "mcc")
        return a.join(m, keys).withColumnsRenamed({"auroc": f"auroc{suffix}", "mcc": f"mcc{suffix}"})

    whole = measured(scored, ["fold"], "_whole")
    out = measured(shifted, ["fold", "grp", "perm"], "").join(whole, "fold")
    return out.select("fold", "grp", "perm", "auroc", "mcc", (F.col("auroc_whole") - F.col("auroc")).alias("auroc_drop"), (F.col("mcc_whole") - F.col("mcc")).alias("mcc_drop"))

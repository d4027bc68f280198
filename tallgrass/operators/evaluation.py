"""Classifier evaluation in grouped aggregates: confusion metrics, AUROC, AUPRC, folds, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.expr import draw_key, ratio
from tallgrass.operators.order import running


def confusion(rows: DataFrame, groups: list[str], y: str, score: str, at: float = 0.5) -> DataFrame:
    """(groups, n, tp, fp, tn, fn, accuracy, balanced_accuracy, macro_f1, mcc); positive from ``at`` on."""
    pos, guess = F.col(y) == 1, F.col(score) >= at
    per = rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if(pos & guess).alias("tp"), F.count_if(~pos & guess).alias("fp"), F.count_if(~pos & ~guess).alias("tn"), F.count_if(pos & ~guess).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    zero = F.lit(0.0)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    f1 = [F.coalesce(ratio(2 * a, 2 * a + fp + fn), zero) for a in (tp, tn)]
    recall = [F.coalesce(ratio(tp, tp + fn), zero), F.coalesce(ratio(tn, tn + fp), zero)]
    return per.withColumns({
        "accuracy": ratio(tp + tn, "n"),
        "balanced_accuracy": (recall[0] + recall[1]) / 2,
        "macro_f1": (f1[0] + f1[1]) / 2,
        "mcc": F.coalesce(ratio(tp * tn - fp * fn, den), zero),
    })


def by_score(rows: DataFrame, groups: list[str], y: str, score: str) -> DataFrame:
    """(groups, score, pos, neg, cp, cn): distinct scores with counts and running counts from the highest down. What both curves need, a row for each tie."""
    ties = rows.groupBy(*groups, F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    placed = running(ties, [F.desc("score")], groups, None, {"_p": "pos", "_q": "neg"})
    return placed.select(*groups, "score", "pos", "neg", (F.col("_p") + F.col("pos")).alias("cp"), (F.col("_q") + F.col("neg")).alias("cn"))


def auroc(rows: DataFrame, groups: list[str], y: str, score: str) -> DataFrame:
    """(groups, auroc): the chance that a positive scores higher, ties half; null with one class only."""
    t = by_score(rows, groups, y, score)
    wins = F.sum(F.col("neg").cast("double") * (F.col("cp") - F.col("pos") + F.col("pos") / F.lit(2.0)))
    return t.groupBy(*groups).agg(ratio(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def auprc(rows: DataFrame, groups: list[str], y: str, score: str) -> DataFrame:
    """(groups, auprc): step-wise average precision over distinct scores."""
    t = by_score(rows, groups, y, score)
    step = F.sum(F.col("pos").cast("double") * F.col("cp").cast("double") / (F.col("cp") + F.col("cn")).cast("double"))
    return t.groupBy(*groups).agg(ratio(step, F.sum("pos")).alias("auprc"))


def stratified_folds(rows: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """With fold 0 ... n - 1, dealt in turn within each label in a hashed order."""
    keyed = rows.withColumn("_draw", draw_key(seed, key))
    return running(keyed, [F.asc("_draw"), F.asc(key)], [label], "_at").withColumn("fold", (F.col("_at") - 1) % n).drop("_draw", "_at")


def ensemble(rows: DataFrame, keys: list[str], value: str = "probability") -> DataFrame:
    """The mean over seeds."""
    return rows.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n_seeds"))


def mean_sd(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def metric_pairs(rows: DataFrame, method: str, reference: str, keys: list[str], value: str) -> DataFrame:
    """(keys, method, a, b): every other method's value beside the reference's on the same fold."""
    ref = rows.where(F.col(method) == reference).select(*keys, F.col(value).alias("b"))
    return rows.where(F.col(method) != reference).select(*keys, method, F.col(value).alias("a")).join(ref, keys)


def label_problems(rows: DataFrame, key: str, y: str) -> DataFrame:
    """(problem, n): null labels, repeated keys, and a single class."""
    nulls = rows.agg(F.count_if(F.col(y).isNull()).alias("n")).select(F.lit("null_label").alias("problem"), "n")
    twice = rows.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_key").alias("problem"), "n")
    single = rows.agg(F.when(F.countDistinct(y) < 2, 1).otherwise(0).cast("long").alias("n")).select(F.lit("single_class").alias("problem"), "n")
    return nulls.union(twice).union(single)

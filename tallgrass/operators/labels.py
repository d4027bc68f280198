"""Rule-based labels with thresholds fitted on one cohort and frozen for others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.expr import ratio
from tallgrass.operators.order import quantiles


def fit_thresholds(scores: DataFrame, columns: list[str], at: float = 0.5) -> DataFrame:
    """One row: t_<column>, the exact quantile."""
    found = quantiles(scores, {c: [at] for c in columns})
    return scores.sparkSession.createDataFrame([tuple(found[c][0] for c in columns)], ", ".join(f"`t_{c}` double" for c in columns))


def immune_states(scores: DataFrame, thresholds: DataFrame, infiltration: str, cytotoxic: str, dysfunction: str, exclusion: str, out: str = "state") -> DataFrame:
    """Four states; the first rule that holds wins, and a value at the threshold is on both of its sides."""
    t = {c: F.col(f"t_{c}") for c in (infiltration, cytotoxic, dysfunction, exclusion)}
    i, c, d, e = (F.col(x) for x in (infiltration, cytotoxic, dysfunction, exclusion))
    rule = (
        F.when((i >= t[infiltration]) & (c >= t[cytotoxic]) & (d <= t[dysfunction]), "cytotoxic")
        .when((i >= t[infiltration]) & (d >= t[dysfunction]), "dysfunctional")
        .when((i <= t[infiltration]) & (e >= t[exclusion]), "excluded")
        .otherwise("intermediate")
    )
    return scores.join(F.broadcast(thresholds)).withColumn(out, rule).drop(*thresholds.columns)


def ordered_rules(rows: DataFrame, rules: list[tuple[str, Column]], default: str, out: str = "label") -> DataFrame:
    """The label of the first rule that holds."""
    found = F.lit(default)
    for label, rule in reversed(rules):
        found = F.when(rule, label).otherwise(found)
    return rows.withColumn(out, found)


def best_ratio(rows: DataFrame, thresholds: DataFrame, markers: list[str], default: str, out: str = "label") -> DataFrame:
    """The marker with the largest score / threshold of at least one; ties go to the marker named first. ``thresholds`` is a row of t_<marker>."""
    joined = rows.join(F.broadcast(thresholds))
    each = [F.struct(ratio(m, f"t_{m}").alias("r"), F.lit(-k).alias("order"), F.lit(m).alias("name")) for k, m in enumerate(markers)]
    best = F.array_max(F.array(*each))
    return joined.withColumn(out, F.when(best["r"] >= 1, best["name"]).otherwise(default)).drop(*thresholds.columns)


def above_quantile(rows: DataFrame, column: str, at: float, out: str, or_else: Column | None = None) -> DataFrame:
    """A flag: ``column`` over its quantile, or another condition."""
    over = F.col(column) > F.lit(quantiles(rows, {column: [at]})[column][0])
    return rows.withColumn(out, over if or_else is None else or_else | over)


def malignant(rows: DataFrame, annotated: Column, score: str, condition: Column, at: float = 0.75, out: str = "malignant") -> DataFrame:
    """A flag: annotated, or with a score over its quantile. Where nothing is either (no annotation, and no score or a constant one), the condition stands in for both."""
    t = quantiles(rows, {score: [at]})[score][0]
    rule = F.coalesce(annotated, F.lit(False)) | F.coalesce(F.col(score) > F.lit(t), F.lit(False))
    found = rows.agg(F.count_if(rule).alias("n")).first()["n"]
    return rows.withColumn(out, rule if found else F.coalesce(condition, F.lit(False)))


def quantile_band(rows: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    a, b = quantiles(rows, {column: [low, high]})[column]
    return rows.where((F.col(column) >= F.lit(a)) & (F.col(column) <= F.lit(b)))


def mad_filter(rows: DataFrame, column: str, n_mads: float = 5.0) -> DataFrame:
    """Strictly inside median +- n_mads times the median absolute deviation: two passes."""
    middle = quantiles(rows, {column: [0.5]})[column][0]
    away = F.abs(F.col(column) - F.lit(middle))
    spread = quantiles(rows.select(away.alias("away")), {"away": [0.5]})["away"][0]
    return rows.where(away < F.lit(n_mads) * F.lit(spread))


def barcode_condition(barcode: Column | str, mark: str = "-", field: int = 4) -> Column:
    """tumor below 10, normal from 10 on, else unknown, by the two digits that begin a field of the identifier."""
    code = F.substring(F.split_part(F.col(barcode) if isinstance(barcode, str) else barcode, F.lit(mark), F.lit(field)), 1, 2).try_cast("int")
    return F.when(code < 10, "tumor").when(code >= 10, "normal").otherwise("unknown")


def by_prefix(x: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """The category of the first prefix that fits."""
    x, out = (F.col(x) if isinstance(x, str) else x), F.lit(default)
    for prefix, category in reversed(rules):
        out = F.when(x.startswith(prefix), category).otherwise(out)
    return out


def direction_ok(expected: Column | str, r: Column | str) -> Column:
    """True or false if the sign is that expected; null where nothing is expected or measured."""
    e, r = (F.col(c) if isinstance(c, str) else c for c in (expected, r))
    return F.when(e.isNull() | r.isNull() | (e == 0), None).otherwise(F.signum(r) == F.signum(e))


def buckets(x: Column | str, cuts: list[tuple[float, str]], default: str, missing: str | None = None) -> Column:
    """The name of the first cut that x is below; ``missing`` for null."""
    x, out = (F.col(x) if isinstance(x, str) else x), F.lit(default)
    for cut, name in reversed(cuts):
        out = F.when(x < cut, name).otherwise(out)
    return F.when(x.isNull(), F.lit(missing)).otherwise(out)


def evidence_sum(terms: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(sum of the weights of the terms that hold, their names joined by '; ')."""
    score, names = F.lit(0.0), []
    for name, (rule, weight) in terms.items():
        score = score + F.when(rule, weight).otherwise(0.0)
        names.append(F.when(rule, name))
    return score, F.concat_ws("; ", *names)

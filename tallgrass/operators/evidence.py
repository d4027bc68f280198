"""Ranking over many evidence tables, and gates that turn results into verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.expr import ratio
from tallgrass.operators.order import running


def star_join(base: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """One row for each candidate with what every table says of it; tables have one row for each key."""
    for t in tables:
        base = base.join(t, key, "left")
    return base


def flags(rows: DataFrame, sets: dict[str, DataFrame], key: str) -> DataFrame:
    """A boolean for each named set of keys."""
    for name, s in sets.items():
        rows = rows.join(s.select(key).distinct().withColumn(name, F.lit(True)), key, "left").fillna({name: False})
    return rows


def weighted(columns: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for c, w in columns.items():
        total = total + w * F.col(c).cast("double")
    return total


def ranked(rows: DataFrame, by: list[Column], out: str = "rank", groups: list[str] | None = None) -> DataFrame:
    """Positions 1, 2, ...; ``by`` ends with a key, so that ties have an order. No task sees more than its part of a group."""
    return running(rows, by, groups, out)


def outer_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "full_outer")


def rank_change(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, rank_a, rank_b, delta) of keys in either ranking."""
    a, b = left.select(key, F.col("rank").alias("rank_a")), right.select(key, F.col("rank").alias("rank_b"))
    return outer_merge(a, b, key).withColumn("delta", F.col("rank_a") - F.col("rank_b"))


def top_overlap(changes: DataFrame, tops: list[int]) -> DataFrame:
    """(top, shared, jaccard): how many keys are among the first ``top`` of both rankings."""
    n = F.explode(F.array(*map(F.lit, tops))).alias("top")
    both = F.count_if((F.col("rank_a") <= F.col("top")) & (F.col("rank_b") <= F.col("top")))
    either = F.count_if((F.col("rank_a") <= F.col("top")) | (F.col("rank_b") <= F.col("top")))
    return changes.select("*", n).groupBy("top").agg(both.alias("shared"), ratio(both, either).alias("jaccard"))


def sign_concordance(rows: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    same = both & (F.signum(a) == F.signum(b))
    return rows.groupBy(*(groups or [])).agg(F.count_if(both).alias("n"), F.count_if(same).alias("same"), ratio(F.count_if(same), F.count_if(both)).alias("share"))


def recovery_status(rows: DataFrame, comparison: str, cohort: str, direction: str, passed: Column, coverage: Column, least_cohorts: int = 2) -> DataFrame:
    """With concordant_cohorts (cohorts of the comparison whose direction fits) and status."""
    fits = F.sum(F.when(F.col(direction), 1).otherwise(0)).over(Window.partitionBy(comparison))
    counted = rows.withColumn("concordant_cohorts", fits)
    ok = F.coalesce(F.col(direction), F.lit(False)) & passed
    status = F.when(coverage < 0.5, "not_evaluable").when(ok & (F.col("concordant_cohorts") >= least_cohorts), "recovered").when(ok, "partially_recovered").otherwise("not_recovered")
    return counted.withColumn("status", status)


def atlas_rollup(rows: DataFrame, card: str) -> DataFrame:
    """(card, n_comparisons, n_recovered, all_recovered, any_recovered, cohorts, statuses)."""
    hit = F.col("status") == "recovered"
    return rows.groupBy(card).agg(
        F.count("*").alias("n_comparisons"),
        F.count_if(hit).alias("n_recovered"),
        F.bool_and(hit).alias("all_recovered"),
        F.bool_or(hit).alias("any_recovered"),
        F.max("concordant_cohorts").alias("cohorts"),
        F.array_join(F.array_sort(F.collect_set("status")), ";").alias("statuses"),
    )


def pattern_verdict(atlas: DataFrame, direct: DataFrame, card: str, least_cards: int = 3, least_cohorts: int = 2) -> DataFrame:
    """One row: supported if enough cards are recovered in enough cohorts and one of them has direct evidence (card, scope; exploratory scopes do not count)."""
    eligible = direct.where("scope <> 'exploratory'").select(card).distinct().withColumn("_direct", F.lit(True))
    joined = atlas.join(F.broadcast(eligible), card, "left")
    good = F.col("any_recovered") & (F.col("cohorts") >= least_cohorts)
    n, d = F.count_if(good), F.count_if(good & F.coalesce("_direct", F.lit(False)))
    return joined.agg(n.alias("n_cards"), d.alias("n_direct"), F.when((n >= least_cards) & (d >= 1), "supported").otherwise("not_supported").alias("verdict"))


def gain_verdict(rows: DataFrame, required: DataFrame) -> DataFrame:
    """One row: stable_gain if every required (comparator, metric) is there with a positive delta and interval, else no_stable_gain."""
    ok = F.coalesce((F.col("observed_delta") > 0) & (F.col("ci_low") > 0), F.lit(False))
    return required.join(rows, ["comparator", "metric"], "left").agg(
        F.count("*").alias("n_required"), F.count_if(ok).alias("n_passed"), F.when(F.bool_and(ok), "stable_gain").otherwise("no_stable_gain").alias("verdict")
    )


def factorial_gaps(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Cells of the full factorial over the values that are there which are missing or repeated: (dimensions, n). The dimensions have few values each."""
    grid = None
    for d in dimensions:
        values = rows.select(d).distinct()
        grid = values if grid is None else grid.crossJoin(F.broadcast(values))
    counted = rows.groupBy(*dimensions).agg(F.count("*").alias("n"))
    return grid.join(counted, dimensions, "left").fillna({"n": 0}).where("n <> 1")


def favourite(rows: DataFrame, run: str, choice: str, weight: str, least: int) -> DataFrame:
    """(choice, wins, stable): in how many runs a choice has the largest weight (ties: first by name), for every choice."""
    best = rows.groupBy(run).agg(F.min(F.struct((-F.col(weight)).alias("w"), F.col(choice).alias("c")))["c"].alias(choice))
    wins = best.groupBy(choice).agg(F.count("*").alias("wins"))
    return rows.select(choice).distinct().join(wins, choice, "left").fillna({"wins": 0}).withColumn("stable", F.col("wins") >= least)


def over_representation(sets: DataFrame, chosen: DataFrame, universe: DataFrame, term: str = "term", feature: str = "feature") -> DataFrame:
    """(term, k, good, drawn, total): counts for a hypergeometric test of each set against the chosen features."""
    inside = sets.join(universe, feature, "left_semi").distinct()
    mark = chosen.join(universe, feature, "left_semi").select(feature).distinct().withColumn("_hit", F.lit(1))
    sizes = universe.select(feature).distinct().agg(F.count("*").alias("total")).join(mark.agg(F.count("*").alias("drawn")))
    return inside.join(mark, feature, "left").groupBy(term).agg(F.count("_hit").alias("k"), F.count("*").alias("good")).join(F.broadcast(sizes)).where("k > 0")

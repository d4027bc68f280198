"""Grouped statistics and tests. Each is one or two aggregations; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.expr import corr, corr_t, fisher_ci, partial_corr, ratio
from tallgrass.functions.store import stored
from tallgrass.operators.order import average_ranks, quantiles, running, smallest_from_here


def corr_by_group(rows: DataFrame, groups: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """(groups, n, r); groups of fewer than ``least`` rows are left out."""
    return rows.groupBy(*groups).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), corr(x, y).alias("r")).where(F.col("n") >= least)


def corr_with_score(long: DataFrame, score: DataFrame, sample: str = "sample", feature: str = "feature") -> DataFrame:
    """(feature, n, r) of every feature with one score (sample, score)."""
    return long.join(score.select(sample, "score"), sample).groupBy(feature).agg(F.count("*").alias("n"), corr("value", "score").alias("r"))


def corr_test(rows: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """(groups, n, r, t, low, high) with the Fisher interval."""
    per = corr_by_group(rows, groups, x, y, 0)
    low, high = fisher_ci("r", "n")
    return per.withColumns({"t": corr_t("r", "n"), "low": low, "high": high})


def partial_corr_test(rows: DataFrame, groups: list[str], x: str, y: str, z: str) -> DataFrame:
    """(groups, n, r, rp, t, low, high, attenuation): r before and after one covariate; the interval and t have one degree less."""
    three = [F.col(c).isNotNull() for c in (x, y, z)]
    full = rows.where(three[0] & three[1] & three[2]).groupBy(*groups)
    per = full.agg(F.count("*").alias("n"), corr(x, y).alias("r"), corr(x, z).alias("_xz"), corr(y, z).alias("_yz"))
    per = per.withColumn("rp", partial_corr("r", "_xz", "_yz")).drop("_xz", "_yz")
    low, high = fisher_ci("rp", "n", 4)
    return per.withColumns({"t": corr_t("rp", "n", 1), "low": low, "high": high, "attenuation": 100 * ratio(F.col("r") - F.col("rp"), "r")})


def residuals_two(rows: DataFrame, y: str, a: str, b: str, out: str = "residual") -> DataFrame:
    """y less its least-squares fit on two covariates, from one row of moments; a covariate that adds nothing is left out."""
    m = rows.agg(
        *[F.avg(c).alias(f"_m{c}") for c in (y, a, b)],
        F.covar_pop(a, a).alias("_aa"), F.covar_pop(b, b).alias("_bb"), F.covar_pop(a, b).alias("_ab"), F.covar_pop(y, a).alias("_ya"), F.covar_pop(y, b).alias("_yb"),
    )
    aa, bb, ab, ya, yb = (F.col(c) for c in ("_aa", "_bb", "_ab", "_ya", "_yb"))
    det = aa * bb - ab * ab
    good = det > 1e-12 * aa * bb
    ka = F.when(good, ratio(ya * bb - yb * ab, det)).otherwise(F.coalesce(ratio(ya, aa), F.lit(0.0)))
    kb = F.when(good, ratio(yb * aa - ya * ab, det)).otherwise(0.0)
    fitted = F.col(f"_m{y}") + ka * (F.col(a) - F.col(f"_m{a}")) + kb * (F.col(b) - F.col(f"_m{b}"))
    return rows.join(F.broadcast(m)).withColumn(out, F.col(y) - fitted).drop(*m.columns)


def explained(rows: DataFrame, y: str, residual: str) -> Column:
    """Aggregate: the share of y's variance that the fit explains."""
    return 1 - ratio(F.var_pop(residual), F.var_pop(y))


def spearman(rows: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """(groups, n, rho) by average ranks."""
    ranked = average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y], groups)
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), corr(f"_rank_{x}", f"_rank_{y}").alias("rho"))


def two_arms(rows: DataFrame, groups: list[str], x: str, arm: Column) -> DataFrame:
    """(groups, na, nb, ma, mb, va, vb): sizes, means and sample variances where ``arm`` is true (a) and false (b)."""
    a, b = F.when(arm, F.col(x)), F.when(~arm, F.col(x))
    return rows.groupBy(*groups).agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))


def cohen_d(arms: DataFrame) -> DataFrame:
    """With d (pooled sample variance) and its standard error."""
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    pooled = ratio((na - 1) * F.col("va") + (nb - 1) * F.col("vb"), na + nb - 2)
    d = (F.col("ma") - F.col("mb")) / F.when(pooled > 0, F.sqrt(pooled))
    se = F.sqrt(ratio(na + nb, na * nb) + ratio(F.col("d") * F.col("d"), 2 * (na + nb)))
    return arms.withColumn("d", d).withColumn("se", se)


def welch(arms: DataFrame) -> DataFrame:
    """With Welch's t and its degrees of freedom."""
    a, b = ratio("va", "na"), ratio("vb", "nb")
    t = (F.col("ma") - F.col("mb")) / F.when(a + b > 0, F.sqrt(a + b))
    df = ratio((a + b) * (a + b), ratio(a * a, F.col("na") - 1) + ratio(b * b, F.col("nb") - 1))
    return arms.withColumns({"t": t, "df": df})


def contrasts(rows: DataFrame, plan: DataFrame, groups: list[str], x: str, state: str, least: int = 3) -> DataFrame:
    """Arms for each contrast in ``plan`` (contrast, state, arm: 'a' or 'b'); a state may serve in several contrasts. Both arms need ``least`` rows."""
    joined = rows.join(F.broadcast(plan), state)
    return two_arms(joined, [*groups, "contrast"], x, F.col("arm") == "a").where((F.col("na") >= least) & (F.col("nb") >= least))


def random_effects(effects: DataFrame, groups: list[str], effect: str = "effect", se: str = "se") -> DataFrame:
    """DerSimonian-Laird: (groups, k, q, c, tau2, i2, pooled, pooled_se, z). One study is itself, without heterogeneity."""
    w, e = 1 / (F.col(se) * F.col(se)), F.col(effect)
    sums = effects.groupBy(*groups).agg(
        F.count("*").alias("k"), F.sum(w).alias("w1"), F.sum(w * w).alias("w2"), F.sum(w * e).alias("we"), F.sum(w * e * e).alias("wee")
    )
    q = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.col("wee") - F.col("we") * F.col("we") / F.col("w1"))).otherwise(0.0)
    c = F.col("w1") - F.col("w2") / F.col("w1")
    free = (F.col("k") - 1).cast("double")
    tau2 = F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), (F.col("q") - free) / F.when(c > 0, c))).otherwise(0.0)
    i2 = F.when(F.col("q") > free, 100 * (F.col("q") - free) / F.when(F.col("q") > 0, F.col("q"))).otherwise(0.0)
    summed = sums.withColumn("q", q).withColumns({"c": c, "tau2": tau2, "i2": i2}).select(*groups, "k", "q", "c", "tau2", "i2")
    again = effects.join(F.broadcast(summed.select(*groups, "tau2")), groups) if groups else effects.join(F.broadcast(summed.select("tau2")))
    v = 1 / (F.col(se) * F.col(se) + F.col("tau2"))
    pooled = again.groupBy(*groups).agg((F.sum(v * e) / F.sum(v)).alias("pooled"), F.sqrt(1 / F.sum(v)).alias("pooled_se"))
    joined = summed.join(pooled, groups) if groups else summed.join(pooled)
    return joined.withColumn("z", F.col("pooled") / F.col("pooled_se"))


def leave_one_out(effects: DataFrame, group: str, effect: str = "effect", se: str = "se") -> DataFrame:
    """The meta-analysis without each group in turn: (excluded, ...). The effects are a row for each group; a null group has no part.

    What is left without a group is the sum over all less its own part. For the pooled effect, whose weights change with each group's tau2, studies with equal standard errors are added up
    first, so a group meets a row for each distinct standard error and not all other groups. An effect or weight that is no finite number makes the others' results NaN."""
    w, e = 1 / (F.col(se) * F.col(se)), F.col(effect).cast("double")
    rows = effects.where(F.col(group).isNotNull()).select(F.col(group).alias("excluded"), e.alias("_e"), F.col(se).cast("double").alias("_se"), w.alias("_w"))
    bad = F.coalesce(F.isnan("_e") | (F.abs("_e") == float("inf")), F.lit(False)) | F.coalesce(F.isnan("_w") | (F.abs("_w") == float("inf")), F.lit(False))
    rows = rows.withColumns({"_bad": bad.cast("int"), "_e": F.when(~bad, F.col("_e")), "_w": F.when(~bad, F.col("_w"))})
    parts = {"w1": F.col("_w"), "w2": F.col("_w") * F.col("_w"), "we": F.col("_w") * F.col("_e"), "wee": F.col("_w") * F.col("_e") * F.col("_e")}
    parts = {n: F.coalesce(x, F.lit(0.0)) for n, x in parts.items()}
    rows = stored(rows.withColumns(parts), "left-out-effects")
    total = rows.agg(F.count("*").alias("_k"), F.sum("_bad").alias("_n_bad"), *[F.sum(n).alias(f"_{n}") for n in parts])  # a row
    k, none = F.col("_k") - 1, F.when(F.col("_n_bad") > F.col("_bad"), F.lit(float("nan"))).otherwise(0.0)
    left = rows.join(F.broadcast(total)).where("_k > 1").select("excluded", "_e", "_se", "_bad", "_n_bad", k.alias("k"), *[(F.col(f"_{n}") - F.col(n) + none).alias(n) for n in parts])
    q = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.col("wee") - F.col("we") * F.col("we") / F.col("w1"))).otherwise(0.0)
    c, free = F.col("w1") - F.col("w2") / F.col("w1"), (F.col("k") - 1).cast("double")
    tau2 = F.when((F.col("k") > 1) & (F.col("c") > 0), F.greatest(F.lit(0.0), (F.col("q") - free) / F.when(F.col("c") > 0, F.col("c")))).otherwise(0.0)
    i2 = F.when(F.col("q") > free, 100 * (F.col("q") - free) / F.when(F.col("q") > 0, F.col("q"))).otherwise(0.0)
    summed = left.withColumns({"q": q, "c": c}).withColumns({"tau2": tau2, "i2": i2})
    alike = rows.where("_bad = 0 and _se is not null").groupBy(F.col("_se").alias("_s")).agg(F.count("*").alias("_times"), F.coalesce(F.sum("_e"), F.lit(0.0)).alias("_es"))
    v = 1 / (F.col("_s") * F.col("_s") + F.col("tau2"))
    own = F.when((F.col("_bad") == 0) & (F.col("_s") == F.col("_se")), 1).otherwise(0)  # the group itself is taken out where its standard error is met
    met = summed.crossJoin(alike).withColumns({"_v": v * (F.col("_times") - own), "_ve": v * (F.col("_es") - own * F.coalesce("_e", F.lit(0.0)))})
    done = met.groupBy("excluded", "k", "q", "c", "tau2", "i2").agg((F.sum("_ve") / F.sum("_v")).alias("pooled"), F.sqrt(1 / F.sum("_v")).alias("pooled_se"))
    return done.withColumn("z", F.col("pooled") / F.col("pooled_se"))


def benjamini_hochberg(rows: DataFrame, p: str, ties: str, groups: list[str] | None = None, out: str = "q") -> DataFrame:
    """Adjusted p-values: p * n / rank, the smallest from the largest rank down, at most 1. A null p-value is no test and has a null one."""
    order = [F.asc(p), F.asc(ties)]
    ranked = running(rows.where(F.col(p).isNotNull()), order, groups, "_rank", totals={"_n": "1"})
    step = F.col(p) * F.col("_n").cast("double") / F.col("_rank").cast("double")
    found = smallest_from_here(ranked.withColumn("_step", step), "_step", order, groups, "_least")
    done = found.withColumn(out, F.least(F.lit(1.0), F.col("_least"))).drop("_rank", "_n", "_step", "_least")
    return done.unionByName(rows.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def binned_corr(rows: DataFrame, by: str, x: str, y: str, n_bins: int = 5, least: int = 30) -> DataFrame:
    """(bin, n, r): bins between quantiles of ``by``, closed on the right, equal edges joined."""
    edges = sorted({e for e in quantiles(rows, {by: [k / n_bins for k in range(n_bins + 1)]})[by] if e is not None})
    below = F.filter(F.array(*[F.lit(e) for e in edges[1:]]).cast("array<double>"), lambda e: e < F.col(by))
    return rows.where(F.col(by).isNotNull()).withColumn("bin", F.size(below)).groupBy("bin").agg(F.count("*").alias("n"), corr(x, y).alias("r")).where(F.col("n") >= least)


def population_corr(rows: DataFrame, sample: str, a: Column, x: str, b: Column, y: str, groups: list[str] | None = None, least: int = 3) -> DataFrame:
    """(groups, n, r): the means of x over one population of a sample and of y over another, correlated over the samples that have both; r is null below ``least`` samples. One pass over the rows."""
    keys = groups or []
    per = rows.groupBy(*keys, sample).agg(F.avg(F.when(a, F.col(x))).alias("_x"), F.avg(F.when(b, F.col(y))).alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    found = per.groupBy(*keys).agg(F.count("*").alias("n"), corr("_x", "_y").alias("r"))
    return found.withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def replication_outcome(r: Column | str, t: Column | str, expected: Column | str, at: float = 1.96) -> Column:
    """recovered: the expected sign and |t| of ``at`` or more; weak: the sign alone; wrong_sign; unresolved without an r."""
    r, t, expected = (F.col(c) if isinstance(c, str) else c for c in (r, t, expected))
    same = F.signum(r) == F.signum(expected.cast("double"))
    return F.when(r.isNull() | F.isnan(r), "unresolved").when(same & (F.abs(t) >= at), "recovered").when(same, "weak").otherwise("wrong_sign")


def paired_t(pairs: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """(groups, n, mean_diff, t, df)."""
    d = F.col(a) - F.col(b)
    per = pairs.groupBy(*groups).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"))
    t = F.col("mean_diff") / F.when(F.col("_sd") > 0, F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    return per.withColumns({"t": t, "df": F.col("n") - 1}).drop("_sd")


def signed_rank(pairs: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """(groups, n, w): Wilcoxon's sum of the ranks of positive differences; zero differences are left out, ties share their mean rank."""
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    ranked = average_ranks(d, ["_a"], groups)
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_rank__a")).otherwise(0.0)).alias("w"))


def log_fold_change(rows: DataFrame, groups: list[str], x: str, a: Column, b: Column) -> DataFrame:
    """(groups, lfc): mean of log1p where a, less that where b; in natural logarithms. Zero where either is absent; values up to -1 are left out."""
    v = F.when(F.col(x) > -1, F.log1p(F.when(F.col(x) > -1, F.col(x))))
    return rows.groupBy(*groups).agg(F.coalesce(F.avg(F.when(a, v)) - F.avg(F.when(b, v)), F.lit(0.0)).alias("lfc"))


def floored_ratio(rows: DataFrame, groups: list[str], x: str, a: Column, b: Column, floor: float = 0.01) -> DataFrame:
    return rows.groupBy(*groups).agg((F.avg(F.when(a, F.col(x))) / F.greatest(F.avg(F.when(b, F.col(x))), F.lit(floor))).alias("ratio"))

"""Queries on matrices: scores, labels, tests, and the flagship comparison of mechanisms across cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import special
from tallgrass.functions.expr import corr, corr_t, ratio
from tallgrass.functions.store import stored
from tallgrass.operators import evidence, labels, matrix as mx, scores as sc, stats
from tallgrass.plans.base import CELLS, EVENTS, MATRIX, MODULES, SCORED, WIDED, cells, event_counts, matrix, modules, query, read, rounded

FEATURES = ["qty", "price", "disc", "tax"]
CARD_MODULES = [("volume", "size", "qty"), ("volume", "size", "price"), ("volume", "cost", "price"), ("charges", "rate", "disc"), ("charges", "rate", "tax"), ("charges", "levy", "tax")]
COMPARISONS = [("volume", "size_cost", "size", "cost", 1), ("charges", "rate_levy", "rate", "levy", 1), ("charges", "rate_size", "rate", "size", -1)]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _recovery(spark: SparkSession, d: str) -> DataFrame:
    """(card, comparison, cohort, n, r, t, coverage, direction_ok): module scores are means of z-scores within each cohort."""
    rows = cells(spark, d)
    names = sorted({m for _, m, _ in CARD_MODULES})
    stat = rows.groupBy("condition").agg(*[f(c).alias(f"{k}_{c}") for c in FEATURES for k, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    z = rows.join(F.broadcast(stat), "condition")  # a row for each cohort
    for c in FEATURES:
        z = z.withColumn(f"z_{c}", (F.col(c) - F.col(f"mu_{c}")) / F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(1.0))
    # a module's features are few and declared, so its mean is one expression and the rows are read once
    scored = z.select("condition", *[(sum((F.col(f"z_{f}") for _, m, f in CARD_MODULES if m == name), F.lit(0.0)) / sum(m == name for _, m, _ in CARD_MODULES)).alias(name) for name in names])
    per = scored.groupBy("condition").agg(F.count("*").alias("n"), *[corr(a, b).alias(c) for _, c, a, b, _ in COMPARISONS])
    long = per.unpivot(["condition", "n"], [c for _, c, _, _, _ in COMPARISONS], "comparison", "r")
    spec = spark.createDataFrame([(card, c, e) for card, c, _, _, e in COMPARISONS], "card string, comparison string, expected int")
    # the share of a card's features that a cohort has any value of
    own = {card: sorted({f for c, _, f in CARD_MODULES if c == card}) for card, _, _ in CARD_MODULES}
    covered = rows.groupBy("condition").agg(*[(sum((F.count(f) > 0).cast("double") for f in fs) / len(fs)).alias(card) for card, fs in own.items()])
    covered = covered.unpivot(["condition"], list(own), "card", "coverage")
    out = long.join(F.broadcast(spec), "comparison").join(covered, ["condition", "card"]).withColumns({"t": corr_t("r", "n"), "direction_ok": labels.direction_ok("expected", "r")})
    return out.withColumnRenamed("condition", "cohort")


_RECOVERY = f"""{CELLS}, stat AS (SELECT condition, avg(qty) mq, stddev_pop(qty) sq, avg(price) mp, stddev_pop(price) sp, avg(disc) md, stddev_pop(disc) sd, avg(tax) mt, stddev_pop(tax) st FROM cells GROUP BY 1),
scored AS (SELECT condition, ((qty - mq) / sq + (price - mp) / sp) / 2 AS size, (price - mp) / sp AS cost, ((disc - md) / sd + (tax - mt) / st) / 2 AS rate, (tax - mt) / st AS levy FROM cells JOIN stat USING (condition)),
spec(card, comparison, expected) AS (VALUES ('volume', 'size_cost', 1), ('charges', 'rate_levy', 1), ('charges', 'rate_size', -1)),
per AS (SELECT condition AS cohort, count(*) AS n, 'size_cost' AS comparison, covar_pop(size, cost) / nullif(stddev_pop(size) * stddev_pop(cost), 0) AS r FROM scored GROUP BY 1
 UNION ALL SELECT condition, count(*), 'rate_levy', covar_pop(rate, levy) / nullif(stddev_pop(rate) * stddev_pop(levy), 0) FROM scored GROUP BY 1
 UNION ALL SELECT condition, count(*), 'rate_size', covar_pop(rate, size) / nullif(stddev_pop(rate) * stddev_pop(size), 0) FROM scored GROUP BY 1),
cov AS (SELECT condition AS cohort, 'volume' AS card, (CAST(count(qty) > 0 AS DOUBLE) + CAST(count(price) > 0 AS DOUBLE)) / 2 AS coverage FROM cells GROUP BY 1
 UNION ALL SELECT condition, 'charges', (CAST(count(disc) > 0 AS DOUBLE) + CAST(count(tax) > 0 AS DOUBLE)) / 2 FROM cells GROUP BY 1),
rec AS (SELECT card, comparison, cohort, n, r, r * sqrt((n - 2)::DOUBLE / (1 - r * r)) AS t, coverage, sign(r) = expected AS direction_ok FROM per JOIN spec USING (comparison) JOIN cov USING (cohort, card)),
counted AS (SELECT *, CAST(sum(CASE WHEN direction_ok THEN 1 ELSE 0 END) OVER (PARTITION BY comparison) AS BIGINT) AS concordant_cohorts FROM rec),
status AS (SELECT *, CASE WHEN direction_ok AND abs(t) >= 1.96 AND concordant_cohorts >= 2 THEN 'recovered' WHEN direction_ok AND abs(t) >= 1.96 THEN 'partially_recovered' ELSE 'not_recovered' END AS status FROM counted)"""


@query(f"WITH {_RECOVERY} SELECT card, comparison, cohort, n, round(r, 6) AS r, round(t, 4) AS t, coverage, direction_ok, concordant_cohorts, status FROM status")
def recovery_status(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: each declared comparison in each cohort, with direction, concordance and status."""
    rows = evidence.recovery_status(_recovery(spark, d), "comparison", "cohort", "direction_ok", F.abs("t") >= 1.96, F.col("coverage"))
    return rounded(rows, ["r"]).withColumn("t", F.round("t", 4)).select("card", "comparison", "cohort", "n", "r", "t", "coverage", "direction_ok", "concordant_cohorts", "status")


@query()
def recovery_status_fdr(spark: SparkSession, d: str) -> DataFrame:
    """The flagship with p-values adjusted over all comparisons and cohorts; p needs the t distribution, which SQL has not."""
    rows = _recovery(spark, d).withColumn("p", special.t_pvalue(F.col("t"), (F.col("n") - 2).cast("double")))
    tests = rows.withColumn("test", F.concat_ws(":", "comparison", "cohort"))
    adjusted = stats.benjamini_hochberg(tests, "p", "test", out="p_fdr")
    out = evidence.recovery_status(adjusted, "comparison", "cohort", "direction_ok", F.col("p_fdr") < 0.05, F.col("coverage"))
    return rounded(out, ["r", "t", "p", "p_fdr"]).select("card", "comparison", "cohort", "n", "r", "t", "p", "p_fdr", "direction_ok", "concordant_cohorts", "status")


@query(
    f"""WITH {_RECOVERY} SELECT card, count(*) AS n_comparisons, count(*) FILTER (status = 'recovered') AS n_recovered, bool_and(status = 'recovered') AS all_recovered, bool_or(status = 'recovered') AS any_recovered,
    max(concordant_cohorts) AS cohorts, string_agg(DISTINCT status, ';' ORDER BY status) AS statuses FROM status GROUP BY card"""
)
def atlas_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.recovery_status(_recovery(spark, d), "comparison", "cohort", "direction_ok", F.abs("t") >= 1.96, F.col("coverage"))
    return evidence.atlas_rollup(rows, "card")


@query(
    f"""WITH {_RECOVERY}, atlas AS (SELECT card, bool_or(status = 'recovered') AS any_recovered, max(concordant_cohorts) AS cohorts FROM status GROUP BY card),
    direct(card, scope) AS (VALUES ('volume', 'primary'), ('charges', 'exploratory'))
    SELECT count(*) FILTER (good) AS n_cards, count(*) FILTER (good AND has) AS n_direct, CASE WHEN count(*) FILTER (good) >= 1 AND count(*) FILTER (good AND has) >= 1 THEN 'supported' ELSE 'not_supported' END AS verdict
    FROM (SELECT any_recovered AND cohorts >= 2 AS good, card IN (SELECT card FROM direct WHERE scope <> 'exploratory') AS has FROM atlas)"""
)
def atlas_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.recovery_status(_recovery(spark, d), "comparison", "cohort", "direction_ok", F.abs("t") >= 1.96, F.col("coverage"))
    direct = spark.createDataFrame([("volume", "primary"), ("charges", "exploratory")], "card string, scope string")
    return evidence.pattern_verdict(evidence.atlas_rollup(rows, "card"), direct, "card", least_cards=1)


def _module_scores(spark: SparkSession, d: str, policy: sc.ZPolicy = sc.ZPolicy()) -> DataFrame:
    return sc.module_scores(sc.z_scores(matrix(spark, d), ["feature"], policy), modules(spark), ["sample"], policy)


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return sc.score_table(_module_scores(spark, d), ["sample"], ["m1", "m2", "m3", "m4"])


def _fixed_wide(spark: SparkSession, d: str) -> DataFrame:
    """The scores, stored: thresholds are fitted to the very values that are held against them, and the matrix is built once for all passes."""
    return stored(_wide(spark, d), "wide-scores")


@query(f"WITH {SCORED} SELECT sample, module, round(score, 6) AS score, n_features FROM scores")
def module_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_module_scores(spark, d), ["score"])


@query(
    f"""WITH {MATRIX}, {MODULES}, st AS (SELECT feature, avg(value) mu, stddev_pop(value) s0, stddev_samp(value) s1 FROM m GROUP BY 1),
    zz AS (SELECT sample, module, CASE WHEN s0 > 0 THEN (value - mu) / s0 ELSE 0 END z1, CASE WHEN s0 > 0 THEN (value - mu) / s0 ELSE value - mu END z2, CASE WHEN s1 > 0 THEN (value - mu) / s1 END z3, (value - mu) / (s0 + 1e-10) z7, (value - mu) / (s1 + 1e-10) z8 FROM m JOIN st USING (feature) JOIN modules USING (feature))
    SELECT sample, module, round(avg(z1), 6) AS label, round(avg(z2), 6) AS unit_sd, round(avg(coalesce(z3, 0)), 6) AS sample_zero, round(avg(z3), 6) AS sample_skip, round(avg(z2), 6) AS coverage, round(avg(z7), 6) AS eps, round(avg(z8), 6) AS sample_eps FROM zz GROUP BY 1, 2"""
)
def module_score_policies(spark: SparkSession, d: str) -> DataFrame:
    """Every z-score convention side by side; the matrix is joined with its features' statistics once."""
    long, m = matrix(spark, d), modules(spark)
    stat = long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("s0"), F.stddev_samp("value").alias("s1"))
    joined = long.join(F.broadcast(stat), "feature").join(F.broadcast(m), "feature")
    columns = {}
    for name, p in sc.POLICIES.items():
        z = sc.z_column(p)
        part = F.coalesce(z, F.lit(0.0)) if p.null_z == "zero" else z
        columns[name] = part
    for name, p in sc.POLICIES.items():
        sd = F.col("s1" if p.ddof else "s0")
        joined = joined.withColumn("sd", sd).withColumn(f"_{name}", columns[name])
    return rounded(joined.groupBy("sample", "module").agg(*[F.avg(f"_{n}").alias(n) for n in columns]), list(columns))


@query(f"WITH {WIDED} SELECT sample, round(m1 - m2, 6) AS balance, round((m1 + m2) / 2, 6) AS mean12, round(m1 + m3 - m4, 6) AS total FROM wide")
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    out = sc.composites(_wide(spark, d), {"balance": "m1 - m2", "mean12": "(m1 + m2) / 2", "total": "m1 + m3 - m4"})
    return rounded(out, ["balance", "mean12", "total"]).select("sample", "balance", "mean12", "total")


@query(f"WITH {MATRIX}, {MODULES} SELECT sample, module, round(avg(value), 2) AS score FROM m JOIN modules USING (feature) GROUP BY 1, 2")
def raw_module_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sc.raw_means(matrix(spark, d), modules(spark), ["sample"]), ["score"], 2)


@query(f"WITH {MATRIX}, {MODULES}, f AS (SELECT DISTINCT feature FROM m) SELECT module, count(*) AS n_named, count(f.feature) AS n_present, round(count(f.feature)::DOUBLE / count(*)::DOUBLE, 6) AS coverage FROM modules LEFT JOIN f USING (feature) GROUP BY module")
def module_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mx.coverage(matrix(spark, d), modules(spark)), ["coverage"])


@query(f"WITH {CELLS} SELECT sample, count(*) AS n, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS sd, count(*) FILTER (qty >= 25) AS n_large FROM cells GROUP BY sample")
def score_summary_by_sample(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"), F.round(F.stddev_samp("price"), 4).alias("sd"), F.count_if(F.col("qty") >= 25).alias("n_large"))


@query(f"WITH {CELLS} SELECT tissue, round(avg(price) FILTER (condition = 'A'), 4) AS mean_a, round(avg(price) FILTER (condition = 'N'), 4) AS mean_n, round(avg(price) FILTER (condition = 'X'), 4) AS mean_x, round(stddev_samp(price), 4) AS sd FROM cells GROUP BY tissue")
def condition_compare(spark: SparkSession, d: str) -> DataFrame:
    means = [F.round(F.avg(F.when(F.col("condition") == c.upper(), F.col("price"))), 4).alias(f"mean_{c}") for c in "anx"]
    return cells(spark, d).groupBy("tissue").agg(*means, F.round(F.stddev_samp("price"), 4).alias("sd"))


@query(
    """WITH alias(alias, canonical) AS (VALUES ('brand#1', 'B-ONE'), ('BRAND#2', 'B-TWO')), u AS (SELECT p_partkey, upper(trim(p_brand)) AS feature FROM part)
    SELECT coalesce(canonical, feature) AS feature, count(*) AS n FROM u LEFT JOIN (SELECT upper(alias) a, canonical FROM alias) ON a = feature WHERE coalesce(canonical, feature) <> '' GROUP BY 1"""
)
def feature_alias_standardise(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("brand#1", "B-ONE"), ("BRAND#2", "B-TWO")], "alias string, canonical string")
    return mx.standardise_names(read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("feature")), aliases).groupBy("feature").agg(F.count("*").alias("n"))


_PROBES = "pr AS (SELECT p_name AS symbol, p_brand || ':' || p_type AS probe, p_retailprice AS value FROM part)"


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_name").alias("symbol"), F.concat_ws(":", "p_brand", "p_type").alias("probe"), F.col("p_retailprice").alias("value"))


@query(f"WITH {_PROBES}, mm AS (SELECT symbol, probe, avg(value) AS mean FROM pr GROUP BY 1, 2) SELECT symbol, probe, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, probe) AS k FROM mm) WHERE k = 1")
def probe_collapse_highest_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mx.highest_mean(_probes(spark, d)), ["mean"])


@query(f"WITH {_PROBES} SELECT symbol, round(avg(value), 6) AS value FROM pr GROUP BY 1")
def probe_collapse_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mx.mean_collapse(_probes(spark, d), ["symbol"]), ["value"])


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, round(avg(c_acctbal), 6) AS balance FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def align_samples(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = read(spark, d, "orders").select("o_orderstatus", "o_custkey"), read(spark, d, "customer").select("c_custkey", "c_acctbal")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"), F.round(F.avg("c_acctbal"), 6).alias("balance"))


def _states(rows: str, t: str) -> str:
    return f"""SELECT sample, CASE WHEN m1 >= a AND m2 >= b AND m3 <= c THEN 'cytotoxic' WHEN m1 >= a AND m3 >= c THEN 'dysfunctional' WHEN m1 <= a AND m4 >= e THEN 'excluded' ELSE 'intermediate' END AS state
    FROM {rows} CROSS JOIN (SELECT quantile_cont(m1, 0.5) a, quantile_cont(m2, 0.5) b, quantile_cont(m3, 0.5) c, quantile_cont(m4, 0.5) e FROM {t})"""


@query(f"WITH {WIDED} {_states('wide', 'wide')}")
def state_labels(spark: SparkSession, d: str) -> DataFrame:
    wide = _fixed_wide(spark, d)
    return labels.immune_states(wide, labels.fit_thresholds(wide, ["m1", "m2", "m3", "m4"]), "m1", "m2", "m3", "m4").select("sample", "state")


@query(f"WITH {WIDED} {_states('(SELECT * FROM wide WHERE sample % 2 = 1)', '(SELECT * FROM wide WHERE sample % 2 = 0)')}")
def state_labels_frozen_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds from the even samples' cohort label the odd samples' cohort."""
    wide = _fixed_wide(spark, d)
    frozen = labels.fit_thresholds(wide.where("sample % 2 = 0"), ["m1", "m2", "m3", "m4"])
    return labels.immune_states(wide.where("sample % 2 = 1"), frozen, "m1", "m2", "m3", "m4").select("sample", "state")


@query(f"WITH {WIDED} SELECT state, count(*) AS n FROM ({_states('wide', 'wide')}) GROUP BY 1")
def state_distribution(spark: SparkSession, d: str) -> DataFrame:
    return state_labels(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN embedding[1]::DOUBLE > 0.1 THEN 'T' WHEN embedding[2]::DOUBLE > 0.1 THEN 'NK' WHEN embedding[3]::DOUBLE > 0.05 THEN 'B' ELSE 'Other' END AS label FROM embeddings) GROUP BY 1")
def celltype_rules(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = labels.ordered_rules(read(spark, d, "embeddings").drop("label"), [("T", e(0) > 0.1), ("NK", e(1) > 0.1), ("B", e(2) > 0.05)], "Other")
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
    t AS (SELECT greatest(quantile_cont(a, 0.85), 0.1) ta, greatest(quantile_cont(b, 0.85), 0.1) tb, greatest(quantile_cont(c, 0.85), 0.1) tc FROM e),
    r AS (SELECT vec_id, a / ta AS ra, b / tb AS rb, c / tc AS rc FROM e CROSS JOIN t)
    SELECT vec_id, CASE WHEN greatest(ra, rb, rc) < 1 THEN 'unassigned' WHEN ra >= rb AND ra >= rc THEN 'a' WHEN rb >= rc THEN 'b' ELSE 'c' END AS label FROM r"""
)
def celltype_ratio_argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("abc")])
    t = labels.fit_thresholds(rows, list("abc"), 0.85).select(*[F.greatest(F.col(f"t_{c}"), F.lit(0.1)).alias(f"t_{c}") for c in "abc"])
    return labels.best_ratio(rows, t, list("abc"), "unassigned").select("vec_id", "label")


@query(f"WITH {CELLS}, t AS (SELECT quantile_cont(price, 0.75) p FROM cells) SELECT condition, count(*) FILTER ((condition = 'A' AND tissue = 'O') OR price > p) AS n_malignant, count(*) AS n FROM cells CROSS JOIN t GROUP BY 1")
def malignant_flag(spark: SparkSession, d: str) -> DataFrame:
    flagged = labels.malignant(cells(spark, d), (F.col("condition") == "A") & (F.col("tissue") == "O"), "price", F.col("tissue") == "O")
    return flagged.groupBy("condition").agg(F.count_if("malignant").alias("n_malignant"), F.count("*").alias("n"))


@query("WITH m AS (SELECT median(value) v FROM events), s AS (SELECT m.v, median(abs(value - m.v)) dd FROM events CROSS JOIN m GROUP BY m.v) SELECT event_type, count(*) AS n, round(max(value), 6) AS top FROM events CROSS JOIN s WHERE abs(value - v) < 3 * dd GROUP BY 1")
def mad_filter(spark: SparkSession, d: str) -> DataFrame:
    return labels.mad_filter(read(spark, d, "events"), "value", 3.0).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))


@query("WITH t AS (SELECT quantile_cont(value, 0.01) a, quantile_cont(value, 0.99) b FROM events) SELECT event_type, count(*) AS n FROM events CROSS JOIN t WHERE value BETWEEN a AND b GROUP BY 1")
def percentile_band(spark: SparkSession, d: str) -> DataFrame:
    return labels.quantile_band(read(spark, d, "events"), "value").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, n AS (SELECT count(DISTINCT cell) c FROM ev) SELECT feature, round(count(*) FILTER (value > 0)::DOUBLE / max(c)::DOUBLE, 6) AS rate FROM ev CROSS JOIN n GROUP BY 1 HAVING count(*) FILTER (value > 0)::DOUBLE / max(c)::DOUBLE >= 0.5")
def detection_universe(spark: SparkSession, d: str) -> DataFrame:
    counts = event_counts(spark, d)
    n = counts.agg(F.countDistinct("cell").alias("_cells"))
    rates = mx.detection(counts.join(F.broadcast(n)), n_samples=F.max("_cells"))
    return rounded(rates.where("rate >= 0.5"), ["rate"])


@query("WITH b AS (SELECT DISTINCT p_brand, p_size FROM part), c AS (SELECT p_size AS feature, count(DISTINCT p_brand) AS n_groups FROM b GROUP BY 1) SELECT * FROM c WHERE n_groups >= 20")
def feature_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return mx.in_all_groups(read(spark, d, "part").select(F.col("p_size").alias("feature"), "p_brand"), "p_brand", least=20)


@query(f"WITH {MATRIX}, {MODULES} SELECT feature, count(*) AS n, round(sum(value), 6) AS total FROM m WHERE feature NOT IN (SELECT feature FROM modules WHERE module = 'm1') GROUP BY 1")
def mask_label_features(spark: SparkSession, d: str) -> DataFrame:
    masked = mx.mask(matrix(spark, d), modules(spark).where("module = 'm1'"))
    return masked.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH {MATRIX}, {MODULES}, v AS (SELECT feature, stddev_pop(value) AS sd FROM m GROUP BY 1), k AS (SELECT feature, sd, feature IN (SELECT feature FROM modules) AS named FROM v WHERE sd > 1e-10) SELECT feature, named, round(sd, 4) AS sd, row_number() OVER (ORDER BY named DESC, round(sd, 4) DESC, feature) AS rank FROM k")
def feature_selection(spark: SparkSession, d: str) -> DataFrame:
    sd = matrix(spark, d).groupBy("feature").agg(F.stddev_pop("value").alias("sd")).where("sd > 1e-10").withColumn("sd", F.round("sd", 4))
    named = evidence.flags(sd, {"named": modules(spark)}, "feature")
    return evidence.ranked(named, [F.desc("named"), F.desc("sd"), F.asc("feature")])


@query(f"WITH {CELLS} SELECT tissue, round(avg(ln(1 + price)) FILTER (condition = 'A') - avg(ln(1 + price)) FILTER (condition = 'R'), 6) AS lfc FROM cells GROUP BY 1")
def fold_change_log1p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.log_fold_change(cells(spark, d), ["tissue"], "price", F.col("condition") == "A", F.col("condition") == "R"), ["lfc"])


@query(f"WITH {CELLS} SELECT sample, round(avg(price) FILTER (condition = 'A') / greatest(avg(price) FILTER (condition = 'N'), 0.01), 6) AS ratio FROM cells GROUP BY 1")
def tumour_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.floored_ratio(cells(spark, d), ["sample"], "price", F.col("condition") == "A", F.col("condition") == "N"), ["ratio"])


@query(f"WITH {WIDED} SELECT feature, count(*) AS n, round(covar_pop(value, m1) / nullif(stddev_pop(value) * stddev_pop(m1), 0), 6) AS r FROM m JOIN wide USING (sample) GROUP BY 1")
def corr_feature_vs_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.corr_with_score(matrix(spark, d), _wide(spark, d).select("sample", F.col("m1").alias("score"))), ["r"])


@query(f"WITH {CELLS} SELECT sample, count(*) AS n, round(covar_pop(qty, price) / nullif(stddev_pop(qty) * stddev_pop(price), 0), 6) AS r FROM cells GROUP BY 1 HAVING count(*) >= 5")
def corr_by_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.corr_by_group(cells(spark, d), ["sample"], "qty", "price"), ["r"])


@query(
    f"""WITH {CELLS}, p AS (SELECT condition, count(*) AS n, covar_pop(qty, price) / nullif(stddev_pop(qty) * stddev_pop(price), 0) AS r FROM cells GROUP BY 1)
    SELECT condition, n, round(r, 6) AS r, round(r * sqrt((n - 2)::DOUBLE / (1 - r * r)), 4) AS t, round(tanh(atanh(r) - 1.96 / sqrt((n - 3)::DOUBLE)), 6) AS low, round(tanh(atanh(r) + 1.96 / sqrt((n - 3)::DOUBLE)), 6) AS high FROM p"""
)
def corr_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.corr_test(cells(spark, d), ["condition"], "qty", "price"), ["r", "low", "high"]).withColumn("t", F.round("t", 4))


def _r(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query(
    f"""WITH {CELLS}, p AS (SELECT condition, count(*) AS n, {_r("qty", "price")} AS r, {_r("qty", "disc")} AS a, {_r("price", "disc")} AS b FROM cells GROUP BY 1),
    q AS (SELECT *, (r - a * b) / sqrt((1 - a * a) * (1 - b * b)) AS rp FROM p)
    SELECT condition, n, round(r, 6) AS r, round(rp, 6) AS rp, round(rp * sqrt((n - 3)::DOUBLE / (1 - rp * rp)), 4) AS t, round(tanh(atanh(rp) - 1.96 / sqrt((n - 4)::DOUBLE)), 6) AS low, round(tanh(atanh(rp) + 1.96 / sqrt((n - 4)::DOUBLE)), 6) AS high, round(100 * (r - rp) / r, 4) AS attenuation FROM q"""
)
def partial_corr(spark: SparkSession, d: str) -> DataFrame:
    out = stats.partial_corr_test(cells(spark, d), ["condition"], "qty", "price", "disc")
    return rounded(out, ["r", "rp", "low", "high"]).withColumns({"t": F.round("t", 4), "attenuation": F.round("attenuation", 4)})


@query(
    f"""WITH {CELLS}, mo AS (SELECT avg(price) y, avg(qty) a, avg(disc) b, var_pop(qty) aa, var_pop(disc) bb, covar_pop(qty, disc) ab, covar_pop(price, qty) ya, covar_pop(price, disc) yb FROM cells),
    k AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) ka, (yb * aa - ya * ab) / (aa * bb - ab * ab) kb FROM mo), re AS (SELECT condition, price, price - (y + ka * (qty - a) + kb * (disc - b)) AS res FROM cells CROSS JOIN k)
    SELECT condition, count(*) AS n, round(1 - var_pop(res) / var_pop(price), 6) AS r2 FROM re GROUP BY 1"""
)
def residual_r2(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.residuals_two(cells(spark, d), "price", "qty", "disc")
    return rounded(rows.groupBy("condition").agg(F.count("*").alias("n"), stats.explained(rows, "price", "residual").alias("r2")), ["r2"])


_EFFECTS = f"{CELLS}, ef AS (SELECT sample, atanh({_r('qty', 'price')}) AS effect, 1 / sqrt((count(*) - 3)::DOUBLE) AS se FROM cells GROUP BY 1 HAVING count(*) >= 5)"


def _effects(spark: SparkSession, d: str) -> DataFrame:
    per = stats.corr_by_group(cells(spark, d), ["sample"], "qty", "price")
    return per.select("sample", F.atanh("r").alias("effect"), (1 / F.sqrt((F.col("n") - 3).cast("double"))).alias("se"))


def _meta(rows: str, by: str) -> str:
    g, k, j = (f"{by}, ", f"GROUP BY {by}", f"JOIN s2 USING ({by})") if by else ("", "", "CROSS JOIN s2")
    return f"""s1 AS (SELECT {g}count(*) AS k, sum(1 / (se * se)) w1, sum(1 / (se * se * se * se)) w2, sum(effect / (se * se)) we, sum(effect * effect / (se * se)) wee FROM {rows} {k}),
    s2 AS (SELECT {g}k, greatest(0, wee - we * we / w1) AS q, w1 - w2 / w1 AS c, greatest(0, (greatest(0, wee - we * we / w1) - (k - 1)) / (w1 - w2 / w1)) AS tau2 FROM s1),
    s3 AS (SELECT {g}sum(effect / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS pooled, sqrt(1 / sum(1 / (se * se + tau2))) AS pooled_se FROM {rows} {j} {k})
    SELECT {g}k, round(q, 4) AS q, round(c, 4) AS c, round(tau2, 6) AS tau2, round(CASE WHEN q > k - 1 THEN 100 * (q - (k - 1)) / q ELSE 0 END, 4) AS i2, round(pooled, 6) AS pooled, round(pooled_se, 6) AS pooled_se, round(pooled / pooled_se, 4) AS z
    FROM s2 {f"JOIN s3 USING ({by})" if by else "CROSS JOIN s3"}"""


@query(f"WITH {_EFFECTS}, {_meta('ef', '')}")
def dl_meta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(stats.random_effects(_effects(spark, d), []), ["tau2", "pooled", "pooled_se"]), ["q", "c", "i2", "z"], 4)


@query(f"WITH {_EFFECTS}, lo AS (SELECT b.sample AS excluded, a.effect, a.se FROM ef a JOIN ef b ON a.sample <> b.sample), {_meta('lo', 'excluded')}")
def loo_meta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(stats.leave_one_out(_effects(spark, d), "sample"), ["tau2", "pooled", "pooled_se"]), ["q", "c", "i2", "z"], 4)


_ARMS = f"{CELLS}, ar AS (SELECT sample, count(*) FILTER (condition = 'A') na, count(*) FILTER (condition <> 'A') nb, avg(price) FILTER (condition = 'A') ma, avg(price) FILTER (condition <> 'A') mb, var_samp(price) FILTER (condition = 'A') va, var_samp(price) FILTER (condition <> 'A') vb FROM cells GROUP BY 1)"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return stats.two_arms(cells(spark, d), ["sample"], "price", F.col("condition") == "A")


@query(f"WITH {_ARMS} SELECT sample, na, nb, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) * (va / na + vb / nb) / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)), 4) AS df FROM ar")
def welch_t(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.welch(_arms(spark, d)), ["t"]).withColumn("df", F.round("df", 4)).select("sample", "na", "nb", "t", "df")


@query()
def welch_t_pvalues(spark: SparkSession, d: str) -> DataFrame:
    tested = stats.welch(_arms(spark, d)).withColumn("p", special.t_pvalue("t", "df"))
    return rounded(stats.benjamini_hochberg(tested, "p", "sample"), ["t", "df", "p", "q"]).select("sample", "t", "df", "p", "q")


@query(f"WITH {_ARMS}, dd AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM ar) SELECT sample, round(d, 6) AS d, round(sqrt((na + nb)::DOUBLE / (na * nb)::DOUBLE + d * d / (2 * (na + nb))), 6) AS se FROM dd")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.cohen_d(_arms(spark, d)), ["d", "se"]).select("sample", "d", "se")


_PLAN = [("A_vs_N", "A", "a"), ("A_vs_N", "N", "b"), ("A_vs_rest", "A", "a"), ("A_vs_rest", "N", "b"), ("A_vs_rest", "R", "b")]


@query(
    f"""WITH {CELLS}, plan(contrast, condition, arm) AS (VALUES {_values(_PLAN)}), long AS (UNPIVOT cells ON qty, price, disc, tax INTO NAME feature VALUE v),
    ar AS (SELECT feature, contrast, count(*) FILTER (arm = 'a') na, count(*) FILTER (arm = 'b') nb, avg(v) FILTER (arm = 'a') ma, avg(v) FILTER (arm = 'b') mb, var_samp(v) FILTER (arm = 'a') va, var_samp(v) FILTER (arm = 'b') vb FROM long JOIN plan USING (condition) GROUP BY 1, 2)
    SELECT feature, contrast, na, nb, round(ma - mb, 6) AS diff, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t FROM ar WHERE na >= 3 AND nb >= 3"""
)
def state_de_contrasts(spark: SparkSession, d: str) -> DataFrame:
    long = mx.to_long(cells(spark, d), ["sample", "condition"], FEATURES)
    plan = spark.createDataFrame(_PLAN, "contrast string, condition string, arm string")
    out = stats.welch(stats.contrasts(long, plan, ["feature"], "value", "condition")).withColumn("diff", F.col("ma") - F.col("mb"))
    return rounded(out, ["diff", "t"]).select("feature", "contrast", "na", "nb", "diff", "t")


@query(
    f"""WITH {CELLS}, p AS (SELECT sample, avg(disc) * 2 AS p FROM cells GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, sample) AS r, count(*) OVER () AS n FROM p)
    SELECT sample, round(p, 6) AS p, round(least(1, min(p * n::DOUBLE / r::DOUBLE) OVER (ORDER BY r DESC)), 6) AS q FROM k"""
)
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).groupBy("sample").agg((F.avg("disc") * 2).alias("p"))
    return rounded(stats.benjamini_hochberg(rows, "p", "sample"), ["p", "q"])


@query(
    f"""WITH {CELLS}, e AS (SELECT quantile_cont(disc, 0.2) a, quantile_cont(disc, 0.4) b, quantile_cont(disc, 0.6) c, quantile_cont(disc, 0.8) f, quantile_cont(disc, 1.0) g, quantile_cont(disc, 0.0) z FROM cells),
    x AS (SELECT qty, price, (SELECT count(DISTINCT v) FROM (VALUES (a), (b), (c), (f)) t(v) WHERE v < disc AND v > z) + 0 AS bin FROM cells CROSS JOIN e) SELECT bin, count(*) AS n, round({_r("qty", "price")}, 6) AS r FROM x GROUP BY 1 HAVING count(*) >= 30"""
)
def quintile_corr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.binned_corr(cells(spark, d), "disc", "qty", "price").withColumn("bin", F.col("bin").cast("long")), ["r"])


_RANKED = "a AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM v)"


@query(f"WITH v AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), {_RANKED} SELECT count(*) AS n, round({_r('rx', 'ry')}, 6) AS rho FROM a")
def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return rounded(stats.spearman(rows, [], "x", "y"), ["rho"])


_PAIRS = f"{CELLS}, pa AS (SELECT sample, avg(price) FILTER (condition = 'A') AS a, avg(price) FILTER (condition = 'N') AS b FROM cells GROUP BY 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("price")))
    return cells(spark, d).groupBy("sample").agg(mean("A").alias("a"), mean("N").alias("b"))


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(a - b), 4) AS mean_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*)::DOUBLE)), 6) AS t, count(*) - 1 AS df FROM pa WHERE a - b IS NOT NULL")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(stats.paired_t(_pairs(spark, d), [], "a", "b"), ["t"]), ["mean_diff"], 4)


@query(f"WITH {_PAIRS}, df AS (SELECT a - b AS d, abs(a - b) AS x FROM pa WHERE a - b <> 0), k AS (SELECT d, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM df) SELECT count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 4) AS w FROM k")
def wilcoxon_w(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.signed_rank(_pairs(spark, d), [], "a", "b"), ["w"], 4)


@query(f"WITH {CELLS} SELECT sample, tissue, round(avg(price), 4) AS mean_price, round(100 * count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY sample))::DOUBLE, 6) AS share FROM cells GROUP BY 1, 2")
def group_share(spark: SparkSession, d: str) -> DataFrame:
    """A group total next to its parts, without a second pass over the rows."""
    from pyspark.sql import Window

    per = cells(spark, d).groupBy("sample", "tissue").agg(F.round(F.avg("price"), 4).alias("mean_price"), F.count("*").alias("_n"))
    return per.withColumn("share", F.round(100 * ratio("_n", F.sum("_n").over(Window.partitionBy("sample"))), 6)).drop("_n")

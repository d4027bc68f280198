"""Queries on classifier evaluation, resampling, models and cell-level preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.expr import draw_key, ratio
from tallgrass.operators import cells as ce
from tallgrass.operators import evaluation as ev
from tallgrass.functions.store import stored
from tallgrass.operators import bootstrap, graph, labels, models
from tallgrass.operators import scores as sc
from tallgrass.plans.base import EVENTS, LABELLED, MATRIX, MODULES, cells, event_counts, labelled, matrix, modules, query, read, rounded
from tallgrass.streaming import frozen

_CONFUSION = """cf AS (SELECT {g}count(*) AS n, count(*) FILTER (y = 1 AND s >= 0.5) tp, count(*) FILTER (y = 0 AND s >= 0.5) fp, count(*) FILTER (y = 0 AND s < 0.5) tn, count(*) FILTER (y = 1 AND s < 0.5) fn FROM {t} {k})"""
_MCC = "coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE), 0), 0)"


@query(
    f"""WITH {LABELLED}, r AS (SELECT lang, y, s1 AS s FROM lab), {_CONFUSION.format(g='lang, ', t='r', k='GROUP BY lang')}
    SELECT lang, n, tp, fp, tn, fn, round((tp + tn)::DOUBLE / n::DOUBLE, 6) AS accuracy, round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
    round((coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn::DOUBLE / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1, round({_MCC}, 6) AS mcc FROM cf"""
)
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.confusion(labelled(spark, d), ["lang"], "y", "s1"), ["accuracy", "balanced_accuracy", "macro_f1", "mcc"])


_CURVE = "ti AS (SELECT lang, s1 AS s, count(*) FILTER (y = 1) pos, count(*) FILTER (y <> 1) neg FROM lab GROUP BY 1, 2), cu AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM ti WINDOW w AS (PARTITION BY lang ORDER BY s DESC))"


@query(f"WITH {LABELLED}, {_CURVE} SELECT lang, round((sum(neg * (cp - pos + pos / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE)::DOUBLE, 6) AS auroc FROM cu GROUP BY 1")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.auroc(labelled(spark, d), ["lang"], "y", "s1"), ["auroc"])


@query(f"WITH {LABELLED}, {_CURVE} SELECT lang, round((sum(pos * cp::DOUBLE / (cp + cn)::DOUBLE) / nullif(sum(pos), 0)::DOUBLE)::DOUBLE, 6) AS auprc FROM cu GROUP BY 1")
def auprc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.auprc(labelled(spark, d), ["lang"], "y", "s1"), ["auprc"])


@query(f"WITH {LABELLED} SELECT doc_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM lab")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return ev.stratified_folds(labelled(spark, d), "doc_id", "y", 5, 42).select("doc_id", "y", "fold")


@query(f"WITH {LABELLED} SELECT 'null_label' AS problem, count(*) FILTER (y IS NULL) AS n FROM lab UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT doc_id FROM lab GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'single_class', CASE WHEN count(DISTINCT y) < 2 THEN 1 ELSE 0 END FROM lab")
def label_checks(spark: SparkSession, d: str) -> DataFrame:
    return ev.label_problems(labelled(spark, d), "doc_id", "y")


def _booted(n: int, seed: int) -> str:
    """Rows of lab for each replicate with their weight w; replicate 0 is the table itself."""
    p = bootstrap.PRIME
    number = "('0x' || substr(md5('{0}'), 1, 8))::BIGINT"
    steps = " + ".join(f"CASE WHEN u >= {s} THEN 1 ELSE 0 END" for s in bootstrap.STEPS)
    a, c = number.format(f"{seed}:a:' || boot || '"), number.format(f"{seed}:c:' || boot || '")
    return f"""bt AS (SELECT boot, CASE WHEN boot = 0 THEN 0 ELSE 1 + {a} % {p - 1} END AS ka, CASE WHEN boot = 0 THEN 0 ELSE {c} % {p} END AS kc FROM range(0, {n + 1}) t(boot)),
  bo AS (SELECT boot, doc_id, y, s1, s2, CASE WHEN boot = 0 THEN 1 ELSE {steps} END AS w FROM (SELECT *, (ka * ({number.format(f"{seed}:' || doc_id || '")} % {p}) + kc) % {p} AS u FROM lab CROSS JOIN bt))"""


_DIFFERENCE = """round(o.d, 6) AS observed, count(*) AS n, round(avg(b.d), 6) AS mean, round(stddev_pop(b.d), 6) AS sd, round(quantile_cont(b.d, 0.025), 6) AS low, round(quantile_cont(b.d, 0.975), 6) AS high,
  round(count(*) FILTER (abs(b.d - o.d) >= abs(o.d))::DOUBLE / count(*)::DOUBLE, 6) AS p_two, round(count(*) FILTER (b.d <= 0)::DOUBLE / count(*)::DOUBLE, 6) AS p_one FROM de b JOIN de o ON o.boot = 0 AND b.boot > 0 GROUP BY o.d"""


def _auc(s: str) -> str:
    return f"(SELECT boot, sum(neg * (cp - pos + pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS v FROM (SELECT *, sum(pos) OVER (PARTITION BY boot ORDER BY {s} DESC) AS cp FROM (SELECT boot, {s}, coalesce(sum(w) FILTER (y = 1), 0) pos, coalesce(sum(w) FILTER (y <> 1), 0) neg FROM bo WHERE w > 0 GROUP BY 1, 2)) GROUP BY 1)"


_STATED = ["observed", "mean", "sd", "low", "high", "p_two", "p_one"]


@query(f"WITH {LABELLED}, {_booted(2000, 11)}, de AS (SELECT boot, (a.v - b.v)::DOUBLE AS d FROM {_auc('s1')} a JOIN {_auc('s2')} b USING (boot)) SELECT {_DIFFERENCE}")
def bootstrap_auroc_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two scores on the same resampled rows, 2,000 times. AUROC does not depend on the sizes of the classes."""
    rows = stored(labelled(spark, d), "labelled")
    both = bootstrap.auroc(rows, "y", "s1", "doc_id", 2000, 11, "a").join(bootstrap.auroc(rows, "y", "s2", "doc_id", 2000, 11, "b"), "boot")
    return rounded(bootstrap.difference(both, "a", "b"), _STATED)


def _cell(name: str, s: str, y: str, up: str) -> str:
    return f"coalesce(sum(w) FILTER (y {y} AND {s} {up} 0.5), 0)::DOUBLE AS {name}"


@query(
    f"""WITH {LABELLED}, {_booted(1000, 13)}, cf AS (SELECT boot, {", ".join(_cell(f"{k}{s}", s, y, up) for s in ("s1", "s2") for k, y, up in (("tp", "= 1", ">="), ("fp", "<> 1", ">="), ("tn", "<> 1", "<"), ("fn", "= 1", "<")))} FROM bo GROUP BY 1),
    de AS (SELECT boot, {" - ".join(f"coalesce((tp{s} * tn{s} - fp{s} * fn{s}) / nullif(sqrt((tp{s} + fp{s}) * (tp{s} + fn{s}) * (tn{s} + fp{s}) * (tn{s} + fn{s})), 0), 0)" for s in ("s1", "s2"))} AS d FROM cf) SELECT {_DIFFERENCE}"""
)
def bootstrap_mcc(spark: SparkSession, d: str) -> DataFrame:
    """The difference of two scores' Matthews correlations, 1,000 replicates, with both p-values."""
    values = stored(bootstrap.mcc(labelled(spark, d), "y", ["s1", "s2"], "doc_id", 1000, 13), "bootstrap-mcc")
    return rounded(bootstrap.difference(values, "mcc_s1", "mcc_s2"), _STATED)


@query(
    f"""WITH {LABELLED}, {_booted(1000, 17)}, tp AS (SELECT CAST(row_number() OVER (ORDER BY s1 DESC, doc_id) AS INTEGER) AS place, doc_id AS key, s1 AS score FROM lab QUALIFY place <= 20),
    me AS (SELECT boot, sum(w * s1)::DOUBLE / sum(w)::DOUBLE AS v FROM bo WHERE boot > 0 GROUP BY 1), po AS (SELECT place, key, score, boot, coalesce(sum(w) FILTER (s1 >= score), 0)::DOUBLE / sum(w)::DOUBLE AS v FROM bo CROSS JOIN tp WHERE boot > 0 GROUP BY 1, 2, 3, 4)
    SELECT place, key, score, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM po GROUP BY 1, 2, 3 UNION ALL SELECT 0, NULL, NULL, round(quantile_cont(v, 0.025), 6), round(quantile_cont(v, 0.975), 6) FROM me"""
)
def bootstrap_positions(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the mean score and of the positions of the 20 best, 1,000 replicates."""
    return rounded(bootstrap.top_positions(labelled(spark, d), "doc_id", "s1", 1000, 20, 17), ["low", "high"])


@query(
    """WITH tr AS (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s FROM lineitem WHERE l_returnflag = 'A') SELECT l_returnflag AS cohort, round(avg((l_quantity - m) / CASE WHEN s > 1e-8 THEN s ELSE 1 END), 6) AS mean, round(stddev_pop((l_quantity - m) / CASE WHEN s > 1e-8 THEN s ELSE 1 END), 6) AS sd FROM lineitem CROSS JOIN tr GROUP BY 1"""
)
def train_only_standardiser(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d)
    fitted = sc.fit_wide(rows.where("condition = 'A'"), ["qty"])
    z = sc.apply_wide(rows, fitted, ["qty"])
    return z.groupBy(F.col("condition").alias("cohort")).agg(F.round(F.avg("qty_z"), 6).alias("mean"), F.round(F.stddev_pop("qty_z"), 6).alias("sd"))


@query(f"WITH {EVENTS} SELECT cell, count(*) FILTER (value > 0) AS n_features, sum(value) AS total, round(100 * coalesce(sum(value) FILTER (feature LIKE 'err%'), 0) / sum(value), 6) AS pct_prefix FROM ev GROUP BY 1")
def cell_qc_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ce.qc_metrics(event_counts(spark, d), "err"), ["pct_prefix"])


_QC = f"{EVENTS}, qm AS (SELECT cell, count(*) FILTER (value > 0) nf, 100 * coalesce(sum(value) FILTER (feature LIKE 'err%'), 0) / sum(value) p FROM ev GROUP BY 1), kc AS (SELECT ev.* FROM ev SEMI JOIN (SELECT cell FROM qm WHERE nf BETWEEN 3 AND 5 AND p <= 22) USING (cell))"


@query(f"WITH {_QC}, kf AS (SELECT feature FROM kc WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT cell) >= 10) SELECT feature, count(*) AS n, sum(value) AS total FROM kc WHERE feature IN (SELECT feature FROM kf) GROUP BY 1")
def qc_filter(spark: SparkSession, d: str) -> DataFrame:
    counts = event_counts(spark, d)
    kept = ce.qc_filter(counts, ce.qc_metrics(counts, "err"), 3, 5, 22.0, 10)
    return kept.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH {_QC} SELECT a.g AS grp, n_before, coalesce(n_after, 0) AS n_after, round(coalesce(n_after, 0)::DOUBLE / n_before::DOUBLE, 6) AS share FROM (SELECT cell % 10 AS g, count(DISTINCT cell) n_before FROM ev GROUP BY 1) a LEFT JOIN (SELECT cell % 10 AS g, count(DISTINCT cell) n_after FROM kc GROUP BY 1) b USING (g)")
def qc_retained(spark: SparkSession, d: str) -> DataFrame:
    counts = event_counts(spark, d).withColumn("grp", F.col("cell") % 10)
    kept = ce.qc_filter(counts, ce.qc_metrics(counts, "err"), 3, 5, 22.0, 0)
    return rounded(ce.retained(counts, kept, "grp"), ["share"])


@query(f"WITH {EVENTS} SELECT cell, feature, round(ln(1 + 10000 * value / sum(value) OVER (PARTITION BY cell)), 6) AS value FROM ev")
def normalise_log1p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ce.log_normalise(event_counts(spark, d)), ["value"]).select("cell", "feature", "value")


@query(f"WITH {MATRIX}, n AS (SELECT count(DISTINCT sample)::DOUBLE AS c FROM m), mo AS (SELECT feature, sum(value) / c AS mean, sum(value * value) / c - (sum(value) / c) * (sum(value) / c) AS var FROM m CROSS JOIN n GROUP BY feature, c) SELECT feature, round(mean, 4) AS mean, round(var, 2) AS var FROM mo ORDER BY round(var, 2) DESC, feature LIMIT 10")
def hvg_variance(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the ten most variable features, absent entries as zeros."""
    moments = ce.sparse_moments(matrix(spark, d), cell="sample").select("feature", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))
    return ce.top_variance(moments, 10)


@query(
    f"""WITH {MATRIX}, n AS (SELECT count(DISTINCT sample)::DOUBLE AS c FROM m), mo AS (SELECT feature, round(sum(value) / c, 4) AS mean, round(sum(value * value) / c - (sum(value) / c) * (sum(value) / c), 2) AS var FROM m CROSS JOIN n GROUP BY feature, c),
    b AS (SELECT *, var / mean AS dispersion, ntile(5) OVER (ORDER BY mean, feature) AS bin FROM mo WHERE mean > 0) SELECT feature, bin, round(dispersion, 4) AS dispersion, round(coalesce((dispersion - avg(dispersion) OVER w) / nullif(stddev_samp(dispersion) OVER w, 0), 0), 4) AS z FROM b WINDOW w AS (PARTITION BY bin)"""
)
def hvg_binned_dispersion(spark: SparkSession, d: str) -> DataFrame:
    moments = ce.sparse_moments(matrix(spark, d), cell="sample").select("feature", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))
    return rounded(ce.binned_dispersion(moments, 5), ["dispersion", "z"], 4).select("feature", "bin", "dispersion", "z")


@query(f"WITH {EVENTS}, mk(module, feature) AS (VALUES ('buy', 'purchase'), ('buy', 'click'), ('look', 'view'), ('look', 'nothing')), th AS (SELECT DISTINCT mk.* FROM mk WHERE feature IN (SELECT feature FROM ev)), k AS (SELECT module, count(*) c FROM th GROUP BY 1), s AS (SELECT cell, module, sum(value) v FROM ev JOIN th USING (feature) GROUP BY 1, 2) SELECT cell, module, round(coalesce(v, 0) / c, 6) AS score FROM (SELECT DISTINCT cell FROM ev) CROSS JOIN k LEFT JOIN s USING (cell, module)")
def marker_scores(spark: SparkSession, d: str) -> DataFrame:
    counts = event_counts(spark, d)
    markers = spark.createDataFrame([("buy", "purchase"), ("buy", "click"), ("look", "view"), ("look", "nothing")], "module string, feature string")
    return rounded(ce.marker_scores(counts, markers, counts.select("cell").distinct()), ["score"])


@query(f"WITH {MATRIX}, {MODULES}, lib AS (SELECT sample, sum(value) l FROM m GROUP BY 1), k AS (SELECT module, count(DISTINCT feature) c FROM modules GROUP BY 1), s AS (SELECT sample, module, sum(value) v FROM m JOIN modules USING (feature) GROUP BY 1, 2) SELECT sample AS spot, module, round(ln(1 + 10000 * coalesce(v, 0) / l) / c, 6) AS score FROM lib CROSS JOIN k LEFT JOIN s USING (sample, module)")
def spot_module_scores(spark: SparkSession, d: str) -> DataFrame:
    counts = matrix(spark, d).withColumnRenamed("sample", "spot")
    return rounded(ce.spot_scores(counts, modules(spark), counts.select("spot").distinct()), ["score"])


@query("WITH c AS (SELECT DISTINCT user_id % 10 AS grp, user_id AS cell FROM events) SELECT grp, cell FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cell) AS k FROM c WHERE grp IN (SELECT DISTINCT grp FROM c ORDER BY grp LIMIT 2)) WHERE k <= 5")
def smoke_subset(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the first five cells of the first two groups."""
    rows = read(spark, d, "events").select((F.col("user_id") % 10).alias("grp"), F.col("user_id").alias("cell")).distinct()
    return ce.subset(rows, "grp", 2, 5)


@query(
    "WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS neighbour, round(list_dot_product(e, embedding::DOUBLE[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS similarity FROM q CROSS JOIN embeddings WHERE vec_id <> query) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM s) WHERE rank <= 5"
)
def nearest_cells(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    return ce.knn(vectors, vectors.where("vec_id % 100 = 0"), 5, "vec_id", "embedding")


def _vectors(spark: SparkSession, d: str, label: int = 0) -> tuple[DataFrame, list[str]]:
    table = read(spark, d, "embeddings")
    names = [f"x{i}" for i in range(table.agg(F.max(F.size("embedding")).alias("n")).first()["n"])]
    rows = table.select("vec_id", (F.col("label") == label).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return rows, names


@query()
def baselines_cv(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated tabular baselines with their metrics on every fold."""
    rows, names = _vectors(spark, d)
    scored = models.cross_validated(ev.stratified_folds(rows, "vec_id", "y", 3, 42), names, list(models.baselines(len(names))), 3, "vec_id")
    keys = ["method", "fold"]
    return ev.confusion(scored, keys, "y", "score").join(ev.auroc(scored, keys, "y", "score"), keys).join(ev.auprc(scored, keys, "y", "score"), keys)


@query()
def signature_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A logistic regression on a few module scores instead of all features."""
    rows, names = _vectors(spark, d)
    scored = rows.select("vec_id", "y", *[(sum((F.col(n) for n in names[k::4]), F.lit(0.0)) / len(names[k::4])).alias(f"m{k}") for k in range(4)])
    return ev.auroc(models.cross_validated(ev.stratified_folds(scored, "vec_id", "y", 3, 42), [f"m{k}" for k in range(4)], ["elastic_net"], 3, "vec_id"), ["method", "fold"], "y", "score")


@query()
def cross_cohort_transfer(spark: SparkSession, d: str) -> DataFrame:
    rows, names = _vectors(spark, d)
    first = draw_key(1, "vec_id") < "8"
    scored = models.transferred(rows.where(first), rows.where(~first), names, "random_forest", "vec_id")
    return ev.auroc(scored.withColumn("cohort", F.lit("other")), ["cohort"], "y", "score")


@query()
def latent_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Variance of a score that depth and principal components explain."""
    rows, names = _vectors(spark, d)
    joined = rows.join(models.latent(rows, names[4:], 3, "vec_id"), "vec_id").select("vec_id", "x0", "x1", *[F.col("latent")[i].alias(f"pc{i}") for i in range(3)])
    out = models.residualised(joined, "x0", ["x1", "pc0", "pc1", "pc2"])
    return out.agg(F.count("*").alias("n"), F.round(1 - ratio(F.var_pop("residual"), F.var_pop("x0")), 6).alias("r2"))


@query(
    f"""WITH {MATRIX}, st AS (SELECT feature, sample, value FROM m), mo AS (SELECT feature, round(avg(value), 6) AS mean FROM m GROUP BY 1), bi AS (SELECT *, ntile(5) OVER (ORDER BY mean, feature) AS bin FROM mo), own AS (SELECT * FROM bi WHERE feature IN ('Brand#1', 'Brand#2')),
    ctl AS (SELECT feature FROM (SELECT bi.feature, row_number() OVER (PARTITION BY bin ORDER BY md5('5:' || bi.feature), bi.feature) AS k FROM bi WHERE bin IN (SELECT bin FROM own) AND feature NOT IN (SELECT feature FROM own)) WHERE k <= 3)
    SELECT sample AS cell, round(avg(value) FILTER (feature IN (SELECT feature FROM own)) - avg(value) FILTER (feature IN (SELECT feature FROM ctl)), 4) AS score FROM m GROUP BY 1"""
)
def control_matched_score(spark: SparkSession, d: str) -> DataFrame:
    long = matrix(spark, d)
    means = long.groupBy("feature").agg(F.round(F.avg("value"), 6).alias("mean"))
    module = spark.createDataFrame([("Brand#1",), ("Brand#2",)], "feature string")
    return rounded(ce.matched_control_score(means, long.withColumnRenamed("sample", "cell"), module, 5, 3, 5), ["score"], 4)


@query()
def frozen_threshold_stream(spark: SparkSession, d: str) -> DataFrame:
    """The streaming form run as a batch: events are standardised and labelled with what the first half fixed."""
    rows = read(spark, d, "events").select("ts", F.col("value").alias("a"), (F.col("user_id") % 7).cast("double").alias("b"), (F.col("user_id") % 11).cast("double").alias("c"), (F.col("event_id") % 5).cast("double").alias("e"), "event_id")
    first = rows.where("event_id % 2 = 0")
    frozen_t = labels.fit_thresholds(first, ["a", "b", "c", "e"])
    return frozen.windowed_states(frozen.label_stream(rows, frozen_t, "a", "b", "c", "e"), "ts").groupBy("state").agg(F.sum("n").alias("n"))


@query("WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(e, e))), 6) AS mean_norm FROM v GROUP BY 1")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").withColumn("norm", F.sqrt(graph.dot("embedding", "embedding")))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("norm"), 6).alias("mean_norm"))

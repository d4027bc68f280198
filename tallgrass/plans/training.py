"""Queries on classifiers that are fitted together: fusion of graph views, search, importance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.expr import draw_key
from tallgrass.functions.store import shared_folder, stored
from tallgrass.operators import blocks, evaluation, fusion, graph, importance, spectral, stats
from tallgrass.operators import scores as sc
from tallgrass.plans.base import MATRIX, MODULES, Z, matrix, modules, query, read, rounded

_DIM = 8
_MASKED = 4  # features that define the label in the masked mode


def _cohorts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Vectors as samples of two cohorts, by a hash of their id; the label is one of the first three classes."""
    table = read(spark, d, "embeddings").select("vec_id", (F.col("label") < 3).cast("int").alias("y"), "embedding")
    rows = stored(fusion.prepared(table, "vec_id", "y", "embedding").withColumn("cohort", F.when(draw_key(1, "key") < "8", "a").otherwise("b")), "cohorts")
    width = rows.agg(F.max(F.size("x")).alias("n")).first()["n"]
    return rows.where("cohort = 'a'"), rows.where("cohort = 'b'"), [f"f{i:03d}" for i in range(width)]


def _edges(train: DataFrame) -> DataFrame:
    """(view, src, dst, weight): the features' positive, negative and strong correlations in the first cohort."""
    cells = train.select("key", F.posexplode("x").alias("at", "value")).select("key", F.format_string("f%03d", "at").alias("feature"), "value")
    r = stored(blocks.pairs(cells, 0.0, "key").select("src", "dst", "r"), "feature-graph")
    strong = r.select(F.max(F.abs("r")).alias("m")).first()["m"] or 0.0
    edges = {"negative": F.col("r") < 0, "positive": F.col("r") > 0, "strong": F.abs("r") > strong / 2}
    views = None
    for name, rule in edges.items():
        part = r.where(rule).select(F.lit(name).alias("view"), "src", "dst", F.abs("r").alias("weight"))
        views = part if views is None else views.union(part)
    return views


def _design(train: DataFrame, features: list[str]) -> fusion.Design:
    """The three kinds of edges as views; all edges together are one more. The masked mode lacks the first features."""
    views = stored(_edges(train), "feature-edges")
    merged = views.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).select(F.lit("merged").alias("view"), "src", "dst", "weight")
    embedded = fusion.views_of(spectral.embed(views.union(merged), _DIM).vectors, features)
    for name in ("negative", "positive", "strong", "merged"):
        embedded.setdefault(name, np.zeros((len(features), _DIM)))
    every = np.ones(len(features))
    return fusion.Design(dict(sorted(embedded.items())), {"full": every, "masked": np.r_[np.zeros(_MASKED), every[_MASKED:]]})


def _scored(spark: SparkSession, d: str, modes: list[str], seeds: list[int], steps: int) -> tuple[DataFrame, fusion.Fitted]:
    """(variant, mode, seed, auroc, auprc, ...) on the second cohort, of runs fitted on the first."""
    a, b, features = _cohorts(spark, d)
    runs = fusion.matrix_of_runs(["negative", "positive", "strong"], modes, seeds)
    fitted = fusion.fit(a, _design(a, features), runs, steps)
    predicted, keys = stored(fusion.predict(b, fitted), "fusion-predictions"), ["variant", "mode", "seed"]
    metrics = evaluation.confusion(predicted, keys, "y", "probability").select(*keys, "n", "mcc", "balanced_accuracy")
    both = evaluation.auroc(predicted, keys, "y", "probability").join(evaluation.auprc(predicted, keys, "y", "probability"), keys)
    return stored(metrics.join(both, keys), "fusion-metrics"), fitted


@query()
def multiview_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The whole matrix of variants in both feature modes, three seeds: means and deviations of the metrics on the other cohort."""
    table, _ = _scored(spark, d, ["full", "masked"], [1, 2, 3], 20)
    metrics = ["auroc", "auprc", "mcc", "balanced_accuracy"]
    each = [x.alias(f"{m}_{k}") for m in metrics for k, x in (("mean", F.avg(m)), ("sd", F.stddev_pop(m)))]
    return rounded(table.groupBy("mode", "variant").agg(F.count("*").alias("n_seeds"), *each), [f"{m}_{k}" for m in metrics for k in ("mean", "sd")], 4)


@query()
def multiview_paired_tests(spark: SparkSession, d: str) -> DataFrame:
    """Each variant against the one without a graph, on the same ten seeds: paired t, Wilcoxon's sum and means, masked features."""
    table, _ = _scored(spark, d, ["masked"], list(range(1, 11)), 12)
    pairs = stored(evaluation.metric_pairs(table, "variant", "no_graph", ["mode", "seed"], "auroc"), "fusion-pairs")
    both = stats.paired_t(pairs, ["variant"], "a", "b").join(stats.signed_rank(pairs, ["variant"], "a", "b").select("variant", "w"), "variant", "left")
    return rounded(both, ["mean_diff", "t", "w"], 4)


def _edge_sets(spark: SparkSession, d: str, edges: DataFrame, a: DataFrame, b: DataFrame, features: list[str], sets: dict[str, list[str]], seeds: list[int], steps: int) -> DataFrame:
    """(variant, seed, auroc, mcc) on the second cohort, of classifiers on the embedding of each set of edge types: all sets are embedded together, and all runs fitted together."""
    named = spark.createDataFrame([(n, t) for n, types in sets.items() for t in types], "variant string, view string")
    graphs = edges.join(F.broadcast(named), "view").groupBy(F.col("variant").alias("view"), "src", "dst").agg(F.sum("weight").alias("weight"))
    views = fusion.views_of(spectral.embed(graphs, _DIM).vectors, features)
    for name in sets:
        views.setdefault(name, np.zeros((len(features), _DIM)))
    design = fusion.Design(dict(sorted(views.items())), {"full": np.ones(len(features))})
    runs = [fusion.Run(n, "full", (n,), "uniform", k) for n in sets for k in seeds]
    predicted, keys = stored(fusion.predict(b, fusion.fit(a, design, runs, steps)), "edge-set-predictions"), ["variant", "seed"]
    return stored(evaluation.auroc(predicted, keys, "y", "probability").join(evaluation.confusion(predicted, keys, "y", "probability").select(*keys, "mcc"), keys), "edge-set-metrics")


@query()
def edge_type_importance(spark: SparkSession, d: str) -> DataFrame:
    """What the metrics lose without each type of edges: the graph is embedded and the classifier fitted anew for each."""
    a, b, features = _cohorts(spark, d)
    types = ["negative", "positive", "strong"]
    sets = {"full": types} | {f"without_{t}": [o for o in types if o != t] for t in types}
    table = _edge_sets(spark, d, stored(_edges(a), "feature-edges"), a, b, features, sets, [1, 2, 3], 15)
    mean = table.groupBy("variant").agg(F.avg("auroc").alias("auroc"), F.avg("mcc").alias("mcc"))
    full = mean.where("variant = 'full'").select(F.col("auroc").alias("f1"), F.col("mcc").alias("f2"))
    out = mean.where("variant <> 'full'").join(F.broadcast(full)).select("variant", "auroc", "mcc", (F.col("f1") - F.col("auroc")).alias("auroc_drop"), (F.col("f2") - F.col("mcc")).alias("mcc_drop"))
    return rounded(out, ["auroc", "mcc", "auroc_drop", "mcc_drop"], 4)


@query()
def prior_edge_variants(spark: SparkSession, d: str) -> DataFrame:
    """Two declared priors on top of the data's own edges, alone and together, each against none on the same ten seeds: means, paired t and Wilcoxon's sum."""
    a, b, features = _cohorts(spark, d)
    own = _edges(a).where("view = 'strong'")
    groups = spark.createDataFrame([(f, f"chain{i // 2}", f"ring{i % 8}") for i, f in enumerate(features)], "node string, chain string, ring string")
    priors = None
    for view, column in (("pathway", "chain"), ("set", "ring")):
        part = graph.inside_groups(groups.select(column, "node"), column, "node", view, 0.2).select(F.col("edge_type").alias("view"), "src", "dst", "weight")
        priors = part if priors is None else priors.union(part)
    sets = {"baseline": ["strong"], "pathway": ["strong", "pathway"], "set": ["strong", "set"], "both": ["strong", "pathway", "set"]}
    table = _edge_sets(spark, d, stored(own.union(priors), "prior-edges"), a, b, features, sets, list(range(1, 11)), 12)
    pairs = stored(evaluation.metric_pairs(table, "variant", "baseline", ["seed"], "auroc"), "prior-pairs")
    tests = stats.paired_t(pairs, ["variant"], "a", "b").join(stats.signed_rank(pairs, ["variant"], "a", "b").select("variant", "w"), "variant", "left")
    return rounded(tests.join(table.groupBy("variant").agg(F.avg("auroc").alias("auroc"), F.avg("mcc").alias("mcc")), "variant"), ["mean_diff", "t", "w", "auroc", "mcc"], 4)


@query()
def fusion_view_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weights that learned fusions give their views."""
    a, _, features = _cohorts(spark, d)
    runs = [r for r in fusion.matrix_of_runs(["negative", "positive", "strong"], ["full"], [1, 2, 3]) if r.fused == "learned"]
    return rounded(fusion.fusion_weights(spark, fusion.fit(a, _design(a, features), runs, 20)), ["weight"], 4)


@query()
def halving_search(spark: SparkSession, d: str) -> DataFrame:
    """27 settings of rate, penalty and views on five folds, by successive halving; the trial table of all rungs."""
    import uuid

    a, _, features = _cohorts(spark, d)
    views = {"none": ((), None), "uniform": (("negative", "positive", "strong"), "uniform"), "learned": (("negative", "positive", "strong"), "learned")}
    trials = {
        f"rate={rate},penalty={penalty},views={name}": {"mode": "full", "views": own, "fused": fused, "rate": rate, "penalty": penalty}
        for rate in (0.1, 0.3, 1.0) for penalty in (1e-4, 1e-2, 1.0) for name, (own, fused) in views.items()
    }
    path = f"{shared_folder(spark)}/tallgrass/search-{uuid.uuid4().hex}"
    return rounded(fusion.halving(a, _design(a, features), trials, 5, path), ["loss"])


_IMPORTANCE = f"""{MATRIX}, {MODULES}, {Z}, l0 AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal > 4000 THEN 1 ELSE 0 END AS y FROM supplier WHERE s_suppkey IN (SELECT sample FROM m)),
  lb AS (SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id), id) - 1) % 3 AS fold FROM l0), fo AS (SELECT DISTINCT fold FROM lb),
  w AS (SELECT fo.fold, feature, avg(z) FILTER (y = 1) - avg(z) FILTER (y = 0) AS weight FROM z JOIN lb ON lb.id = z.sample JOIN fo ON fo.fold <> lb.fold GROUP BY 1, 2),
  pt AS (SELECT id, lb.fold, z.feature, z.z * weight AS part FROM z JOIN lb ON lb.id = z.sample JOIN w ON w.fold = lb.fold AND w.feature = z.feature),
  sc AS (SELECT lb.id, lb.fold, y, coalesce(sum(part), 0) AS score FROM lb LEFT JOIN pt ON pt.id = lb.id GROUP BY 1, 2, 3),
  ow AS (SELECT sc.id, sc.fold, grp, coalesce(sum(part), 0) AS own FROM sc CROSS JOIN (SELECT DISTINCT module AS grp FROM modules) g LEFT JOIN (SELECT id, module, part FROM pt JOIN modules USING (feature)) q ON q.id = sc.id AND q.module = g.grp GROUP BY 1, 2, 3),
  pm AS (SELECT *, row_number() OVER (PARTITION BY fold, grp, perm ORDER BY id) AS a, row_number() OVER (PARTITION BY fold, grp, perm ORDER BY md5('42:' || grp || ':' || perm || ':' || id), id) AS b FROM ow CROSS JOIN range(1, 21) r(perm)),
  mv AS (SELECT x.fold, x.grp, x.perm, sc.y, sc.score - x.own + p.own AS score FROM pm x JOIN pm p ON p.fold = x.fold AND p.grp = x.grp AND p.perm = x.perm AND p.b = x.a JOIN sc ON sc.id = x.id),
  al AS (SELECT fold, grp, perm, y, score FROM mv UNION ALL SELECT fold, '', 0, y, score FROM sc),
  au AS (SELECT fold, grp, perm, sum(neg * (cp - pos + pos / 2.0::DOUBLE)) / nullif((sum(pos) * sum(neg))::DOUBLE, 0) AS auroc FROM (SELECT *, sum(pos) OVER (PARTITION BY fold, grp, perm ORDER BY score DESC) AS cp FROM (SELECT fold, grp, perm, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM al GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3),
  cf AS (SELECT fold, grp, perm, count(*) FILTER (y = 1 AND score >= 0) tp, count(*) FILTER (y = 0 AND score >= 0) fp, count(*) FILTER (y = 0 AND score < 0) tn, count(*) FILTER (y = 1 AND score < 0) fn FROM al GROUP BY 1, 2, 3),
  mc AS (SELECT fold, grp, perm, coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE), 0), 0) AS mcc FROM cf), rs AS (SELECT fold, grp, perm, auroc, mcc FROM au JOIN mc USING (fold, grp, perm))"""


@query(
    f"""WITH {_IMPORTANCE} SELECT r.fold, r.grp, count(*) AS n, round(avg(w.auroc - r.auroc), 6) AS auroc_drop, round(avg(w.mcc - r.mcc), 6) AS mcc_drop FROM rs r JOIN rs w ON w.fold = r.fold AND w.perm = 0 WHERE r.perm > 0 GROUP BY 1, 2"""
)
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """What modules are worth to a score by differences of class means, fitted without the fold: 20 permutations of each."""
    z = stored(sc.z_scores(matrix(spark, d), ["feature"]).select("sample", "feature", "z"), "importance-z")
    labels = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 4000).cast("int").alias("y"))
    rows = stored(evaluation.stratified_folds(labels.join(z.select(F.col("sample").alias("id")).distinct(), "id", "left_semi"), "id", "y", 3, 42), "importance-rows")
    others = rows.select(F.col("fold").alias("_fold")).distinct().withColumnRenamed("_fold", "out")
    cells = z.select(F.col("sample").alias("id"), "feature", F.col("z").alias("value"))
    mean = lambda k: F.avg(F.when(F.col("y") == k, F.col("value")))
    weights = cells.join(rows, "id").join(F.broadcast(others)).where("fold <> out").groupBy(F.col("out").alias("fold"), "feature").agg((mean(1) - mean(0)).alias("weight"))
    found = importance.permutation_importance(rows, cells, weights, modules(spark).select(F.col("module").alias("grp"), "feature"), 20)
    return rounded(found.groupBy("fold", "grp").agg(F.count("*").alias("n"), F.avg("auroc_drop").alias("auroc_drop"), F.avg("mcc_drop").alias("mcc_drop")), ["auroc_drop", "mcc_drop"])

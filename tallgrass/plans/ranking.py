"""Queries that rank candidates over several evidence tables, and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.expr import ratio
from tallgrass.operators import evidence, labels, matrix as mx, stats
from tallgrass.operators import evaluation as ev
from tallgrass.plans.base import CELLS, cells, query, read, rounded
from tallgrass.sources import formats, sinks, specs


def _rr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


# suppliers as candidates: specificity (price of returned less other lines), correlation stand-in (balance), membership (nation), gold (region)
_BASE = f"""{CELLS}, sp AS (SELECT sample AS s_suppkey, avg(price) FILTER (condition = 'R') - avg(price) FILTER (condition <> 'R') AS spec, avg(disc) AS level FROM cells GROUP BY 1),
evd AS (SELECT s_suppkey, s_name, coalesce(spec, 0) AS spec, abs(coalesce(spec, 0)) AS aspec, abs(s_acctbal) AS bal, s_nationkey < 8 AS in_axis, s_nationkey < 3 AS core, n_regionkey = 2 AS gold
  FROM supplier LEFT JOIN sp USING (s_suppkey) LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    price = lambda rule: F.avg(F.when(rule, F.col("price")))
    spec = cells(spark, d).groupBy(F.col("sample").alias("s_suppkey")).agg((price(F.col("condition") == "R") - price(F.col("condition") != "R")).alias("spec"))
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    rows = evidence.star_join(read(spark, d, "supplier"), [spec], "s_suppkey").join(nation, "s_nationkey", "left").fillna({"spec": 0.0})
    return rows.select("s_suppkey", "s_name", "spec", F.abs("spec").alias("aspec"), F.abs("s_acctbal").alias("bal"), (F.col("s_nationkey") < 8).alias("in_axis"), (F.col("s_nationkey") < 3).alias("core"), (F.col("n_regionkey") == 2).alias("gold"))


_RANKED = f"{_BASE}, mn AS (SELECT min(aspec) a0, max(aspec) a1, min(bal) b0, max(bal) b1 FROM evd), co AS (SELECT evd.*, round(0.3::DOUBLE * (aspec - a0) / nullif(a1 - a0, 0) + 0.2::DOUBLE * (bal - b0) / nullif(b1 - b0, 0) + 0.3::DOUBLE * in_axis::INT + 0.1::DOUBLE * core::INT + 0.1::DOUBLE * gold::INT, 6) AS score FROM evd CROSS JOIN mn), rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, s_name) AS rank FROM co)"


def _composite(spark: SparkSession, d: str) -> DataFrame:
    scaled = mx.min_max(_evidence(spark, d), ["aspec", "bal"])
    scored = scaled.withColumn("score", F.round(evidence.weighted({"aspec_scaled": 0.3, "bal_scaled": 0.2}) + 0.3 * F.col("in_axis").cast("int") + 0.1 * F.col("core").cast("int") + 0.1 * F.col("gold").cast("int"), 6))
    return evidence.ranked(scored, [F.desc("score"), F.asc("s_name")])


@query(f"WITH {_BASE} SELECT s_suppkey, s_name, round(spec, 4) AS spec, round(bal, 4) AS bal, in_axis, core, coalesce(gold, FALSE) AS gold FROM evd")
def evidence_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_evidence(spark, d), ["spec", "bal"], 4).fillna({"gold": False}).select("s_suppkey", "s_name", "spec", "bal", "in_axis", "core", "gold")


@query(f"WITH {_RANKED} SELECT s_name, score, rank FROM rk")
def minmax_composite_rank(spark: SparkSession, d: str) -> DataFrame:
    return _composite(spark, d).select("s_name", "score", "rank")


@query(f"WITH {_RANKED} SELECT s_name, score, rank FROM rk WHERE rank <= 20")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return _composite(spark, d).where("rank <= 20").select("s_name", "score", "rank")


@query(
    f"""WITH {_BASE}, pos AS (SELECT * FROM evd WHERE spec > 0), mn AS (SELECT min(spec) a0, max(spec) a1, min(bal) b0, max(bal) b1 FROM pos),
    sc AS (SELECT s_name, 'target' AS list, round(0.4::DOUBLE * (spec - a0) / nullif(a1 - a0, 0) + 0.25::DOUBLE * (bal - b0) / nullif(b1 - b0, 0) + 0.2::DOUBLE * in_axis::INT + 0.15::DOUBLE * core::INT, 6) AS score FROM pos CROSS JOIN mn
     UNION ALL SELECT s_name, 'readout', round(-spec, 6) FROM evd WHERE spec <= 0) SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, s_name) AS rank FROM sc"""
)
def split_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d)
    scaled = mx.min_max(rows.where("spec > 0"), ["spec", "bal"])
    target = scaled.select("s_name", F.lit("target").alias("list"), F.round(evidence.weighted({"spec_scaled": 0.4, "bal_scaled": 0.25}) + 0.2 * F.col("in_axis").cast("int") + 0.15 * F.col("core").cast("int"), 6).alias("score"))
    readout = rows.where("spec <= 0").select("s_name", F.lit("readout").alias("list"), F.round(-F.col("spec"), 6).alias("score"))
    return evidence.ranked(target.union(readout), [F.desc("score"), F.asc("s_name")], groups=["list"])


_EXTERNAL = "ext AS (SELECT s_name, CASE WHEN s_acctbal > 5000 THEN 'strong' WHEN s_acctbal > 0 THEN 'weak' END AS support FROM supplier)"


@query(
    f"""WITH {_RANKED}, {_EXTERNAL}, j AS (SELECT s_name, score, CASE WHEN support = 'strong' THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN support IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN core THEN 0.2::DOUBLE ELSE 0 END AS validation,
    concat_ws('; ', CASE WHEN support = 'strong' THEN 'strong' END, CASE WHEN support IS NOT NULL THEN 'any' END, CASE WHEN core THEN 'core' END) AS notes FROM rk LEFT JOIN ext USING (s_name))
    SELECT s_name, round(validation, 6) AS validation, notes, round(0.6::DOUBLE * score + 0.4::DOUBLE * validation, 6) AS combined, round(0.6::DOUBLE * score + 0.4::DOUBLE * validation, 6) >= 0.3 AS confident FROM j"""
)
def evidence_external(spark: SparkSession, d: str) -> DataFrame:
    support = F.when(F.col("s_acctbal") > 5000, "strong").when(F.col("s_acctbal") > 0, "weak")
    external = read(spark, d, "supplier").select("s_name", support.alias("support"))
    rows = evidence.star_join(_composite(spark, d), [external], "s_name")
    score, notes = labels.evidence_sum({"strong": (F.col("support") == "strong", 0.6), "any": (F.col("support").isNotNull(), 0.2), "core": (F.col("core"), 0.2)})
    rows = rows.withColumns({"validation": F.round(score, 6), "notes": notes}).withColumn("combined", F.round(0.6 * F.col("score") + 0.4 * F.col("validation"), 6))
    return rows.select("s_name", "validation", "notes", "combined", (F.col("combined") >= 0.3).alias("confident"))


_TWO = f"{_RANKED}, ba AS (SELECT s_name, row_number() OVER (ORDER BY bal DESC, s_name) AS rank FROM evd), ch AS (SELECT s_name, a.rank AS rank_a, b.rank AS rank_b, a.rank - b.rank AS delta FROM rk a FULL JOIN ba b USING (s_name))"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    simple = evidence.ranked(_evidence(spark, d), [F.desc("bal"), F.asc("s_name")])
    return evidence.rank_change(_composite(spark, d), simple, "s_name")


@query(f"WITH {_TWO} SELECT s_name, rank_a, rank_b, delta, CASE WHEN delta IS NULL THEN 'one_list' WHEN delta < -10 THEN 'gained' WHEN delta < 11 THEN 'similar' ELSE 'lost' END AS category FROM ch")
def rank_compare(spark: SparkSession, d: str) -> DataFrame:
    category = labels.buckets(F.col("delta"), [(-10, "gained"), (11, "similar")], "lost", "one_list")
    return _changes(spark, d).select("s_name", "rank_a", "rank_b", "delta", category.alias("category"))


@query(f"WITH {_TWO} SELECT top, count(*) FILTER (rank_a <= top AND rank_b <= top) AS shared, round(count(*) FILTER (rank_a <= top AND rank_b <= top)::DOUBLE / nullif(count(*) FILTER (rank_a <= top OR rank_b <= top), 0)::DOUBLE, 6) AS jaccard FROM ch CROSS JOIN (VALUES (5), (10), (20), (37), (50)) t(top) GROUP BY 1")
def topn_overlap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evidence.top_overlap(_changes(spark, d), [5, 10, 20, 37, 50]), ["jaccard"])


@query("SELECT coalesce(a.s_nationkey, b.c_nationkey) AS nation, n_s, n_c, sign(sb) = sign(cb) AS same FROM (SELECT s_nationkey, count(*) n_s, round(sum(s_acctbal), 2) sb FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey, count(*) n_c, round(sum(c_acctbal), 2) cb FROM customer GROUP BY 1) b ON a.s_nationkey = b.c_nationkey")
def outer_merge_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_s"), F.round(F.sum("s_acctbal"), 2).alias("sb"))
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_c"), F.round(F.sum("c_acctbal"), 2).alias("cb"))
    return evidence.outer_merge(s, c, "nation").select("nation", "n_s", "n_c", (F.signum("sb") == F.signum("cb")).alias("same"))


@query(f"WITH {CELLS}, g AS (SELECT sample, avg(price) FILTER (condition = 'A') - avg(price) FILTER (condition = 'N') a, avg(price) FILTER (condition = 'R') - avg(price) FILTER (condition = 'N') b FROM cells GROUP BY 1) SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, count(*) FILTER (sign(a) = sign(b)) AS same, round(count(*) FILTER (sign(a) = sign(b))::DOUBLE / count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)::DOUBLE, 6) AS share FROM g")
def sign_concordance(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("price")))
    g = cells(spark, d).groupBy("sample").agg((mean("A") - mean("N")).alias("a"), (mean("R") - mean("N")).alias("b"))
    return rounded(evidence.sign_concordance(g, "a", "b"), ["share"])


_DELTAS = """dl AS (SELECT l_returnflag AS comparator, metric, avg(v) FILTER (l_linestatus = 'O') - avg(v) FILTER (l_linestatus = 'F') AS observed_delta,
  sqrt(var_samp(v) FILTER (l_linestatus = 'O') / count(v) FILTER (l_linestatus = 'O')::DOUBLE + var_samp(v) FILTER (l_linestatus = 'F') / count(v) FILTER (l_linestatus = 'F')::DOUBLE) AS se
  FROM (SELECT l_returnflag, l_linestatus, unnest(['price', 'discount', 'tax']) AS metric, unnest([l_extendedprice, l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1, 2)"""


@query(f"WITH {_DELTAS} SELECT count(*) AS n_required, count(*) FILTER (observed_delta > 0 AND observed_delta - 1.96 * se > 0) AS n_passed, CASE WHEN bool_and(coalesce(observed_delta > 0 AND observed_delta - 1.96 * se > 0, false)) THEN 'stable_gain' ELSE 'no_stable_gain' END AS verdict FROM dl")
def gain_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Open against finished lines, for each flag and metric: every pair that occurs is required to gain."""
    metrics = {"price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias("v")) for k, c in metrics.items()])).alias("m")
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("comparator"), "l_linestatus", each).select("comparator", "l_linestatus", "m.metric", "m.v")
    arms = stats.two_arms(rows, ["comparator", "metric"], "v", F.col("l_linestatus") == "O")
    delta, se = F.col("ma") - F.col("mb"), F.sqrt(ratio("va", "na") + ratio("vb", "nb"))
    found = arms.select("comparator", "metric", delta.alias("observed_delta"), (delta - 1.96 * se).alias("ci_low"))
    return evidence.gain_verdict(found, rows.select("comparator", "metric").distinct())


@query("WITH x AS (SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c FROM lineitem), k AS (SELECT a, b, c, count(*) n FROM x GROUP BY 1, 2, 3) SELECT p.a, q.b, r.c, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM x) p CROSS JOIN (SELECT DISTINCT b FROM x) q CROSS JOIN (SELECT DISTINCT c FROM x) r LEFT JOIN k ON k.a = p.a AND k.b = q.b AND k.c = r.c WHERE coalesce(n, 0) <> 1")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_linenumber").alias("c"))
    return evidence.factorial_gaps(rows, ["a", "b", "c"])


@query("WITH w AS (SELECT l_linenumber AS run, l_returnflag AS view, round(avg(l_discount), 9) AS weight FROM lineitem GROUP BY 1, 2), b AS (SELECT run, first(view ORDER BY weight DESC, view) AS view FROM w GROUP BY 1) SELECT v.view, count(b.run) AS wins, count(b.run) >= 3 AS stable FROM (SELECT DISTINCT view FROM w) v LEFT JOIN b USING (view) GROUP BY 1")
def view_stability(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("view")).agg(F.round(F.avg("l_discount"), 9).alias("weight"))
    return evidence.favourite(w, "run", "view", "weight", 3)


@query("SELECT l_suppkey AS sample, l_returnflag AS arm, round(avg(l_discount), 6) AS probability, count(*) AS n_seeds FROM lineitem GROUP BY 1, 2")
def ensemble_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("arm"), F.col("l_discount").alias("probability"))
    return rounded(ev.ensemble(rows, ["sample", "arm"]), ["probability"])


@query("SELECT l_returnflag AS grp, count(l_tax) AS n, round(avg(l_tax), 6) AS mean, round(stddev_pop(l_tax), 6) AS sd FROM lineitem GROUP BY 1")
def mean_population_sd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.mean_sd(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "grp"), ["grp"], "l_tax"), ["mean", "sd"])


@query("SELECT s_nationkey AS grp, round(avg(CASE WHEN s_acctbal < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS below, round(avg(s_acctbal), 4) AS mean, round(median(s_acctbal), 4) AS median, count(s_acctbal) AS n, CASE WHEN avg(s_acctbal) < 2000 THEN 'low' WHEN avg(s_acctbal) < 5000 THEN 'middle' ELSE 'high' END AS verdict FROM supplier GROUP BY 1")
def dependency_summary(spark: SparkSession, d: str) -> DataFrame:
    below = F.avg((F.col("s_acctbal") < 0).cast("int").cast("double"))
    per = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("grp")).agg(F.round(below, 6).alias("below"), F.avg("s_acctbal").alias("mean"), F.round(F.median("s_acctbal"), 4).alias("median"), F.count("s_acctbal").alias("n"))
    verdict = labels.buckets("mean", [(2000, "low"), (5000, "middle")], "high")
    return per.withColumn("verdict", verdict).withColumn("mean", F.round("mean", 4))


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'small%' THEN 'assay_small' WHEN p_name LIKE 'red%' THEN 'assay_red' ELSE 'assay_other' END AS assay, p_name LIKE '%ring%' OR p_name LIKE '%bolt%' AS leaked FROM part")
def assay_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    from tallgrass.functions.expr import has_any

    return read(spark, d, "part").select("p_partkey", labels.by_prefix("p_name", [("small", "assay_small"), ("red", "assay_red")], "assay_other").alias("assay"), has_any("p_name", ["ring", "bolt"]).alias("leaked"))


@query("SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE lower(p_name) LIKE '%ring%' AND p_brand LIKE 'Brand#1%' ORDER BY p_retailprice DESC")
def target_search(spark: SparkSession, d: str) -> DataFrame:
    found = sinks.search(read(spark, d, "part"), "p_name", "RING", "p_brand", "Brand#1", "p_retailprice", True)
    return found.select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query("SELECT CAST(greatest(0, least(11, floor((value - 0) / 50) + 1)) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return sinks.histogram(read(spark, d, "events"), "value", 0.0, 500.0, 10)


@query("SELECT p_brand AS card, count(DISTINCT p_type) AS n_modules, count(DISTINCT p_partkey) AS n_features, string_agg(DISTINCT split_part(p_name, ' ', 1), ';' ORDER BY split_part(p_name, ' ', 1)) AS roles FROM part GROUP BY 1")
def card_summary(spark: SparkSession, d: str) -> DataFrame:
    """A registry of cards from a table: brands as cards, types as modules, the first word of a name as the role of its parts."""
    rows = read(spark, d, "part").select(F.col("p_brand").alias("card"), F.col("p_type").alias("module"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("role"), F.lit(None).cast("string").alias("direction"), F.col("p_partkey").cast("string").alias("feature"))
    return specs.card_summary(specs.registry(rows))


@query(
    f"""WITH {CELLS}, h(hypothesis, expected, control) AS (VALUES ('qty~price', 1, NULL), ('disc~tax', 1, NULL), ('disc~qty', -1, NULL), ('qty~price', 1, 'disc')),
    p AS (SELECT condition, count(*) AS n, {_rr("qty", "price")} AS qp, {_rr("disc", "tax")} AS dt, {_rr("disc", "qty")} AS dq, {_rr("price", "disc")} AS pd FROM cells GROUP BY 1),
    x AS (SELECT condition AS cohort, hypothesis, coalesce(control, '') AS control, expected, n, CASE WHEN control IS NOT NULL THEN (qp - dq * pd) / sqrt((1 - dq * dq) * (1 - pd * pd)) WHEN hypothesis = 'qty~price' THEN qp WHEN hypothesis = 'disc~tax' THEN dt ELSE dq END AS r FROM p CROSS JOIN h),
    t AS (SELECT *, r * sqrt((n - 2 - CASE WHEN control <> '' THEN 1 ELSE 0 END)::DOUBLE / (1 - r * r)) AS t FROM x)
    SELECT cohort, hypothesis, control, CAST(expected AS INTEGER) AS expected, n, round(r, 6) AS r, round(t, 4) AS t, sign(r) = expected AND abs(t) >= 1.96 AS passed FROM t"""
)
def hypothesis_battery(spark: SparkSession, d: str) -> DataFrame:
    """Declared hypotheses with their signs in each cohort, the first once more without its control."""
    rows = cells(spark, d)
    plan = [("qty", "price", 1, None), ("disc", "tax", 1, None), ("disc", "qty", -1, None), ("qty", "price", 1, "disc")]
    out = None
    for a, b, sign, control in plan:
        found = stats.corr_test(rows, ["condition"], a, b) if control is None else stats.partial_corr_test(rows, ["condition"], a, b, control).drop("r").withColumnRenamed("rp", "r")
        part = found.select(F.col("condition").alias("cohort"), F.lit(f"{a}~{b}").alias("hypothesis"), F.lit(control or "").alias("control"), F.lit(sign).alias("expected"), "n", "r", "t")
        out = part if out is None else out.union(part)
    return rounded(out.withColumn("passed", labels.direction_ok("expected", "r") & (F.abs("t") >= 1.96)), ["r"]).withColumn("t", F.round("t", 4))


@query(
    f"""WITH {CELLS}, tests(test, expected) AS (VALUES ('price~qty', 1), ('tax~disc', 1), ('tax~levy', 1)), p AS (SELECT tissue, count(*) AS n, {_rr("price", "qty")} AS pq, {_rr("tax", "disc")} AS td FROM cells GROUP BY 1),
    x AS (SELECT tissue AS dataset, test, CASE test WHEN 'tax~levy' THEN 0 ELSE n END AS n, CASE test WHEN 'price~qty' THEN pq WHEN 'tax~disc' THEN td END AS r, CAST(expected AS INTEGER) AS expected FROM p CROSS JOIN tests)
    SELECT dataset, test, n, round(r, 6) AS r, expected, CASE WHEN r IS NULL THEN 'unresolved' WHEN r > 0 AND abs(r * sqrt((n - 2)::DOUBLE / (1 - r * r))) >= 1.96 THEN 'recovered' WHEN r > 0 THEN 'weak' ELSE 'wrong_sign' END AS outcome FROM x"""
)
def external_replication(spark: SparkSession, d: str) -> DataFrame:
    """The same tests on data sets of other origin; one asks for a module that no data set has."""
    return _replicated(spark, d)


def _replicated(spark: SparkSession, d: str) -> DataFrame:
    rows, out = cells(spark, d).withColumn("levy", F.lit(None).cast("double")), None
    for a, b in (("price", "qty"), ("tax", "disc"), ("tax", "levy")):
        per = stats.corr_test(rows.where(F.col(a).isNotNull()), ["tissue"], a, b).withColumn("n", F.when(F.lit(b == "levy"), F.lit(0)).otherwise(F.col("n")).cast("long"))
        part = per.select(F.col("tissue").alias("dataset"), F.lit(f"{a}~{b}").alias("test"), "n", "r", F.lit(1).alias("expected"), stats.replication_outcome("r", "t", F.lit(1)).alias("outcome"))
        out = part if out is None else out.union(part)
    return rounded(out, ["r"])


@query(
    f"""WITH {CELLS}, mn AS (SELECT sample, avg(price) AS price, avg(qty) AS qty FROM cells GROUP BY 1), ex AS (SELECT tissue AS dataset, count(*) AS n, {_rr("price", "qty")} AS r FROM cells GROUP BY 1)
    SELECT 'bulk' AS resolution, NULL AS dataset, 'price~qty' AS test, count(*) AS n, round({_rr("price", "qty")}, 6) AS r, 'reported' AS outcome FROM mn UNION ALL SELECT 'cell', NULL, 'price~qty', count(*), round({_rr("price", "qty")}, 6), 'reported' FROM cells WHERE condition = 'N'
    UNION ALL SELECT NULL, dataset, 'price~qty', n, round(r, 6), CASE WHEN r > 0 AND abs(r * sqrt((n - 2)::DOUBLE / (1 - r * r))) >= 1.96 THEN 'recovered' WHEN r > 0 THEN 'weak' ELSE 'wrong_sign' END FROM ex"""
)
def outcome_rows(spark: SparkSession, d: str) -> DataFrame:
    """A hypothesis on means of samples and on single cells, appended to the outcomes of its replication."""
    rows = cells(spark, d)
    means = rows.groupBy("sample").agg(F.avg("price").alias("price"), F.avg("qty").alias("qty"))
    new = None
    for resolution, part in (("bulk", means), ("cell", rows.where("condition = 'N'"))):
        row = stats.corr_test(part.withColumn("_all", F.lit(1)), ["_all"], "price", "qty").select(F.lit(resolution).alias("resolution"), F.lit("price~qty").alias("test"), "n", "r", F.lit("reported").alias("outcome"))
        new = row if new is None else new.union(row)
    there = _replicated(spark, d).where("test = 'price~qty'").drop("expected")
    return rounded(new.unionByName(there, allowMissingColumns=True), ["r"]).select("resolution", "dataset", "test", "n", "r", "outcome")


@query(
    f"""WITH {CELLS}, p AS (SELECT tissue, sample, avg(price) FILTER (condition = 'A') AS x, avg(disc) FILTER (condition = 'N') AS y FROM cells GROUP BY 1, 2)
    SELECT tissue, count(*) AS n, CASE WHEN count(*) >= 3 THEN round({_rr("x", "y")}, 6) END AS r FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1"""
)
def population_crosstalk(spark: SparkSession, d: str) -> DataFrame:
    """Sample means of two populations, one measure of each, over the samples that have both."""
    return rounded(stats.population_corr(cells(spark, d), "sample", F.col("condition") == "A", "price", F.col("condition") == "N", "disc", ["tissue"]), ["r"])


_PROBED = "pb AS (SELECT l_suppkey AS sample, l_partkey AS probe, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2), mp AS (SELECT p_partkey AS probe, p_brand AS symbol FROM part WHERE p_size <= 45)"


def _probed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    long = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("probe")).agg(F.sum("l_extendedprice").alias("value"))
    symbol = F.when(F.col("p_size") > 45, "---").otherwise(F.concat_ws(" /// ", "p_brand", "p_type"))
    mapping = formats.clean_mapping(read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("probe"), symbol.alias("symbol")))
    return long, mapping.withColumn("probe", F.col("probe").cast("long"))


@query(f"WITH {_PROBED} SELECT sample, symbol, count(*) AS n, round(avg(value) * count(*), 3) AS total FROM pb JOIN mp USING (probe) GROUP BY 1, 2")
def probes_to_symbols(spark: SparkSession, d: str) -> DataFrame:
    """A matrix of probes named by a platform's annotation, several probes of a symbol averaged; probes without a symbol go."""
    return mx.to_symbols(*_probed(spark, d)).select("sample", "symbol", "n", F.round(F.col("value") * F.col("n"), 3).alias("total"))


@query(
    f"""WITH {_PROBED}, bs AS (SELECT symbol, probe FROM (SELECT symbol, probe, row_number() OVER (PARTITION BY symbol ORDER BY avg(value) DESC, probe) AS k FROM pb JOIN mp USING (probe) GROUP BY 1, 2) WHERE k = 1)
    SELECT sample, symbol, round(value, 4) AS value FROM pb JOIN bs USING (probe)"""
)
def probes_to_symbols_highest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mx.to_symbols(*_probed(spark, d), how="highest_mean").drop("n"), ["value"], 4)


@query(r"SELECT regexp_extract(url, '^https?://(?:www\.|m\.|blog\.)?([^/:?#]+)', 1) AS domain, count(*) AS n, printf('%d characters in %04d pages', CAST(sum(length(html)) AS BIGINT), count(*)) AS said FROM pages GROUP BY 1")
def domains(spark: SparkSession, d: str) -> DataFrame:
    """A field cut out of a text by a pattern, and numbers set into a text."""
    rows = read(spark, d, "pages").select(F.regexp_extract("url", r"^https?://(?:www\.|m\.|blog\.)?([^/:?#]+)", 1).alias("domain"), F.char_length("html").alias("n"))
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.format_string("%d characters in %04d pages", F.sum("n"), F.count("*")).alias("said"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(avg(value), 6) AS mean, to_json({'lowest': round(min(value), 2), 'highest': round(max(value), 2)}) AS span FROM events GROUP BY 1")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties read from JSON into a map, and a summary written as JSON."""
    k = F.from_json("props", "map<string, bigint>")["k"]
    span = F.to_json(F.struct(F.round(F.min("value"), 2).alias("lowest"), F.round(F.max("value"), 2).alias("highest")))
    return read(spark, d, "events").groupBy((k % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), span.alias("span"))


@query("SELECT o_orderstatus, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS speed, count(*) AS n FROM orders GROUP BY 1, 2")
def categorical_recode(spark: SparkSession, d: str) -> DataFrame:
    recode = spark.createDataFrame([("1-URGENT", "fast"), ("2-HIGH", "fast")], "o_orderpriority string, speed string")
    rows = read(spark, d, "orders").join(F.broadcast(recode), "o_orderpriority", "left").fillna({"speed": "slow"})
    return rows.groupBy("o_orderstatus", "speed").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    s = read(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s)


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return c.intersect(read(spark, d, "supplier").select("s_nationkey")).subtract(read(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def concat_outer(spark: SparkSession, d: str) -> DataFrame:
    return mx.concat(_parties(spark, d), "outer")


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat_inner(spark: SparkSession, d: str) -> DataFrame:
    return mx.concat(_parties(spark, d), "inner")


def _parties(spark: SparkSession, d: str) -> list[DataFrame]:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return [c, read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))]


@query(
    "WITH m AS (SELECT CASE WHEN s_acctbal < 0 THEN 'NaN'::DOUBLE ELSE s_acctbal END AS balance, CASE WHEN s_acctbal > 5000 THEN s_acctbal END AS large FROM supplier) "
    "SELECT 'balance' AS metric, count(*) FILTER (balance IS NULL) AS n_null, count(*) FILTER (isnan(balance) OR isinf(balance)) AS n_not_finite FROM m UNION ALL SELECT 'large', count(*) FILTER (large IS NULL), count(*) FILTER (isnan(large) OR isinf(large)) FROM m"
)
def finite_metrics(spark: SparkSession, d: str) -> DataFrame:
    balance = F.col("s_acctbal")
    rows = read(spark, d, "supplier").select(F.when(balance < 0, float("nan")).otherwise(balance).alias("balance"), F.when(balance > 5000, balance).alias("large"))
    return mx.not_finite(rows, ["balance", "large"])

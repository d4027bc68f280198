"""Queries on graphs, spatial grids and null distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.expr import first_field
from tallgrass.functions.store import stored
from tallgrass.operators import graph, nulls, spectral, stats, walks
from tallgrass.operators import scores as sc
from tallgrass.plans.base import EDGES, MATRIX, MODULES, SPOTS, Z, edges, matrix, modules, query, read, rounded, spots

_NODES = "nodes AS (SELECT DISTINCT 's' || s_suppkey AS node_id, 'supplier' AS node_type FROM supplier UNION SELECT DISTINCT 'p' || (p_partkey % 200), 'part' FROM part)"
_CANON = "can AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, edge_type, weight FROM edges WHERE src <> dst)"
_VIEWS = "assign(edge_type, view) AS (VALUES ('A', 'open'), ('N', 'open'), ('R', 'closed')), v AS (SELECT view, src, dst, max(weight) AS weight FROM can JOIN assign USING (edge_type) GROUP BY 1, 2, 3)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("supplier").alias("node_type"))
    p = read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey") % 200).alias("node_id"), F.lit("part").alias("node_type"))
    return s.union(p).distinct()


def _assignment(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", "open"), ("N", "open"), ("R", "closed")], "edge_type string, view string")


@query(f"WITH {EDGES}, {_NODES} SELECT edge_type, count(*) AS n, round(sum(weight), 4) AS total FROM edges WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes) GROUP BY 1")
def edge_endpoint_semijoin(spark: SparkSession, d: str) -> DataFrame:
    kept = graph.within(edges(spark, d), _nodes(spark, d))
    return kept.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"))


@query(f"WITH {EDGES}, {_CANON}, {_VIEWS} SELECT view, count(*) AS n, round(sum(weight), 4) AS total, max(weight) AS top FROM v GROUP BY 1")
def graph_views(spark: SparkSession, d: str) -> DataFrame:
    return graph.views(edges(spark, d), _assignment(spark)).groupBy("view").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"), F.max("weight").alias("top"))


@query(f"WITH {EDGES}, assign(edge_type, view) AS (VALUES ('A', 'open'), ('A', 'half'), ('Z', 'void')) SELECT 'unassigned_type' AS problem, edge_type AS name FROM (SELECT DISTINCT edge_type FROM edges) WHERE edge_type NOT IN (SELECT edge_type FROM assign) UNION ALL SELECT 'type_in_several_views', 'A' UNION ALL SELECT 'empty_view', 'void'")
def graph_view_checks(spark: SparkSession, d: str) -> DataFrame:
    bad = spark.createDataFrame([("A", "open"), ("A", "half"), ("Z", "void")], "edge_type string, view string")
    return graph.view_problems(edges(spark, d), bad)


@query(f"WITH {EDGES}, {_CANON} SELECT src, dst, max(weight) AS weight FROM can GROUP BY 1, 2")
def multi_edge_max(spark: SparkSession, d: str) -> DataFrame:
    return graph.reduce_max(edges(spark, d))


@query(
    """WITH e AS (SELECT 'u' || user_id AS src, event_type AS dst, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS edge_type, value AS weight, event_id FROM events),
    c AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, edge_type, weight, event_id FROM e), l AS (SELECT src, dst, edge_type, arg_max(weight, event_id) AS weight FROM c GROUP BY 1, 2, 3)
    SELECT src, dst, round(sum(weight * CASE edge_type WHEN 'even' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 6) AS weight FROM l GROUP BY 1, 2"""
)
def multi_edge_last_write(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    rows = read(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"), kind.alias("edge_type"), F.col("value").alias("weight"), "event_id")
    weights = spark.createDataFrame([("even", 1.0), ("odd", 0.5)], "edge_type string, coefficient double")
    return rounded(graph.reduce_last(rows, "event_id", weights), ["weight"])


@query(f"WITH {EDGES}, {_CANON}, {_VIEWS} SELECT src, dst, round(sum(weight), 6) AS weight FROM v GROUP BY 1, 2")
def graph_views_combined(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.combine_views(graph.views(edges(spark, d), _assignment(spark))), ["weight"])


@query(
    f"""WITH {EDGES}, {_CANON}, g AS (SELECT src, dst, max(weight) AS weight FROM can GROUP BY 1, 2), dg AS (SELECT n, sum(weight) AS d FROM (SELECT src AS n, weight FROM g UNION ALL SELECT dst, weight FROM g) GROUP BY 1)
    SELECT src, dst, round(weight * CASE WHEN a.d > 0 THEN 1 / sqrt(a.d) ELSE 0 END * CASE WHEN b.d > 0 THEN 1 / sqrt(b.d) ELSE 0 END, 6) AS weight FROM g JOIN dg a ON a.n = src JOIN dg b ON b.n = dst"""
)
def degree_normalise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.normalise(graph.reduce_max(edges(spark, d))), ["weight"])


@query(
    f"""WITH {EDGES}, {_NODES} SELECT 'nodes' AS kind, node_type AS name, count(*)::DOUBLE AS value FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', edge_type, count(*)::DOUBLE FROM edges GROUP BY 2
    UNION ALL SELECT 'density', 'all', round((SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) * (count(*) - 1) FROM nodes)::DOUBLE, 6)"""
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.statistics(_nodes(spark, d), edges(spark, d)), ["value"])


@query(
    f"""WITH {EDGES}, va(variant) AS (VALUES ('full'), ('without_A'), ('without_N'), ('without_R'), ('only_A'), ('only_N'), ('only_R'))
    SELECT variant, count(*) AS n, round(sum(weight), 4) AS total FROM edges JOIN va ON variant = 'full' OR (variant LIKE 'without_%' AND edge_type <> right(variant, 1)) OR (variant LIKE 'only_%' AND edge_type = right(variant, 1)) GROUP BY 1"""
)
def edge_ablation(spark: SparkSession, d: str) -> DataFrame:
    return graph.ablation(edges(spark, d), ["A", "N", "R"]).groupBy("variant").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"))


@query(f"WITH {EDGES} SELECT edge_type, count(*) AS n, count(DISTINCT round(weight, 6)) AS n_weights, count(DISTINCT round(weight, 6)) = 1 AS constant FROM edges GROUP BY 1")
def edge_weight_audit(spark: SparkSession, d: str) -> DataFrame:
    return graph.constant_weight_types(edges(spark, d))


_SETS = "st AS (SELECT DISTINCT l_suppkey AS term, l_partkey % 500 AS item FROM lineitem)"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("term"), (F.col("l_partkey") % 500).alias("item"))


@query(
    f"""WITH {_SETS}, n AS (SELECT term, count(*) c FROM st GROUP BY 1), p AS (SELECT a.term AS src, b.term AS dst, count(*) AS shared FROM st a JOIN st b ON a.item = b.item AND a.term < b.term GROUP BY 1, 2)
    SELECT src, dst, shared, round(shared::DOUBLE / (x.c + y.c - shared)::DOUBLE, 6) AS jaccard FROM p JOIN n x ON x.term = src JOIN n y ON y.term = dst WHERE shared::DOUBLE / (x.c + y.c - shared)::DOUBLE >= 0.05"""
)
def jaccard_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.jaccard_counts(_sets(spark, d), 0.05), ["jaccard"])


@query("WITH b AS (SELECT DISTINCT p_brand, p_size FROM part), p AS (SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS shared FROM b a JOIN b ON a.p_size = b.p_size AND a.p_brand < b.p_brand GROUP BY 1, 2), n AS (SELECT p_brand, count(*) c FROM b GROUP BY 1) SELECT a, b, shared, x.c + y.c - shared AS either, round(shared::DOUBLE / (x.c + y.c - shared)::DOUBLE, 6) AS jaccard FROM p JOIN n x ON x.p_brand = a JOIN n y ON y.p_brand = b")
def card_overlap(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a few declared cards, by their shared features."""
    s = read(spark, d, "part").select("p_brand", "p_size").distinct()
    n = s.groupBy("p_brand").agg(F.count("*").alias("c"))
    pairs = s.select(F.col("p_brand").alias("a"), "p_size").join(s.select(F.col("p_brand").alias("b"), "p_size"), "p_size").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = pairs.join(F.broadcast(n.select(F.col("p_brand").alias("a"), F.col("c").alias("n1"))), "a").join(F.broadcast(n.select(F.col("p_brand").alias("b"), F.col("c").alias("n2"))), "b")
    either = F.col("n1") + F.col("n2") - F.col("shared")
    return both.select("a", "b", "shared", either.alias("either"), F.round(F.col("shared").cast("double") / either.cast("double"), 6).alias("jaccard"))


@query("SELECT p_size AS feature, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS terms, count(DISTINCT p_type) AS n_terms FROM part GROUP BY 1")
def geneset_invert(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").select(F.col("p_type").alias("term"), F.col("p_size").alias("feature"))
    out = graph.invert_sets(parts, parts.select("feature"))
    return out.withColumn("terms", F.array_join("terms", ";"))


@query(f"WITH {SPOTS}, o(dr, dc) AS (VALUES (0, 2), (1, 1), (1, -1)) SELECT least(s.spot, t.spot) AS src, greatest(s.spot, t.spot) AS dst FROM spots s CROSS JOIN o JOIN spots t ON t.array_row = s.array_row + dr AND t.array_col = s.array_col + dc")
def hex_grid_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.hex_edges(spots(spark, d))


@query(f"WITH {SPOTS} SELECT 'duplicate_id' AS problem, 0::BIGINT AS n UNION ALL SELECT 'duplicate_position', count(*) FROM (SELECT array_row, array_col FROM spots GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'spot_without_expression', count(*) FROM spots WHERE spot NOT IN (SELECT o_custkey FROM orders)")
def spot_checks(spark: SparkSession, d: str) -> DataFrame:
    return graph.spot_problems(spots(spark, d), expression=read(spark, d, "orders").select(F.col("o_custkey").alias("spot")))


_HEX = f"{SPOTS}, o(dr, dc) AS (VALUES (0, 2), (1, 1), (1, -1)), hx AS (SELECT s.spot AS src, t.spot AS dst FROM spots s CROSS JOIN o JOIN spots t ON t.array_row = s.array_row + dr AND t.array_col = s.array_col + dc)"


@query(f"WITH {_HEX} SELECT count(*) AS n_edges, round(avg((x.a * y.b + y.a * x.b) / 2), 4) AS adjacency FROM hx JOIN spots x ON x.spot = src JOIN spots y ON y.spot = dst")
def cross_module_adjacency(spark: SparkSession, d: str) -> DataFrame:
    s = spots(spark, d)
    return rounded(graph.edge_product_mean(graph.hex_edges(s), s, "a", "b", "spot"), ["adjacency"], 4)


@query(
    f"""WITH {_HEX}, pm AS (SELECT perm, spot, a, b, row_number() OVER (PARTITION BY perm ORDER BY spot) AS own, row_number() OVER (PARTITION BY perm ORDER BY md5('42:' || perm || ':' || spot), spot) AS dealt FROM spots CROSS JOIN range(1, 1001) t(perm)),
    sh AS (SELECT x.perm, x.spot, y.a, x.b FROM pm x JOIN pm y ON x.perm = y.perm AND x.own = y.dealt), nl AS (SELECT x.perm, avg((x.a * y.b + y.a * x.b) / 2) AS adjacency FROM hx JOIN sh x ON x.spot = src JOIN sh y ON y.spot = dst AND y.perm = x.perm GROUP BY 1),
    ob AS (SELECT avg((x.a * y.b + y.a * x.b) / 2) AS observed FROM hx JOIN spots x ON x.spot = src JOIN spots y ON y.spot = dst)
    SELECT round(observed, 4) AS observed, count(*) AS n, round(avg(adjacency), 4) AS null_mean, round((1 + count(*) FILTER (adjacency >= observed))::DOUBLE / (1 + count(*))::DOUBLE, 6) AS p FROM nl CROSS JOIN ob GROUP BY observed"""
)
def spatial_perm(spark: SparkSession, d: str) -> DataFrame:
    """One score is dealt anew over a fixed grid, 1,000 times."""
    s = spots(spark, d)
    grid = graph.hex_edges(s)
    drawn = stored(nulls.permuted_adjacency(grid, s, 1000, 42, "a", "b", "spot"), "spatial-permutations")
    out = nulls.empirical_p(drawn.where("perm > 0"), drawn.where("perm = 0"), "adjacency")
    return rounded(rounded(out, ["p"]), ["observed", "null_mean"], 4)


@query(f"WITH {MATRIX} SELECT src, dst, round(r, 6) AS r FROM (SELECT a.feature AS src, b.feature AS dst, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS r FROM m a JOIN m b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2) WHERE abs(r) > 0.1")
def corr_matrix_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.corr_edges(matrix(spark, d), 0.1), ["r"])


_DRAWN = f"""{MATRIX}, {MODULES}, {Z}, cm AS (SELECT a.feature AS f, b.feature AS g, avg(a.z * b.z) AS c FROM z a JOIN z b ON a.sample = b.sample GROUP BY 1, 2)"""
_DRAWS = """dr AS (SELECT draw, feature, row_number() OVER (PARTITION BY draw ORDER BY md5('7:' || draw || ':' || feature), feature) AS k FROM (SELECT DISTINCT feature FROM m) CROSS JOIN range(1, 10001) t(draw)),
  mem AS (SELECT draw, feature, CASE WHEN k <= 5 THEN 'a' WHEN k <= 10 THEN 'b' WHEN k = 11 THEN 'c' END AS module FROM dr WHERE k <= 11)"""


def _sum(x: str, y: str) -> str:
    return f"sum(CASE WHEN p.module = '{x}' AND q.module = '{y}' THEN c ELSE 0 END)"


def _rr(x: str, y: str) -> str:
    return f"{_sum(x, y)} / nullif(sqrt({_sum(x, x)} * {_sum(y, y)}), 0)"


_OBSERVED = "ob AS (SELECT 'a' AS module, feature FROM modules WHERE module = 'm1' UNION ALL SELECT 'b', feature FROM modules WHERE module = 'm2' UNION ALL SELECT 'c', 'Brand#16')"


def _null_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    z = sc.z_scores(matrix(spark, d), ["feature"])
    table = nulls.correlations(z)
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    drawn = nulls.draws(z, 10_000, 7, {"a": 5, "b": 5, "c": 1})
    null = nulls.partial_from(nulls.module_corr(drawn, table, ["draw"], pairs), "a", "b", "c")
    named = modules(spark).where("module in ('m1', 'm2')").replace({"m1": "a", "m2": "b"}, subset="module").union(spark.createDataFrame([("c", "Brand#16")], "module string, feature string"))
    observed = nulls.partial_from(nulls.module_corr(named, table, [], pairs), "a", "b", "c")
    return null, observed, pairs


@query(
    f"""WITH {_DRAWN}, {_DRAWS}, {_OBSERVED}, nl AS (SELECT p.draw, {_rr('a', 'b')} AS r FROM mem p JOIN mem q ON p.draw = q.draw JOIN cm ON f = p.feature AND g = q.feature GROUP BY 1),
    os AS (SELECT {_rr('a', 'b')} AS observed FROM ob p CROSS JOIN ob q JOIN cm ON f = p.feature AND g = q.feature)
    SELECT round(observed, 6) AS observed, count(*) AS n, round(avg(r), 6) AS null_mean, round((1 + count(*) FILTER (r >= observed))::DOUBLE / (1 + count(*))::DOUBLE, 6) AS p FROM nl CROSS JOIN os GROUP BY observed"""
)
def perm_null_modules(spark: SparkSession, d: str) -> DataFrame:
    null, observed, _ = _null_parts(spark, d)
    return rounded(nulls.empirical_p(null, observed, "r_a_b"), ["observed", "null_mean", "p"])


@query(
    f"""WITH {_DRAWN}, {_DRAWS}, {_OBSERVED}, nl AS (SELECT p.draw, {_rr('a', 'b')} AS r, {_rr('a', 'c')} AS rac, {_rr('b', 'c')} AS rbc FROM mem p JOIN mem q ON p.draw = q.draw JOIN cm ON f = p.feature AND g = q.feature GROUP BY 1),
    os AS (SELECT {_rr('a', 'b')} AS r, {_rr('a', 'c')} AS rac, {_rr('b', 'c')} AS rbc FROM ob p CROSS JOIN ob q JOIN cm ON f = p.feature AND g = q.feature), oo AS (SELECT (r - rac * rbc) / sqrt((1 - rac * rac) * (1 - rbc * rbc)) AS observed, abs(rac) AS loading FROM os),
    mt AS (SELECT draw, (r - rac * rbc) / sqrt((1 - rac * rac) * (1 - rbc * rbc)) AS rp FROM nl CROSS JOIN oo WHERE abs(abs(rac) - loading) <= tol * loading ORDER BY draw LIMIT 1000)
    SELECT round(observed, 6) AS observed, count(*) AS n, round(avg(rp), 6) AS null_mean, round((1 + count(*) FILTER (rp >= observed))::DOUBLE / (1 + count(*))::DOUBLE, 6) AS p FROM mt CROSS JOIN oo GROUP BY observed""".replace("tol", "0.5")
)
def matched_null(spark: SparkSession, d: str) -> DataFrame:
    """Only draws that load on the covariate about as much as the observed module does."""
    null, observed, _ = _null_parts(spark, d)
    return rounded(nulls.empirical_p(nulls.matched(null, observed, "r_a_c", 0.5, 1000), observed, "rp"), ["observed", "null_mean", "p"])


_GRID = f"""{MATRIX}, {MODULES}, md AS (SELECT * FROM m UNION ALL SELECT sample, 'depth', sum(value) FROM m GROUP BY sample), zd AS (SELECT sample, feature, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM md WINDOW w AS (PARTITION BY feature)),
  cm AS (SELECT a.feature AS f, b.feature AS g, avg(a.z * b.z) AS c FROM zd a JOIN zd b ON a.sample = b.sample GROUP BY 1, 2), pool AS (SELECT DISTINCT feature FROM m WHERE feature NOT IN (SELECT feature FROM modules WHERE module IN ('m1', 'm2')) AND feature <> 'Brand#16'),
  dr AS (SELECT draw, feature, row_number() OVER (PARTITION BY draw ORDER BY md5('9:' || draw || ':' || feature), feature) AS k FROM pool CROSS JOIN range(1, 5001) t(draw)),
  mem AS (SELECT draw, feature, CASE WHEN k <= 5 THEN 'a' ELSE 'b' END AS module FROM dr WHERE k <= 10 UNION ALL SELECT 0, feature, CASE module WHEN 'm1' THEN 'a' ELSE 'b' END FROM modules WHERE module IN ('m1', 'm2')
    UNION ALL SELECT draw, f, x FROM range(0, 5001) t(draw) CROSS JOIN (VALUES ('c', 'Brand#16'), ('d', 'depth')) v(x, f)),
  nl AS (SELECT p.draw, {", ".join(f"{_rr(x, y)} AS {x}{y}" for x, y in ("ab", "ac", "ad", "bc", "bd", "cd"))} FROM mem p JOIN mem q ON p.draw = q.draw JOIN cm ON f = p.feature AND g = q.feature GROUP BY 1),
  p1 AS (SELECT *, (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) AS abc, (ad - ac * cd) / sqrt((1 - ac * ac) * (1 - cd * cd)) AS adc, (bd - bc * cd) / sqrt((1 - bc * bc) * (1 - cd * cd)) AS bdc FROM nl),
  p2 AS (SELECT draw, abs(ac) AS la, abs(bc) AS lb, unnest([{{'control': 'activation', 'r': abc}}, {{'control': 'activation+depth', 'r': (abc - adc * bdc) / sqrt((1 - adc * adc) * (1 - bdc * bdc))}}], recursive := true) FROM p1),
  ce AS (SELECT n.draw, n.control, band, n.r, o.r AS observed, row_number() OVER (PARTITION BY n.control, band ORDER BY n.draw) AS k FROM p2 n JOIN p2 o ON o.control = n.control AND o.draw = 0 AND n.draw > 0
    CROSS JOIN (VALUES ('match0.25', 0.25::DOUBLE), ('match0.5', 0.5::DOUBLE), ('match1.0', 1.0::DOUBLE), ('unmatched', NULL)) b(band, tol) WHERE tol IS NULL OR (abs(n.la - o.la) <= tol * o.la AND abs(n.lb - o.lb) <= tol * o.lb))"""


@query(
    f"""WITH {_GRID} SELECT control, band, round(observed, 6) AS observed, round(avg(r), 6) AS null_mean, round(quantile_cont(r, 0.95), 6) AS p95, count(*) AS n, round((1 + count(*) FILTER (r >= observed))::DOUBLE / (1 + count(*))::DOUBLE, 6) AS p,
    (1 + count(*) FILTER (r >= observed))::DOUBLE / (1 + count(*))::DOUBLE < 0.05 AND observed > avg(r) AS specific FROM ce WHERE k <= 1000 GROUP BY control, band, observed"""
)
def robustness_grid(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of controls against four bands of loadings, 1,000 draws of 5,000 a cell where there are so many."""
    long = matrix(spark, d)
    depth = long.groupBy("sample").agg(F.sum("value").alias("value")).select("sample", F.lit("depth").alias("feature"), "value")
    z = sc.z_scores(long.select("sample", "feature", "value").union(depth), ["feature"])
    table = nulls.correlations(z)
    names = modules(spark).where("module in ('m1', 'm2')").replace({"m1": "a", "m2": "b"}, subset="module")
    pool = long.select("feature").distinct().join(names, "feature", "left_anti").where("feature <> 'Brand#16'")
    fixed = spark.createDataFrame([("c", "Brand#16"), ("d", "depth")], "module string, feature string")
    pairs = [(x, y) for x, y in ("ab", "ac", "ad", "bc", "bd", "cd")]
    drawn = nulls.draws(pool, 5000, 9, {"a": 5, "b": 5}).select("draw", "module", "feature")
    every = drawn.union(spark.range(1, 5001).select(F.col("id").cast("int").alias("draw")).join(F.broadcast(fixed)).select("draw", "module", "feature"))
    null, observed = nulls.module_corr(every, table, ["draw"], pairs), nulls.module_corr(names.union(fixed), table, [], pairs)
    bands = {"match0.25": 0.25, "match0.5": 0.5, "match1.0": 1.0, "unmatched": None}
    return rounded(nulls.grid(null, observed, {"activation": ["c"], "activation+depth": ["c", "d"]}, bands, 1000), ["observed", "null_mean", "p95", "p"])


_DEPTHS = f"""{MATRIX}, {MODULES}, dp AS (SELECT sample, sum(value) AS depth FROM m GROUP BY 1), fr AS (SELECT feature, covar_pop(value, depth) / nullif(stddev_pop(value) * stddev_pop(depth), 0) AS r FROM m JOIN dp USING (sample) GROUP BY 1),
  dn AS (SELECT draw, avg(r) AS mean, avg(abs(r)) AS mean_abs FROM (SELECT draw, feature, r, row_number() OVER (PARTITION BY draw ORDER BY md5('3:' || draw || ':' || feature), feature) AS k FROM fr CROSS JOIN range(1, 501) t(draw)) WHERE k <= 10 GROUP BY 1)"""


@query(
    f"""WITH {_DEPTHS} SELECT module AS name, round(avg(r), 6) AS mean, round(avg(abs(r)), 6) AS mean_abs, CAST(NULL AS DOUBLE) AS sd, count(*) AS n FROM fr JOIN modules USING (feature) GROUP BY 1
    UNION ALL SELECT 'drawn', round(avg(mean), 6), round(avg(mean_abs), 6), round(stddev_pop(mean), 6), count(*) FROM dn"""
)
def random_draw_reference(spark: SparkSession, d: str) -> DataFrame:
    """How much the features of modules go with depth, next to 500 draws of ten features."""
    long = matrix(spark, d)
    each = stored(stats.corr_with_score(long, long.groupBy("sample").agg(F.sum("value").alias("score"))).select("feature", "r"), "depth-correlations")
    own = each.join(F.broadcast(modules(spark)), "feature").groupBy(F.col("module").alias("name"))
    named = own.agg(F.avg("r").alias("mean"), F.avg(F.abs("r")).alias("mean_abs"), F.lit(None).cast("double").alias("sd"), F.count("*").alias("n"))
    drawn = nulls.drawn_means(each, 500, 10, 3, "r").agg(F.avg("mean").alias("mean"), F.avg("mean_abs").alias("mean_abs"), F.stddev_pop("mean").alias("sd"), F.count("*").alias("n"))
    return rounded(named.union(drawn.select(F.lit("drawn").alias("name"), "mean", "mean_abs", "sd", "n")), ["mean", "mean_abs", "sd"])


_RXY = "covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1}))"


@query(
    f"""WITH {MATRIX}, {MODULES}, {Z}, dp AS (SELECT sample, sum(value) AS depth FROM m GROUP BY 1), dt AS (SELECT feature, count(*) FILTER (value > 0)::DOUBLE / (SELECT count(DISTINCT sample) FROM m)::DOUBLE AS rate FROM m GROUP BY 1),
    sc AS (SELECT kept, sample, avg(coalesce(z, 0)) FILTER (module = 'm1') AS a, avg(coalesce(z, 0)) FILTER (module = 'm2') AS b FROM z JOIN modules USING (feature) JOIN dt USING (feature) JOIN (VALUES ('all', 0.0::DOUBLE), ('well_detected', 0.97::DOUBLE)) k(kept, least) ON rate >= least GROUP BY 1, 2),
    nf AS (SELECT kept, count(DISTINCT feature) AS n_features FROM modules JOIN dt USING (feature) JOIN (VALUES ('all', 0.0::DOUBLE), ('well_detected', 0.97::DOUBLE)) k(kept, least) ON rate >= least WHERE module IN ('m1', 'm2') GROUP BY 1),
    rr AS (SELECT kept, count(*) AS n, {_RXY.format("a", "b")} AS r, {_RXY.format("a", "depth")} AS x, {_RXY.format("b", "depth")} AS y FROM sc JOIN dp USING (sample) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
    SELECT kept, n_features, n, round(r, 6) AS r, round((r - x * y) / sqrt((1 - x * x) * (1 - y * y)), 6) AS rp FROM rr JOIN nf USING (kept)"""
)
def trimmed_modules(spark: SparkSession, d: str) -> DataFrame:
    """Two modules' correlation, plain and without depth, over all their features and over those that nearly all samples have."""
    long = matrix(spark, d)
    n = long.agg(F.countDistinct("sample").cast("double").alias("n"))
    rate = long.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("_there")).join(F.broadcast(n)).select("feature", (F.col("_there") / F.col("n")).alias("rate"))
    levels = spark.createDataFrame([("all", 0.0), ("well_detected", 0.97)], "kept string, least double")
    members = stored(modules(spark).where("module in ('m1', 'm2')").join(rate, "feature").join(F.broadcast(levels)).where("rate >= least").select("kept", "module", "feature"), "trimmed-modules")
    z = sc.z_scores(long, ["feature"]).join(F.broadcast(members), "feature")
    mean = lambda m: F.avg(F.when(F.col("module") == m, F.coalesce("z", F.lit(0.0))))
    table = z.groupBy("kept", "sample").agg(mean("m1").alias("a"), mean("m2").alias("b")).where("a is not null and b is not null").join(long.groupBy("sample").agg(F.sum("value").alias("depth")), "sample")
    out = stats.partial_corr_test(table, ["kept"], "a", "b", "depth").join(members.groupBy("kept").agg(F.countDistinct("feature").alias("n_features")), "kept")
    return rounded(out, ["r", "rp"]).select("kept", "n_features", "n", "r", "rp")


@query(
    "WITH v AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l, vec_id FROM embeddings), u AS (SELECT label, i, sum(x / l) AS x FROM v GROUP BY 1, 2), n AS (SELECT label, count(*) c FROM embeddings GROUP BY 1), "
    "s AS (SELECT p.label AS a, q.label AS b, sum(p.x * q.x) AS s FROM u p JOIN u q ON p.i = q.i AND p.label <= q.label GROUP BY 1, 2) "
    "SELECT a, b, CASE WHEN a = b THEN x.c * (x.c - 1) ELSE x.c * y.c END AS n_pairs, round(CASE WHEN a = b THEN (s - x.c) / nullif(x.c * (x.c - 1), 0) ELSE s / (x.c * y.c) END, 6) AS coupling FROM s JOIN n x ON x.label = a JOIN n y ON y.label = b"
)
def module_coupling_cosine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.mean_coupling(read(spark, d, "embeddings"), "label", "embedding"), ["coupling"])


@query(
    f"WITH {MATRIX}, e AS (SELECT 'Brand#' || (vec_id + 1) AS feature, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT sample, CAST(dim AS INTEGER) AS dim, round(sum(value * x), 4) AS value FROM m JOIN e USING (feature) GROUP BY 1, 2"
)
def projection(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.concat(F.lit("Brand#"), F.col("vec_id") + 1).alias("feature"), F.col("embedding").alias("vector"))
    return rounded(graph.project(matrix(spark, d), e), ["value"], 4)


@query(
    f"""WITH {EDGES}, {_CANON}, g AS (SELECT src, dst, max(weight) AS weight FROM can GROUP BY 1, 2), c AS (SELECT DISTINCT n, CAST(right(n, 1) AS INTEGER) % 3 AS k FROM (SELECT src AS n FROM g UNION ALL SELECT dst FROM g)),
    i AS (SELECT sum(CASE WHEN a.k = b.k THEN weight ELSE 0 END) AS w, sum(weight) AS t FROM g JOIN c a ON a.n = src JOIN c b ON b.n = dst), dg AS (SELECT k, sum(weight) AS d FROM (SELECT src AS n, weight FROM g UNION ALL SELECT dst, weight FROM g) JOIN c USING (n) GROUP BY 1)
    SELECT round(w / t - (SELECT sum(d * d) FROM dg) / (4 * t * t), 6) AS modularity FROM i"""
)
def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    g = graph.reduce_max(edges(spark, d))
    nodes = g.select(F.col("src").alias("node_id")).union(g.select("dst")).distinct()
    return rounded(graph.modularity(g, nodes.withColumn("community", F.right("node_id", F.lit(1)).cast("int") % 3)), ["modularity"])


@query("SELECT a.p_brand AS src, b.p_brand AS dst, 'mechanism' AS edge_type, 0.5::DOUBLE AS weight FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 3) a CROSS JOIN (SELECT DISTINCT p_brand FROM part WHERE p_size > 48) b WHERE a.p_brand <> b.p_brand")
def mechanism_edges(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_brand").alias("node_id"), "p_size")
    return graph.across(p.where("p_size < 3"), p.where("p_size > 48"), "mechanism", 0.5)


@query("SELECT DISTINCT a.s_name AS src, b.s_name AS dst, 'axis' AS edge_type, 0.3::DOUBLE AS weight FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_name < b.s_name")
def axis_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.inside_groups(read(spark, d, "supplier"), "s_nationkey", "s_name", "axis", 0.3)


@query("SELECT trim(split_part(c_name, '#', 1)) AS prefix, trim(split_part(c_name, '#', -1)) AS number, c_custkey FROM customer")
def identifier_fields(spark: SparkSession, d: str) -> DataFrame:
    from tallgrass.functions.expr import last_field

    return read(spark, d, "customer").select(first_field("c_name", "#").alias("prefix"), last_field("c_name", "#").alias("number"), "c_custkey")


def _view_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.views(edges(spark, d), _assignment(spark)).where("weight > 0")


def _part_groups(view_edges: DataFrame) -> DataFrame:
    """(module, node): parts by the last figure of their number, modulo 3."""
    parts = view_edges.select(F.col("src").alias("node")).union(view_edges.select("dst")).distinct().where("node like 'p%'")
    return parts.select(F.concat(F.lit("g"), F.substring("node", -1, 1).cast("int") % 3).alias("module"), "node")


def _pairs(spark: SparkSession, views: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(v, a, b) for v in views for a, b in pairs], "view string, a string, b string")


@query()
def spectral_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Couplings of part groups after a spectral embedding of each view; only rotation-free numbers are returned."""
    v = _view_edges(spark, d)
    found = spectral.embed(v, 16)
    return rounded(spectral.coupling(found.vectors, _part_groups(v), _pairs(spark, ["closed", "open"], [("g0", "g1"), ("g0", "g2"), ("g1", "g2")])), ["coupling"], 4)


@query()
def spectral_values(spark: SparkSession, d: str) -> DataFrame:
    """The largest singular values of each view's normalised adjacency."""
    found = spectral.embed(_view_edges(spark, d), 16)
    return spark.createDataFrame([(v, k + 1, round(float(x), 6)) for v, values in found.values.items() for k, x in enumerate(values)], "view string, place int, value double")


@query()
def label_permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """Declared pairs of modules in each view against 1,000 permutations of the node labels."""
    v = _view_edges(spark, d)
    vectors = stored(spectral.embed(v, 16).vectors, "view-vectors")
    groups, pairs = _part_groups(v), _pairs(spark, ["closed", "open"], [("g0", "g1")])
    null = spectral.permuted_coupling(vectors, groups, pairs, 1000)
    return rounded(spectral.null_summary(null, spectral.coupling(vectors, groups, pairs)), ["observed", "null_mean", "null_sd", "low", "high", "p"], 4)


_STORED = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), u AS (SELECT vec_id, generate_subscripts(e, 1) AS i, unnest(e) / l AS x FROM v),
  own AS (SELECT vec_id, label, dense_rank() OVER (ORDER BY vec_id) AS pos FROM v WHERE label IN (0, 1, 2, 3)), pm AS (SELECT 0 AS perm, vec_id AS node, vec_id AS image FROM own UNION ALL
  SELECT perm, own.vec_id, t.vec_id FROM (SELECT perm, vec_id, row_number() OVER (PARTITION BY perm ORDER BY md5('42:' || perm || ':' || vec_id), vec_id) AS pos FROM v CROSS JOIN range(1, 201) r(perm)) t JOIN own USING (pos)),
  c AS (SELECT perm, label, i, avg(x) AS x FROM pm JOIN own ON own.vec_id = pm.node JOIN u ON u.vec_id = pm.image GROUP BY 1, 2, 3),
  k AS (SELECT p.perm, p.label AS a, q.label AS b, sum(p.x * q.x) AS coupling FROM c p JOIN c q ON p.perm = q.perm AND p.i = q.i AND (p.label, q.label) IN ((0, 1), (2, 3)) GROUP BY 1, 2, 3)"""


@query(
    f"""WITH {_STORED} SELECT 'all' AS view, 'l' || n.a AS a, 'l' || n.b AS b, round(o.coupling, 6) AS observed, round(avg(n.coupling), 6) AS null_mean, round(stddev_pop(n.coupling), 6) AS null_sd, round(quantile_cont(n.coupling, 0.025), 6) AS low,
    round(quantile_cont(n.coupling, 0.975), 6) AS high, round((1 + count(*) FILTER (n.coupling >= o.coupling))::DOUBLE / (1 + count(*))::DOUBLE, 6) AS p, count(*) AS n FROM k n JOIN k o ON o.a = n.a AND o.b = n.b AND o.perm = 0 WHERE n.perm > 0 GROUP BY n.a, n.b, o.coupling"""
)
def stored_coupling_null(spark: SparkSession, d: str) -> DataFrame:
    """Declared pairs of labels in a stored embedding against permuted labels."""
    rows = stored(read(spark, d, "embeddings").select(F.lit("all").alias("view"), F.col("vec_id").alias("node"), F.col("embedding").alias("vector"), F.concat(F.lit("l"), "label").alias("module")), "stored-vectors")
    vectors, groups, pairs = rows.drop("module"), rows.where("module in ('l0', 'l1', 'l2', 'l3')").select("module", "node"), _pairs(spark, ["all"], [("l0", "l1"), ("l2", "l3")])
    null = spectral.permuted_coupling(vectors, groups, pairs, 200)
    return rounded(spectral.null_summary(null, spectral.coupling(vectors, groups, pairs)), ["observed", "null_mean", "null_sd", "low", "high", "p"])


@query()
def contextual_permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """The coupling in all views together, with the labels of one view permuted and the other view fixed: an embedding for each permutation."""
    v = stored(_view_edges(spark, d), "views")
    drawn = stored(spectral.contextual_coupling(v, "closed", _part_groups(v), "g0", "g1", 20, 8), "contextual-coupling")
    null, observed = drawn.where("perm > 0"), drawn.where("perm = 0").drop("perm")
    return rounded(spectral.null_summary(null, observed), ["observed", "null_mean", "null_sd", "low", "high", "p"], 4)


@query()
def random_walk_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """200 walks of 30 steps from every node, in each view."""
    return walks.near_totals(walks.walked(_view_edges(spark, d), 200, 30))


@query()
def walk_embedding_coupling(spark: SparkSession, d: str) -> DataFrame:
    """The counts of nodes near each other on walks, factorised: couplings of part groups in that embedding."""
    v = _view_edges(spark, d)
    vectors = walks.embedded(walks.walked(v, 20, 30, weighted=False), 16).vectors
    return rounded(spectral.coupling(vectors, _part_groups(v), _pairs(spark, ["closed", "open"], [("g0", "g1"), ("g0", "g2"), ("g1", "g2")])), ["coupling"], 4)


@query(f"WITH {MATRIX}, {MODULES}, sc AS (SELECT sample, avg(value) AS s FROM m GROUP BY 1) SELECT 'state' AS src, feature AS dst, round(covar_pop(value, s) / nullif(stddev_pop(value) * stddev_pop(s), 0), 6) AS r FROM m JOIN sc USING (sample) GROUP BY feature HAVING abs(covar_pop(value, s) / nullif(stddev_pop(value) * stddev_pop(s), 0)) > 0.1")
def state_feature_edges(spark: SparkSession, d: str) -> DataFrame:
    long = matrix(spark, d)
    score = long.groupBy("sample").agg(F.avg("value").alias("score"))
    linked = stats.corr_with_score(long, score).where(F.abs("r") > 0.1)
    return rounded(linked.select(F.lit("state").alias("src"), F.col("feature").alias("dst"), "r"), ["r"])

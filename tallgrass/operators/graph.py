"""Typed graphs as two tables: nodes (node_id, node_type) and edges (src, dst, edge_type, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.expr import ratio
from tallgrass.functions.store import stored
from tallgrass.operators import blocks

#: Members of a part of a group, and rows of a task that reduces edges.
_PART, _EDGES = 2048, 200_000


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("node_id").distinct()
    first = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return first.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def across(left: DataFrame, right: DataFrame, edge_type: str, weight: float, node: str = "node_id") -> DataFrame:
    """An edge for each pair of two small node sets (module sizes), without self loops."""
    a, b = left.select(F.col(node).alias("src")).distinct(), right.select(F.col(node).alias("dst")).distinct()
    return a.crossJoin(b).where("src <> dst").select("src", "dst", F.lit(edge_type).alias("edge_type"), F.lit(weight).alias("weight"))


def inside_groups(members: DataFrame, group: str, node: str, edge_type: str, weight: float) -> DataFrame:
    """An edge for each unordered pair of members of the same group, once, however often the members are listed and share groups.

    Members are made distinct before they are paired. A group of many members is cut into parts of about ``_PART``, and each pair of parts is a key of its own, so no task has a group whole."""
    own = stored(members.where(F.col(group).isNotNull() & F.col(node).isNotNull()).select(F.col(group).alias("_g"), F.col(node).alias("_n")).distinct(), "group-members")
    sizes = own.groupBy("_g").agg(F.ceil(F.count("*") / F.lit(_PART)).cast("int").alias("_parts"))
    dealt = own.join(sizes, "_g").withColumn("_i", F.pmod(F.xxhash64("_n"), F.col("_parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    a = dealt.select("_g", F.col("_n").alias("src"), "_i", other.alias("_j"))
    b = dealt.select("_g", F.col("_n").alias("dst"), other.alias("_i"), F.col("_i").alias("_j"))
    pairs = a.join(b, ["_g", "_i", "_j"]).where("src < dst").select("src", "dst")
    if not own.groupBy("_n").count().where("count > 1").isEmpty():  # two members may share several groups
        pairs = pairs.distinct()
    return pairs.select("src", "dst", F.lit(edge_type).alias("edge_type"), F.lit(weight).alias("weight"))


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected: the smaller end first, no self loops."""
    return edges.where("src <> dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def reduce_max(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The largest weight of each pair. Pairs hardly repeat inside a task's rows, so they are dealt first, and as many tasks as the rows need each have about ``_EDGES`` of them."""
    n = max(1, -(-edges.count() // _EDGES))
    return canonical(edges).repartition(n, "src", "dst").groupBy(*(by or []), "src", "dst").agg(F.max("weight").alias("weight"))


def reduce_last(edges: DataFrame, order: str, coefficients: DataFrame) -> DataFrame:
    """The last weight of each pair and type, then the sum over types weighted by coefficients (edge_type, coefficient)."""
    last = canonical(edges).groupBy("src", "dst", "edge_type").agg(F.max_by("weight", order).alias("weight"))
    return last.join(F.broadcast(coefficients), "edge_type").groupBy("src", "dst").agg(F.sum(F.col("weight") * F.col("coefficient")).alias("weight"))


def views(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(view, src, dst, weight): edge types are assigned to views (edge_type, view); the largest weight of a pair counts. The assignment is declared, a row for each type, and is
    broadcast: dealt by type, all edges would meet in as many tasks as there are types."""
    return reduce_max(edges.join(F.broadcast(assignment), "edge_type"), ["view"])


def view_problems(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(problem, name): types without a view, types with several, views without an edge."""
    types = edges.select("edge_type").distinct()
    lost = types.join(assignment, "edge_type", "left_anti").select(F.lit("unassigned_type").alias("problem"), F.col("edge_type").alias("name"))
    twice = assignment.groupBy("edge_type").agg(F.countDistinct("view").alias("n")).where("n > 1").select(F.lit("type_in_several_views").alias("problem"), F.col("edge_type").alias("name"))
    there = assignment.join(types, "edge_type", "left_semi").select("view")
    empty = assignment.select("view").distinct().join(there, "view", "left_anti").select(F.lit("empty_view").alias("problem"), F.col("view").alias("name"))
    return lost.union(twice).union(empty)


def combine_views(view_edges: DataFrame) -> DataFrame:
    return view_edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    swapped = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(swapped.select(*edges.columns))


def normalise(edges: DataFrame, zero_degree_one: bool = False) -> DataFrame:
    """Weights divided by the square roots of both ends' degrees. A zero degree gives zero, or counts as one."""
    degree = both_ways(edges).groupBy("src").agg(F.sum("weight").alias("_d"))
    root = F.when(F.col("_d") > 0, 1 / F.sqrt("_d")).otherwise(1.0 if zero_degree_one else 0.0)
    scale = degree.select("src", root.alias("_s"))
    out = edges.join(scale, "src").withColumnRenamed("_s", "_s1").join(scale.withColumnRenamed("src", "dst"), "dst")
    return out.withColumn("weight", F.col("weight") * F.col("_s1") * F.col("_s")).select(*edges.columns)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n) of node and edge types, and the directed density as kind 'density' in ``value``."""
    per_node = nodes.groupBy("node_type").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), F.col("node_type").alias("name"), F.col("n").cast("double").alias("value"))
    per_edge = edges.groupBy("edge_type").agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), F.col("edge_type").alias("name"), F.col("n").cast("double").alias("value"))
    n = nodes.agg(F.count("*").alias("n"))
    density = edges.agg(F.count("*").alias("e")).join(n).select(F.lit("density").alias("kind"), F.lit("all").alias("name"), ratio("e", F.col("n") * (F.col("n") - 1)).alias("value"))
    return per_node.union(per_edge).union(density)


def ablation(edges: DataFrame, types: list[str]) -> DataFrame:
    """(variant, kept edges): all, without each type, and each type alone; a variant is a filter, not a copy of the graph."""
    names = ["full", *(f"without_{t}" for t in types), *(f"only_{t}" for t in types)]
    rule = F.lit(True)
    for t in types:
        rule = F.when(F.col("variant") == f"without_{t}", F.col("edge_type") != t).when(F.col("variant") == f"only_{t}", F.col("edge_type") == t).otherwise(rule)
    return edges.select("*", F.explode(F.array(*map(F.lit, names))).alias("variant")).where(rule)


def jaccard_join(sets: DataFrame, least: float, term: str = "term", item: str = "item") -> DataFrame:
    """(src, dst, shared, jaccard) of pairs of sets with at least ``least`` (> 0): by an inverted index with prefixes.

    Two sets that are similar enough share an item among the first n - ceil(least * n) + 1 of either in an order by rarity, so only those items are joined;
    frequent items, which would pair almost everything, are in a prefix only if ``least`` is low. Sizes bound the pairs before the exact count."""
    members = sets.select(term, item).distinct()
    often = members.groupBy(item).agg(F.count("*").alias("_often"))
    spec = Window.partitionBy(term)
    placed = members.join(often, item).withColumns({"_at": F.row_number().over(spec.orderBy("_often", item)), "_n": F.count("*").over(spec)})
    prefix = placed.where(F.col("_at") <= F.col("_n") - F.ceil(F.lit(least) * F.col("_n") - 1e-9) + 1)
    a = prefix.select(F.col(term).alias("src"), F.col("_n").alias("n1"), item)
    b = prefix.select(F.col(term).alias("dst"), F.col("_n").alias("n2"), item)
    pairs = a.join(b, item).where((F.col("src") < F.col("dst")) & (F.col("n1") >= least * F.col("n2")) & (F.col("n2") >= least * F.col("n1"))).select("src", "dst", "n1", "n2").distinct()
    whole = members.groupBy(term).agg(F.collect_set(item).alias("_s"))
    joined = pairs.join(whole.select(F.col(term).alias("src"), F.col("_s").alias("_a")), "src").join(whole.select(F.col(term).alias("dst"), F.col("_s").alias("_b")), "dst")
    shared = joined.withColumn("shared", F.size(F.array_intersect("_a", "_b")))
    return shared.select("src", "dst", "shared", ratio("shared", F.col("n1") + F.col("n2") - F.col("shared")).alias("jaccard")).where(F.col("jaccard") >= least)


def invert_sets(sets: DataFrame, panel: DataFrame, term: str = "term", feature: str = "feature") -> DataFrame:
    """(feature, terms, n_terms) for the features of a panel."""
    return sets.join(panel.select(feature).distinct(), feature, "left_semi").groupBy(feature).agg(F.array_sort(F.collect_set(term)).alias("terms"), F.countDistinct(term).alias("n_terms"))


def hex_edges(spots: DataFrame, spot: str = "spot", row: str = "array_row", col: str = "array_col") -> DataFrame:
    """(src, dst) of neighbours on a hex grid. Of the six legal offsets three reach every undirected edge once; holes are not bridged."""
    half = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 2), (1, 1), (1, -1))])).alias("o")
    a = spots.select(F.col(spot).alias("_a"), F.col(row).alias("_r"), F.col(col).alias("_c"), half).select("_a", (F.col("_r") + F.col("o.r")).alias("_r"), (F.col("_c") + F.col("o.c")).alias("_c"))
    b = spots.select(F.col(spot).alias("_b"), F.col(row).alias("_r"), F.col(col).alias("_c"))
    return a.join(b, ["_r", "_c"]).select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"))


def spot_problems(spots: DataFrame, spot: str = "spot", row: str = "array_row", col: str = "array_col", expression: DataFrame | None = None) -> DataFrame:
    """(problem, n): repeated identifiers and repeated positions, and spots that are not among those with ``expression`` (spot)."""
    ids = spots.groupBy(spot).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_id").alias("problem"), "n")
    places = spots.groupBy(row, col).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_position").alias("problem"), "n")
    if expression is None:
        return ids.union(places)
    orphans = spots.join(expression.select(spot).distinct(), spot, "left_anti").agg(F.count("*").alias("n")).select(F.lit("spot_without_expression").alias("problem"), "n")
    return ids.union(places).union(orphans)


def edge_product_mean(edges: DataFrame, scores: DataFrame, a: str, b: str, node: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, n_edges, adjacency): the mean over edges of (a b' + a' b) / 2."""
    keys = groups or []
    left = scores.select(*keys, F.col(node).alias("src"), F.col(a).alias("_a1"), F.col(b).alias("_b1"))
    right = scores.select(*keys, F.col(node).alias("dst"), F.col(a).alias("_a2"), F.col(b).alias("_b2"))
    joined = edges.join(left, "src").join(right, [*keys, "dst"])
    product = (F.col("_a1") * F.col("_b2") + F.col("_a2") * F.col("_b1")) / 2
    return joined.groupBy(*keys).agg(F.count("*").alias("n_edges"), F.avg(product).alias("adjacency"))


def corr_edges(long: DataFrame, least: float, sample: str = "sample", feature: str = "feature") -> DataFrame:
    """(src, dst, r) of feature pairs with |r| over ``least``, from products of blocks."""
    return blocks.pairs(long, least, sample, feature).select("src", "dst", "r")


def jaccard_counts(sets: DataFrame, least: float, term: str = "term", item: str = "item") -> DataFrame:
    """What ``jaccard_join`` gives, for a low ``least`` or sets that share most items: there prefixes are almost the sets, and all pairs are counted from products of blocks instead."""
    return blocks.shared_items(sets, least, term, item)


def dot(a: Column | str, b: Column | str) -> Column:
    """The scalar product of two arrays, in doubles."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    length = F.sqrt(dot(vector, vector))
    return vectors.withColumn(vector, F.transform(vector, lambda x: x.cast("double") / F.when(length > 0, length)))


def mean_coupling(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(a, b, n_pairs, coupling): the mean cosine between members of two groups (self pairs left out).

    The mean over all pairs is the scalar product of the groups' summed unit vectors, so pairs are never formed: one sum for each group and place."""
    unit = unit_vectors(vectors.where(dot(vector, vector) > 0), vector)
    parts = unit.select(group, F.posexplode(vector).alias("_i", "_x")).groupBy(group, "_i").agg(F.sum("_x").alias("_x"))
    sizes = unit.groupBy(group).agg(F.count("*").alias("_n"))
    a = parts.select(F.col(group).alias("a"), "_i", F.col("_x").alias("_x1"))
    b = parts.select(F.col(group).alias("b"), "_i", F.col("_x").alias("_x2"))
    total = a.join(b, "_i").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("_x1") * F.col("_x2")).alias("_s"))
    joined = total.join(F.broadcast(sizes.select(F.col(group).alias("a"), F.col("_n").alias("_na"))), "a").join(F.broadcast(sizes.select(F.col(group).alias("b"), F.col("_n").alias("_nb"))), "b")
    own = F.col("a") == F.col("b")
    n = F.when(own, F.col("_na") * (F.col("_na") - 1)).otherwise(F.col("_na") * F.col("_nb"))
    s = F.when(own, F.col("_s") - F.col("_na")).otherwise(F.col("_s"))
    return joined.select("a", "b", n.alias("n_pairs"), ratio(s, n).alias("coupling"))


def project(long: DataFrame, embedding: DataFrame, sample: str = "sample", feature: str = "feature") -> DataFrame:
    """(sample, dim, value): the matrix times feature vectors (feature, vector)."""
    each = embedding.select(feature, F.posexplode("vector").alias("dim", "_e"))
    return long.join(each, feature).groupBy(sample, "dim").agg(F.sum(F.col("value") * F.col("_e").cast("double")).alias("value"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: weighted modularity of undirected edges under communities (node_id, community)."""
    of = communities.select(F.col("node_id").alias("src"), F.col("community").alias("_c1")), communities.select(F.col("node_id").alias("dst"), F.col("community").alias("_c2"))
    joined = edges.join(of[0], "src").join(of[1], "dst")
    inside = joined.agg(F.sum(F.when(F.col("_c1") == F.col("_c2"), F.col("weight")).otherwise(0.0)).alias("_in"), F.sum("weight").alias("_m"))
    degree = both_ways(edges.select("src", "dst", "weight")).join(of[0], "src").groupBy("_c1").agg(F.sum("weight").alias("_d"))
    squares = degree.agg(F.sum(F.col("_d") * F.col("_d")).alias("_dd"))
    return inside.join(squares).select((ratio("_in", "_m") - ratio("_dd", 4 * F.col("_m") * F.col("_m"))).alias("modularity"))


def constant_weight_types(edges: DataFrame) -> DataFrame:
    """(edge_type, n, n_weights, constant): whether all edges of a type share one weight."""
    n = F.countDistinct(F.round("weight", 6))
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"), n.alias("n_weights"), (n == 1).alias("constant"))

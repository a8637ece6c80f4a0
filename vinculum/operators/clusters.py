"""Collapsed clusters, tree likeness, modularity, facet scope and undirected connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.model import Graph
from vinculum.operators import traversal


def _absorbed(g: Graph, dirs: DataFrame) -> DataFrame:
    """id, cluster: the outermost of ``dirs`` (dir) that a node lies in; its directories meet them by equality."""
    above = g.nodes.select("id", F.posexplode(paths.dir_prefixes(F.col("filePath"))).alias("at", "dir"))
    return above.join(dirs.select("dir").distinct(), "dir").groupBy("id").agg(F.min_by("dir", "at").alias("cluster"))


def _agg_id(cluster: Column) -> Column:
    return F.concat(cluster, F.lit("#__agg__"))


def collapsed_nodes(g: Graph, dirs: DataFrame) -> DataFrame:
    """id, kind, label, filePath: nodes outside ``dirs``, and one card for each of these that holds a node."""
    inside = _absorbed(g, dirs)
    kept = g.nodes.join(inside, "id", "left_anti").select("id", "kind", "label", "filePath")
    cards = inside.groupBy("cluster").agg(F.count_if(~F.contains("id", F.lit("#"))).alias("n"))
    label = F.concat(F.element_at(F.split("cluster", "/"), -1), F.lit(" · "), F.col("n").cast("string"))
    return kept.union(cards.select(_agg_id(F.col("cluster")), F.lit("file"), label, "cluster"))


def collapsed_edges(g: Graph, dirs: DataFrame) -> DataFrame:
    """source, target, kind, count, n_edges after the ends inside ``dirs`` moved to their cards; loops go."""
    inside = _absorbed(g, dirs)
    e = g.edges.join(inside.toDF("source", "a"), "source", "left").join(inside.toDF("target", "b"), "target", "left")
    e = e.select(F.coalesce(_agg_id(F.col("a")), "source").alias("source"), F.coalesce(_agg_id(F.col("b")), "target").alias("target"), "kind", "count")
    return e.filter("source <> target").groupBy("source", "target", "kind").agg(F.sum("count").alias("count"), F.count("*").alias("n_edges"))


def tree_score(g: Graph) -> DataFrame:
    """One row, score: 1 for a tree, less as nodes gain parents and edges outnumber a tree's."""
    parents = g.valid_edges().filter("source <> target").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    s = g.nodes.select("id").join(parents, "id", "left").agg(F.count("*").alias("n"), F.sum(k).alias("m"), F.count_if(k <= 1).alias("single"))
    n, m = F.col("n"), F.col("m")
    score = 0.6 * F.col("single") / n + 0.4 * F.greatest(F.lit(0.0), 1 - F.abs(m - (n - 1)) / n)
    return s.select(F.when(n <= 1, 1.0).otherwise(score).alias("score"))


def _pairs(g: Graph) -> DataFrame:
    """a, b: each undirected link between two nodes, in both directions, once; ``contains`` is no relationship."""
    e = g.valid_edges().filter("source <> target AND kind <> 'contains'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return e.union(e.select("b", "a")).distinct()


def plain_pairs(edges: DataFrame) -> DataFrame:
    """a, b: the ends of edges (source, target) in both directions, once."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return e.union(e.select("b", "a")).distinct()


def modularity(g: Graph, communities: DataFrame | None = None) -> DataFrame:
    """One row, modularity and largest_community, of ``communities`` (id, community); those of :func:`traversal.communities` by default.

    A graph without a link has modularity 0.
    """
    of = traversal.communities(g) if communities is None else communities
    ends = _pairs(g).join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b")
    by = ends.groupBy("ca").agg(F.count("*").alias("d"), F.count_if(F.col("ca") == F.col("cb")).alias("own"))
    total = by.agg(F.sum("d").alias("t"), F.sum("own").alias("own"), F.sum(F.col("d").cast("double") * F.col("d")).alias("sq"))
    value = F.coalesce(F.col("own") / F.col("t") - F.col("sq") / (F.col("t").cast("double") * F.col("t")), F.lit(0.0))
    most = of.groupBy("community").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest_community"))
    return total.select(value.alias("modularity")).join(most)  # both sides are one row


def present_scope(g: Graph) -> DataFrame:
    """facet, value: the values that occur among the nodes."""
    facets = [c for c in ("kind", "role", "category", "environment", "externalKind", "dependencyType") if c in g.nodes.columns]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in facets])).alias("x")
    return g.nodes.select(each).filter("x.value IS NOT NULL").select("x.facet", "x.value").distinct()


def connection_path(g: Graph, a: str, b: str) -> DataFrame:
    """The steps of a shortest path between two nodes along edges of either direction."""
    links = _pairs(g).select(F.col("a").alias("source"), F.col("b").alias("target"))
    links = links.select(F.concat("source", F.lit("--"), "target").alias("id"), "source", "target", F.lit("link").alias("kind"))
    return traversal.shortest_path(Graph(g.nodes, links), a, b)


def connection_highlight(g: Graph, anchors: list[str]) -> DataFrame:
    """what (node, pair), a, b, role: what is lit for one anchor (its neighbours) or two (a shortest path), with start, end and path roles.

    Two anchors without a path light themselves alone; no anchor lights nothing.
    """
    spark = g.nodes.sparkSession
    schema = "what string, a string, b string, role string"
    if not anchors:
        return spark.createDataFrame([], schema)
    if len(anchors) == 1:
        near = _pairs(g).filter(F.col("a") == anchors[0])
        nodes = near.select(F.lit("node").alias("what"), F.col("b").alias("a"), F.lit("").alias("b"), F.lit(None).cast("string").alias("role"))
        pairs = near.select(F.lit("pair"), F.least("a", "b"), F.greatest("a", "b"), F.lit(None).cast("string"))
        return spark.createDataFrame([("node", anchors[0], "", "start")], schema).union(nodes).union(pairs)
    path = connection_path(g, anchors[0], anchors[1])
    role = F.when(F.col("id") == anchors[0], "start").when(F.col("id") == anchors[1], "end").otherwise("path")
    nodes = path.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit("").alias("b"), role.alias("role"))
    hops = path.select("step", F.col("id").alias("x")).join(path.select((F.col("step") - 1).alias("step"), F.col("id").alias("y")), "step")
    pairs = hops.select(F.lit("pair"), F.least("x", "y"), F.greatest("x", "y"), F.lit(None).cast("string"))
    ends = spark.createDataFrame([("node", anchors[0], "", "start"), ("node", anchors[1], "", "end")], schema)
    return nodes.union(ends).distinct().union(pairs)


def connection_status(highlight: DataFrame, a: str, b: str) -> str:
    """The sentence for two anchors."""
    steps = highlight.filter("what = 'pair'").count()
    return f"{a} ⇄ {b} · {steps} step{'' if steps == 1 else 's'}" if steps or a == b else f"No connection between {a} and {b}"


def next_anchors(before: list[str], clicked: str, shift: bool) -> list[str]:
    """The anchors after a click: one alone, with shift a second one, then a fresh start."""
    if not shift or not before or len(before) > 1:
        return [clicked]
    return before if before == [clicked] else [*before, clicked]


def prune_anchors(anchors: list[str], shown: DataFrame) -> list[str]:
    """The anchors that are still among ``shown`` (id)."""
    here = {r["id"] for r in shown.filter(F.col("id").isin(*anchors)).select("id").distinct().collect()} if anchors else set()
    return [a for a in anchors if a in here]

import pytest

from vinculum.model import Graph
from vinculum.operators import analysis, clusters, degrees, traversal, views
from vinculum.sources import exports


def graph(spark, edges, alone=()):
    ids = sorted({x for e in edges for x in e[:2]} | set(alone))
    n = spark.createDataFrame([(i, "file", i, i, 0, i, None, None) for i in ids], "id string, kind string, label string, filePath string, line int, parentFile string, environment string, dependencyType string")
    e = spark.createDataFrame([(f"{a}->{b}:import", a, b, "import", 1) for a, b in edges], "id string, source string, target string, kind string, count long")
    return Graph(n, e)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def small(spark):
    return graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], ["z"])


def test_reach_leaves_the_start_out(spark, small):
    start = spark.createDataFrame([("a",)], "id string")
    assert got(traversal.reach(small, start), "id") == [("b",), ("c",), ("d",), ("e",)]
    assert got(traversal.neighborhood(small, start, 1), "id") == [("a",), ("b",), ("c",)]


def test_scc_and_chain(small):
    assert got(traversal.scc(small), "id", "size") == [("a", 3), ("b", 3), ("c", 3), ("d", 1), ("e", 1), ("z", 1)]
    assert dict(got(traversal.longest_chain(small), "scc", "depth"))["a"] == 3


def test_paths(small):
    assert got(traversal.shortest_path(small, "a", "e"), "step", "id") == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    assert traversal.shortest_path(small, "e", "a").count() == 0


def test_communities_and_cores(spark):
    two = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")])
    assert got(traversal.communities(two), "id", "community") == [("a", 1), ("b", 1), ("c", 1), ("x", 2), ("y", 2), ("z", 2)]
    line = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], ["z"])
    assert got(traversal.coreness(line), "id", "core") == [("a", 2), ("b", 2), ("c", 2), ("d", 1), ("z", 0)]


def test_degrees_ignore_unknown_ends(spark):
    g = graph(spark, [("a", "b")])
    more = spark.createDataFrame([("a->q:import", "a", "q", "import", 1)], g.edges.schema)
    assert got(degrees.degrees(Graph(g.nodes, g.edges.union(more))), "id", "n_out") == [("a", 1), ("b", 0)]


def test_diff_and_rules(spark, small):
    other = graph(spark, [("a", "b"), ("b", "n")], ["z"])
    assert ("node", "n", "added") in got(analysis.diff(small, other), "what", "id", "status")
    found = analysis.check(small, analysis.Rules(cycle=(("c", "error", None),), max_depth=2))
    assert got(found, "rule", "subject") == [("c", "a"), ("maxDependencyDepth", "")]
    assert analysis.new_violations(found, found).count() == 0
    assert '"ruleIndex": 1' in exports.sarif(found)


def test_views(spark, small):
    assert views.file_view(small).count() == 5
    assert got(views.shape(small), "n_nodes", "n_edges", "isolated") == [(6, 5, 1)]


def test_clusters(spark, small):
    g = graph(spark, [("x/a/1", "x/b/2"), ("x/a/1", "y/3"), ("x/b/2", "y/3"), ("y/3", "4")])
    dirs = spark.createDataFrame([("x",), ("x/a",), ("none",)], "dir string")
    assert got(clusters.collapsed_nodes(g, dirs), "id", "label") == [("4", "4"), ("x#__agg__", "x · 2"), ("y/3", "y/3")]
    assert got(clusters.collapsed_edges(g, dirs), "source", "target", "n_edges") == [("x#__agg__", "y/3", 2), ("y/3", "4", 1)]
    assert clusters.tree_score(graph(spark, [("a", "b"), ("a", "c")])).first()["score"] == 1
    assert got(clusters.connection_path(small, "e", "a"), "step", "id") == [(0, "e"), (1, "d"), (2, "c"), (3, "a")]
    assert clusters.modularity(graph(spark, [], ["a"])).first()["modularity"] == 0

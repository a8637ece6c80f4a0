"""Components and chains of graphs that do not fit one task."""

import random

from pyspark.sql import functions as F

from vinculum.model import Graph
from vinculum.operators import analysis, traversal


def graph(spark, edges, alone=()):
    ids = sorted({x for e in edges for x in e} | set(alone))
    n = spark.createDataFrame([(i, "file", i, i, 0, i) for i in ids], "id string, kind string, label string, filePath string, line int, parentFile string")
    e = spark.createDataFrame([(f"{a}->{b}:import", a, b, "import", 1) for a, b in edges], "id string, source string, target string, kind string, count long")
    return Graph(n, e)


def counted(monkeypatch, *names):
    """How often each of these functions of ``traversal`` is called."""
    calls = dict.fromkeys(names, 0)

    def wrap(name, real):
        def call(*args):
            calls[name] += 1
            return real(*args)

        return call

    for name in names:
        monkeypatch.setattr(traversal, name, wrap(name, getattr(traversal, name)))
    return calls


def long_chain(spark):
    """A file's 60 symbols, each calling the next, the last a cycle of two files, and a file that both reach."""
    symbols = [f"a/x.ts#o{100 + i}" for i in range(60)]
    return graph(spark, [*zip(symbols, symbols[1:]), (symbols[-1], "b/y.ts"), ("b/y.ts", "b/z.ts"), ("b/z.ts", "b/y.ts"), ("b/z.ts", "c.ts")], ["alone"])


def test_chain_within_a_file_takes_few_rounds(spark, monkeypatch):
    g = long_chain(spark)
    monkeypatch.setattr(traversal, "LOCAL", 20)
    calls = counted(monkeypatch, "store")
    assert [tuple(r) for r in analysis.deep_chain(g).collect()] == [(62,)]
    assert calls["store"] < 40  # not a round for each symbol


def test_check_finds_components_once(spark, monkeypatch):
    g = long_chain(spark)
    monkeypatch.setattr(traversal, "LOCAL", 20)
    calls = counted(monkeypatch, "store", "_steps")
    found = analysis.check(g, analysis.Rules(cycle=(("c", "error", None),), max_depth=5))
    assert sorted((r["rule"], r["subject"], r["object"]) for r in found.collect()) == [("c", "b/y.ts", "2"), ("maxDependencyDepth", "", "62")]
    assert calls["store"] < 40 and calls["_steps"] < 2


def test_fan_out_of_busy_sources(spark):
    g = graph(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("b", "a"), ("b", "c"), ("b", "c")])
    g = Graph(g.nodes, g.edges.union(g.edges.limit(1).select("id", F.lit("b").alias("source"), F.lit("gone").alias("target"), "kind", "count")))
    for most in (-1, 0, 1, 2):
        want = analysis.degrees.degrees(g).filter(F.col("n_fan_out") > most).select("id", "n_fan_out")
        assert sorted(map(tuple, analysis.degrees.fan_out_above(g, most).collect())) == sorted(map(tuple, want.collect()))


def test_random_graphs_by_blocks(spark, monkeypatch):
    rng = random.Random(5)
    ids = [f"d{i % 4}/{i}" for i in range(30)]
    edges = {*zip(ids[:20], ids[1:20])} - {(ids[10], ids[11])} | {tuple(rng.choices(ids, k=2)) for _ in range(10)} | {(ids[3], ids[1])}
    g = graph(spark, sorted(edges), ids)
    answers = lambda: (
        sorted(map(tuple, traversal.scc(g).collect())), sorted(map(tuple, traversal.longest_chain(g).collect())), traversal.deepest(g)[1].first()[0],
    )
    whole = answers()
    assert any(size > 1 for _, _, size in whole[0]) and whole[2] == max(d for _, d in whole[1])
    monkeypatch.setattr(traversal, "LOCAL", 16)
    assert answers() == whole
    empty = Graph(g.nodes.limit(0), g.edges)
    assert traversal.deepest(empty)[1].first()[0] is None and traversal.scc(empty).count() == 0

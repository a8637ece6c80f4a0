import random

import numpy as np
import pytest

from test_wider import small
from vinculum.operators import engines, ordering, placement, scene
from vinculum.sources import workspace


def links(seed, n, m):
    r = random.Random(seed)
    ends = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
    return np.array([x for x, _ in ends], np.int64), np.array([y for _, y in ends], np.int64)


def plain_rcm(ids, edges):
    near = {i: set() for i in ids}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    rank, seen, out = (lambda i: (len(near[i]), i)), set(), []
    for seed in sorted(ids, key=rank):
        if seed in seen:
            continue
        queue = [seed]
        seen.add(seed)
        for at in queue:
            for x in sorted(near[at] - seen, key=rank):
                seen.add(x)
                queue.append(x)
        out += reversed(queue)
    return out


def test_rcm_against_a_plain_queue(spark):
    r = random.Random(3)
    edges = sorted({(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(34)})
    g = small(spark, edges)
    ids = sorted({x for e in edges for x in e})
    got = [x["id"] for x in ordering.rcm_order(g).orderBy("place").collect()]
    assert got == plain_rcm(ids, edges)


def test_places_with_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "b"), (1, "a"), (None, "a")], "part int, v string")
    got = sorted((r["part"] or 0, r["v"], r["place"]) for r in ordering.placed(df, "v", within="part").collect())
    assert got == [(0, "a", 0), (0, "b", 1), (1, "a", 0), (1, "a", 1), (1, "b", 2)]
    assert ordering.placed(df.limit(0), "v").count() == 0


def test_stable_order(spark):
    rows = [("b/x.ts", False, 3, "file"), ("a/x.ts#f", False, None, "function"), ("a/x.ts", False, None, "file"), ("z.ts", True, None, "file"), ("a/y.ts", None, 1, None)]
    df = spark.createDataFrame(rows, "id string, pinned boolean, previous int, kind string")
    got = [r["id"] for r in ordering.stable_order(df).orderBy("place").collect()]
    assert got == ["z.ts", "a/y.ts", "b/x.ts", "a/x.ts", "a/x.ts#f"]


def test_barycenter_keeps_the_place_of_nodes_without_neighbours(spark):
    layer = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, place long")
    near = spark.createDataFrame([("a", 2, 1.0), ("c", 0, 3.0), ("b", 9, 0.0)], "id string, pos long, weight double")
    got = [r["id"] for r in ordering.barycenter_order(layer, near).orderBy("place").collect()]
    assert got == ["c", "b", "a"]
    ring = spark.createDataFrame([("a", 6.2, 1.0), ("a", 0.1, 1.0), ("b", 3.0, 1.0)], "id string, angle double, weight double")
    assert [r["id"] for r in ordering.circular_order(layer, ring).orderBy("place").collect()] == ["a", "b", "c"]


def test_spectral_order_of_a_path():
    order = engines.fiedler(9, np.array([0, 2, 4, 6, 8, 1, 3, 5]), np.array([2, 4, 6, 8, 1, 3, 5, 7])).tolist()
    assert order in ([0, 2, 4, 6, 8, 1, 3, 5, 7], [7, 5, 3, 1, 8, 6, 4, 2, 0])


@pytest.mark.parametrize("engine", ["radial", "layered", "tree", "force", "stress", "backbone"])
def test_engines_place_every_node_apart_and_alike(engine):
    for seed, n, m in ((1, 30, 45), (2, 12, 80), (3, 2, 2), (4, 60, 59)):
        a, b = links(seed, n, m)
        at = engines.positions(engine, n, a, b)
        assert at.shape == (n, 2) and np.isfinite(at).all()
        assert np.array_equal(at, engines.positions(engine, n, a, b))
        free = engines.apart(at, 200, 80)
        d = np.abs(free[:, None] - free[None])
        assert not [(i, j) for i in range(n) for j in range(i) if d[i, j, 0] < 199.99 and d[i, j, 1] < 79.99]


def test_layers_go_with_the_links_of_a_dag():
    a, b = np.array([0, 0, 1, 2, 3]), np.array([1, 2, 3, 3, 4])
    assert engines.ranks(5, a, b).tolist() == [0, 1, 1, 2, 3]
    assert engines.ranks(3, np.array([0, 1, 2]), np.array([1, 2, 0])).tolist() == [0, 1, 2]
    start, flat = engines._near(5, np.array([0, 1, 2, 3]), np.array([1, 2, 0, 0]))
    assert engines.cores(5, start, flat).tolist() == [2, 2, 2, 1, 0]


def test_stress_draws_hops_as_distances():
    n = 12
    at = engines.stress(n, np.arange(n - 1), np.arange(1, n), 100.0)
    assert abs(np.hypot(*(at[0] - at[-1])) / (100.0 * (n - 1)) - 1) < 0.05


def test_score_against_all_pairs(spark):
    r = random.Random(7)
    at = {f"n{i:02}": (r.uniform(0, 900), r.uniform(0, 600)) for i in range(40)}
    edges = sorted({tuple(r.sample(sorted(at), 2)) for _ in range(60)})
    pos = spark.createDataFrame([(i, x, y, 90.0, 50.0) for i, (x, y) in at.items()], "id string, x double, y double, w double, h double")
    e = spark.createDataFrame([(s, t, 1.0) for s, t in edges], "source string, target string, weight double")

    def turn(p, q, s):
        return (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0]) > 0

    met = sum(abs(at[a][0] - at[b][0]) < 90 and abs(at[a][1] - at[b][1]) < 50 for a in at for b in at if a < b)
    cut = 0
    for i, (a, b) in enumerate(edges):
        for c, d in edges[i + 1 :]:
            if not {a, b} & {c, d}:
                p, q, s, t = at[a], at[b], at[c], at[d]
                cut += turn(s, t, p) != turn(s, t, q) and turn(p, q, s) != turn(p, q, t)
    back = sum(at[t][0] < at[s][0] for s, t in edges)
    got = placement.layout_score(pos, e, "LR").first()
    assert (got["overlaps"], got["crossings"], got["backward"]) == (met, 2.0 * cut, 2.0 * back)
    assert got["score"] == met * 100 + 20.0 * cut + 8.0 * back
    none = placement.layout_score(pos.limit(0), e.limit(0)).first()
    assert (none["overlaps"], none["crossings"], none["score"]) == (0, 0.0, 0.0)


def test_components_side_by_side_and_budgets(spark):
    g = small(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("h", "h")])
    got = {r["id"]: r for r in placement.laid_out(g, "layered").collect()}
    assert sorted(got) == ["a", "b", "c", "h", "x", "y"] and {r["engine"] for r in got.values()} == {"layered"}
    assert got["a"]["x"] < got["b"]["x"] < got["c"]["x"]
    assert {r["label"] for r in got.values()} == {"a", "h", "x"}
    boxes = spark.createDataFrame([("a", 100, 10), ("b", 300, 20), ("c", 100, 30)], "label string, width int, height int")
    assert sorted(map(tuple, placement.shelves(boxes, 10.0).collect())) == [("a", 0.0, 0.0), ("b", 0.0, 20.0), ("c", 0.0, 50.0)]
    assert placement.shelves(boxes.limit(0)).count() == 0
    rows = spark.createDataFrame([("layered", "grid", "edge-cap"), ("layered", "grid", "node-cap"), ("force", "grid", "node-cap"), ("grid", "grid", None)], "requested string, engine string, reason string")
    assert placement.fallback_summary(rows) == "Layout simplified — Layered → Grid (2 areas), Force → Grid (too large for the chosen engine)"
    assert placement.fallback_summary(rows.filter("reason IS NULL")) is None


STATE = {
    "projectPath": "/p", "selectedId": None, "expanded": {"b", "a"}, "collapsedClusters": set(), "focusedIds": {"z", "y"}, "showExternal": True, "search": "",
    **{k: {"two", "one"} for k in workspace.SWITCHES}, "algorithm": "smart", "direction": "LR", "groupBy": "dir", "density": 1, "edgeRouting": "curve", "communityCollapse": False,
}


def test_workspaces(spark, tmp_path):
    doc = workspace.capture(STATE)
    assert doc["expandedFiles"] == ["a", "b"] and doc["filters"]["enabledFolders"] == ["one", "two"]
    assert workspace.restore(workspace.parse(workspace.to_json(doc))) == STATE
    wrong = {
        "{": "Not valid JSON", "[]": "must be an object", "{}": "Missing workspace version", '{"version": 2}': "newer than supported",
        '{"version": 1}': "filters is missing", workspace.to_json(doc | {"layout": doc["layout"] | {"density": True}}): "layout.density must be a number",
        workspace.to_json(doc | {"focusedIds": [1]}): "string array or null",
    }
    for text, said in wrong.items():
        with pytest.raises(ValueError, match=said):
            workspace.parse(text)
    at = str(tmp_path / "saved")
    for name, when, what in (("one", 1, doc), ("two", 2, doc), ("one", 3, doc | {"projectPath": "/q"}), ("two", 4, None)):
        workspace.save(spark, at, name, what, when)
    assert [(r["name"], r["savedAt"]) for r in workspace.listed(spark, at).collect()] == [("one", 3)]
    assert workspace.load(spark, at, "one")["projectPath"] == "/q" and workspace.load(spark, at, "two") is None


def test_pieces_of_sources(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\r\nb\nc\n",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(workspace.source_slice(F.col("t"), 2, 9), workspace.source_slice(F.col("t"), 0, 1), workspace.source_slice(F.col("t"), 3, 2)).collect()]
    assert got == [("b\nc", "a", ""), ("", "", ""), ("", "", "")]
    assert spark.range(1).select(workspace.absolute("/r/", F.lit("a//b")), workspace.absolute("C:\\r\\", F.lit("a/b"), True)).first()[:] == ("/r/a/b", "C:\\r\\a\\b")


def test_signs_and_shapes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("external", "ecs-entity"), ("class", "ecs-entity"), ("class", None), ("odd", None)], "kind string, role string")
    got = [tuple(r) for r in df.select(scene.node_sign(F.col("kind"), F.col("role")), scene.icon_shape(F.col("kind"), F.col("role"))).collect()]
    assert got == [("↗", "arrow"), ("◉", "circle"), ("◆", "diamond"), (None, None)]
    assert scene.KIND_SIGNS.keys() == scene.KIND_SHAPES.keys() and scene.ROLE_SIGNS.keys() == scene.ROLE_SHAPES.keys()

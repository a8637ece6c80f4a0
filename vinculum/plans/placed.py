"""Queries of orders, positions, saved views and pieces of sources, with their SQL.

Engines whose positions SQL cannot give are held against what must hold of them: every node
is placed once and no two boxes overlap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.functions.storage import store
from vinculum.model import Graph, edge_id
from vinculum.operators import ordering, placement, scene
from vinculum.sources import star, workspace

Run = Callable[[SparkSession, str], DataFrame]
_ENGINES = ("grid", "circular", "radial", "layered", "tree", "force", "stress", "backbone")
_TURN = "2 * pi() *"


def _folder_graph(spark: SparkSession, d: str) -> Graph:
    """Directories, and how often what is in one uses what is in another."""
    g = star.bare_graph(spark, d)
    of = g.nodes.filter("kind <> 'external'").select("id", paths.dir_of(F.col("filePath")).alias("dir"))
    e = g.edges.join(of.toDF("source", "a"), "source").join(of.toDF("target", "b"), "target").filter("a <> b")
    e = e.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.sum("count").alias("count"))
    e = e.withColumn("kind", F.lit("import")).withColumn("id", edge_id(F.col("source"), F.col("target"), F.col("kind")))
    n = of.select(F.col("dir").alias("id")).distinct()
    return Graph(store(n.withColumn("kind", F.lit("file")).withColumn("label", F.col("id")).withColumn("filePath", F.col("id"))), store(e))


def _boxed(xy: DataFrame) -> DataFrame:
    return xy.withColumns({"w": F.lit(180.0), "h": F.lit(60.0)})


def _ringed(xy: DataFrame) -> DataFrame:
    return xy.select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    g = _folder_graph(spark, d)
    s = placement.layout_score(_boxed(_ringed(placement.circular_positions(g.nodes, 220.0))), g.edges.withColumnRenamed("count", "weight"))
    return s.select("overlaps", *[F.round(c, 3).alias(c) for c in ("crossings", "backward", "aspect", "score")])


def _all_engines(spark: SparkSession, d: str) -> DataFrame:
    g = _folder_graph(spark, d)

    def row(engine: str) -> DataFrame:
        xy = store(placement.laid_out(g, engine))
        met = placement.overlaps(_boxed(xy.select("id", (F.col("x") + 90).alias("x"), (F.col("y") + 30).alias("y"))))
        return xy.agg(F.lit(engine).alias("engine"), F.count_distinct("id").alias("nodes"), F.count("*").alias("placed")).join(met.agg(F.count("*").alias("overlapping")))

    return reduce(DataFrame.union, map(row, _ENGINES))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Files placed, files that overlap another, and directories that stick out of the one around them."""
    at, boxes = placement.nested(star.bare_graph(spark, d))
    met = placement.overlaps(_boxed(at.select("id", (F.col("x") + 90).alias("x"), (F.col("y") + 30).alias("y"))))
    up = boxes.select(F.col("dir").alias("up"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("width").alias("uw"), F.col("height").alias("uh"))
    out = boxes.filter("dir <> ''").withColumn("up", paths.dir_of(F.col("dir"))).join(up, "up").filter("x < ux OR y < uy OR x + width > ux + uw + 0.001 OR y + height > uy + uh + 0.001")
    return at.agg(F.count_distinct("id").alias("files")).join(met.agg(F.count("*").alias("overlapping"))).join(out.agg(F.count("*").alias("outside")))


def _seen_from(g: Graph) -> tuple[DataFrame, DataFrame]:
    """The nodes by id as a layer, and the places of what leads to each."""
    layer = store(ordering.placed(g.nodes.select("id"), "id"))
    return layer, g.edges.join(layer.toDF("source", "pos"), "source").select(F.col("target").alias("id"), "pos", F.col("count").alias("weight"))


def _angles(spark: SparkSession, d: str) -> DataFrame:
    layer, near = _seen_from(star.event_graph(spark, d))
    n = layer.agg(F.count("*").alias("n"))
    means = ordering.circular_means(near.join(n).select("id", (2 * F.pi() * F.col("pos") / F.col("n")).alias("angle"), "weight"))
    return means.select("id", (F.round("angle", 6) + 0.0).alias("angle"))


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    named = F.element_at(F.array(*map(F.lit, _ENGINES)), (F.pmod("o_orderkey", F.lit(8)) + 1).cast("int"))
    o = o.select("o_orderkey", named.alias("requested"), (F.col("o_custkey") % 7000).alias("nodes"), (F.col("o_orderkey") % 12000).alias("edges"))
    return o.withColumn("r", placement.within_budget(F.col("requested"), F.col("nodes"), F.col("edges"))).select("o_orderkey", "requested", "r.engine", "r.reason")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    doc = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit('{"v":'), F.col("event_id"), F.lit("}")))
    return e.select(F.concat(F.lit("u"), "user_id").alias("name"), F.col("event_id").cast("long").alias("savedAt"), doc.alias("workspace"))


def _faces(spark: SparkSession, d: str) -> DataFrame:
    """Signs and shapes of the graph's nodes; every third symbol is given a role."""
    n = star.bare_graph(spark, d).nodes
    role = F.when((F.col("kind") == "function") & (F.length("label") % 3 == 0), "ecs-system")
    return n.select("id", scene.node_sign(F.col("kind"), role).alias("sign"), scene.icon_shape(F.col("kind"), role).alias("shape"))


def queries() -> dict[str, Run]:
    bare = lambda f: lambda spark, d: f(star.bare_graph(spark, d))
    events = lambda f: lambda spark, d: f(star.event_graph(spark, d))
    return {
        "edge_weights": bare(lambda g: g.edges.select("id", F.round(placement.edge_weight(F.col("kind"), F.col("count")), 6).alias("weight"))),
        "stable_order": bare(lambda g: ordering.stable_order(g.nodes.select("id", "kind"))),
        "rcm_order": events(ordering.rcm_order),
        "fiedler_order": lambda spark, d: ordering.fiedler_order(_folder_graph(spark, d)),
        "barycenter_order": events(lambda g: ordering.barycenter_order(*_seen_from(g))),
        "circular_means": _angles,
        "circular_positions": events(lambda g: _ringed(placement.circular_positions(g.nodes, 220.0))),
        "square_positions": bare(lambda g: placement.square_positions(g.nodes, "kind")),
        "layout_engines": _all_engines,
        "layout_nested": _nested,
        "layout_score": _scored,
        "engine_budget": _budgets,
        "layout_fallbacks": lambda spark, d: placement.fallbacks(_budgets(spark, d)),
        "node_faces": _faces,
        "workspaces_saved": lambda spark, d: workspace.newest(_versions(spark, d)),
        "source_slices": lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", workspace.source_slice(F.col("html"), 2, 4).alias("piece")),
        "symbol_locations": bare(lambda g: g.nodes.select("id", workspace.symbol_path(F.col("kind"), F.col("filePath"), F.col("label")).alias("symbol"), workspace.file_location(F.col("filePath"), F.col("line")).alias("location"))),
    }


def oracle_sql() -> dict[str, str]:
    g, ev = "WITH RECURSIVE " + star.GRAPH_SQL, "WITH RECURSIVE " + star.EVENT_SQL
    pull = " ".join(f"WHEN '{k}' THEN {v}" for k, v in placement.PULL.items())
    path = "split_part(id, '#', 1)"
    folders = f"""{g}, d AS (SELECT id, regexp_extract("filePath", '^(.*)/[^/]*$', 1) AS dir FROM nodes WHERE kind <> 'external'),
p AS (SELECT dir AS id, row_number() OVER (ORDER BY dir) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT dir FROM d)),
xy AS (SELECT id, round(n * 220.0 / ({_TURN} 1) * cos({_TURN} place / n), 6) AS x, round(n * 220.0 / ({_TURN} 1) * sin({_TURN} place / n), 6) AS y FROM p),
e AS (SELECT a.dir AS source, b.dir AS target, sum("count") AS weight FROM edges JOIN d a ON a.id = source JOIN d b ON b.id = target WHERE a.dir <> b.dir GROUP BY 1, 2),
s AS (SELECT row_number() OVER () AS k, source, target, 1 + log2(1 + weight) AS imp, a.x AS a1, a.y AS a2, b.x AS b1, b.y AS b2 FROM e JOIN xy a ON a.id = source JOIN xy b ON b.id = target)"""
    side = lambda p, q, r: f"(({q}1 - {p}1) * ({r}2 - {p}2) - ({q}2 - {p}2) * ({r}1 - {p}1) > 0)"
    cross = f"SELECT coalesce(sum((u.imp + v.imp) / 2), 0) AS crossings FROM s u JOIN s v ON u.k < v.k WHERE u.source NOT IN (v.source, v.target) AND u.target NOT IN (v.source, v.target) AND {side('v.a', 'v.b', 'u.a')} <> {side('v.a', 'v.b', 'u.b')} AND {side('u.a', 'u.b', 'v.a')} <> {side('u.a', 'u.b', 'v.b')}"
    score = f"""{folders}, c AS ({cross}), o AS (SELECT count(*) AS "overlaps" FROM xy u JOIN xy v ON u.id < v.id WHERE abs(u.x - v.x) < 180 AND abs(u.y - v.y) < 60),
f AS (SELECT coalesce(sum(imp), 0) AS backward FROM s WHERE b1 < a1),
r AS (SELECT greatest(0, greatest(w / h, h / w) - 4) * 3 AS aspect FROM (SELECT greatest(1, max(x) - min(x)) AS w, greatest(1, max(y) - min(y)) AS h FROM xy))
SELECT "overlaps", round(crossings, 3) AS crossings, round(backward, 3) AS backward, round(aspect, 3)::DOUBLE AS aspect, round("overlaps" * 100 + crossings * 10 + backward * 4 + aspect, 3) AS score FROM c, o, f, r"""
    seen = f'{ev}, layer AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM nodes), near AS (SELECT target AS id, place AS pos, n, "count" AS weight FROM edges JOIN layer ON id = source)'
    caps = " ".join(f"WHEN '{k}' THEN {v}" for k, v in placement.MOST_NODES.items())
    named = "[" + ", ".join(f"'{x}'" for x in _ENGINES) + "]"
    budget = f"""WITH o AS (SELECT o_orderkey, {named}[(o_orderkey % 8 + 1)::INT] AS requested, o_custkey % 7000 AS nodes, o_orderkey % 12000 AS edges FROM orders),
c AS (SELECT *, CASE requested {caps} END AS cap FROM o),
r AS (SELECT o_orderkey, requested, CASE WHEN nodes > cap THEN 'node-cap' WHEN cap IS NOT NULL AND requested <> 'stress' AND edges > 8000 THEN 'edge-cap' WHEN requested = 'layered' AND nodes > 32 AND edges > nodes * 2.5 THEN 'edge-cap' END AS reason FROM c)"""
    engine = "CASE WHEN reason IS NULL THEN requested ELSE 'grid' END"
    listed = " UNION ALL ".join(f"SELECT '{x}' AS engine" for x in _ENGINES)
    return {
        "edge_weights": f'{g} SELECT id, round(CASE kind {pull} ELSE 1 END * log2(1 + "count"), 6) AS weight FROM edges',
        "stable_order": f"{g} SELECT id, row_number() OVER (ORDER BY regexp_extract({path}, '^(.*)/[^/]*$', 1), kind, {path}, id) - 1 AS place FROM nodes",
        "barycenter_order": f"{seen}, m AS (SELECT id, sum(pos * weight) / sum(weight) AS mean FROM near GROUP BY id) SELECT id, row_number() OVER (ORDER BY coalesce(mean, place), place) - 1 AS place FROM layer LEFT JOIN m USING (id)",
        "circular_means": f"{seen} SELECT id, round(atan2(sum(sin({_TURN} pos / n) * weight), sum(cos({_TURN} pos / n) * weight)), 6) + 0.0::DOUBLE AS angle FROM near GROUP BY id",
        "circular_positions": f"{seen} SELECT id, round(n * 220.0 / ({_TURN} 1) * cos({_TURN} place / n), 6) + 0.0::DOUBLE AS x, round(n * 220.0 / ({_TURN} 1) * sin({_TURN} place / n), 6) + 0.0::DOUBLE AS y FROM layer",
        "square_positions": f"{g}, k AS (SELECT id, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS k, ceil(sqrt(count(*) OVER (PARTITION BY kind)))::BIGINT AS c FROM nodes) SELECT id, (CASE WHEN k // c % 2 = 0 THEN k % c ELSE c - 1 - k % c END * 220.0)::DOUBLE AS x, (k // c * 90.0)::DOUBLE AS y FROM k",
        "layout_engines": f"{folders} SELECT engine, (SELECT count(*) FROM p) AS nodes, (SELECT count(*) FROM p) AS placed, 0::BIGINT AS overlapping FROM ({listed})",
        "layout_nested": f"{g} SELECT count(*) AS files, 0::BIGINT AS overlapping, 0::BIGINT AS outside FROM nodes WHERE kind = 'file'",
        "layout_score": score,
        "engine_budget": f"{budget} SELECT o_orderkey, requested, {engine} AS engine, reason FROM r",
        "layout_fallbacks": f"{budget} SELECT upper(requested[1]) || requested[2:] || ' → Grid' AS substitution, count(*) AS areas FROM r WHERE reason IS NOT NULL GROUP BY 1",
        "node_faces": f"{g} SELECT id, CASE WHEN kind = 'function' AND length(label) % 3 = 0 THEN '⚙' ELSE CASE kind WHEN 'file' THEN '▣' WHEN 'class' THEN '◆' WHEN 'interface' THEN '◇' WHEN 'function' THEN 'ƒ' WHEN 'method' THEN 'ƒ' WHEN 'component' THEN '⬡' WHEN 'external' THEN '↗' END END AS sign, CASE WHEN kind = 'function' AND length(label) % 3 = 0 THEN 'hexagon' ELSE CASE kind WHEN 'file' THEN 'doc' WHEN 'class' THEN 'diamond' WHEN 'interface' THEN 'diamond-o' WHEN 'function' THEN 'circle' WHEN 'method' THEN 'circle' WHEN 'component' THEN 'hexagon' WHEN 'external' THEN 'arrow' END END AS shape FROM nodes",
        "workspaces_saved": "WITH v AS (SELECT 'u' || user_id AS name, event_id::BIGINT AS \"savedAt\", CASE WHEN event_id % 5 <> 0 THEN '{\"v\":' || event_id || '}' END AS workspace FROM events) SELECT * FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY name ORDER BY \"savedAt\" DESC) = 1) WHERE workspace IS NOT NULL",
        "source_slices": "SELECT page_id, array_to_string(list_slice(string_split_regex(regexp_replace(coalesce(html, ''), '\\r?\\n$', ''), '\\r?\\n'), 2, 4), chr(10)) AS piece FROM pages",
        "symbol_locations": f"""{g} SELECT id, CASE WHEN kind = 'file' THEN "filePath" ELSE "filePath" || '#' || label END AS symbol, CASE WHEN line > 0 THEN "filePath" || ':' || line ELSE "filePath" END AS location FROM nodes""",
    }

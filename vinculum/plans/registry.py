"""All graph queries over the projected star schema, with DuckDB SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.model import Graph
from vinculum.operators import analysis, clusters, degrees, traversal, views
from vinculum.plans import placed, wider
from vinculum.plans.query_language import Query
from vinculum.sources import exports, files, star
from vinculum.streaming import telemetry

Run = Callable[[SparkSession, str], DataFrame]
_G = "WITH RECURSIVE " + star.GRAPH_SQL
_E = "WITH RECURSIVE " + star.EVENT_SQL

_BADGE = "CASE regexp_extract(lower(\"filePath\"), '\\.([^./]+)$', 1) WHEN 'ts' THEN 'TS' WHEN 'tsx' THEN 'TX' WHEN 'py' THEN 'PY' WHEN 'go' THEN 'GO' WHEN 'rs' THEN 'RS' WHEN 'java' THEN 'JV' ELSE 'other' END"
_VALID = """,
valid AS (SELECT e.* FROM edges e WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
deg AS (
  SELECT id, coalesce(i, 0) AS n_in, coalesce(o, 0) AS n_out, coalesce(c, 0) AS n_calls, coalesce(f, 0) AS n_fan_out FROM nodes
  LEFT JOIN (SELECT target AS id, count(*) AS i FROM valid GROUP BY 1) USING (id)
  LEFT JOIN (SELECT source AS id, count(*) AS o, count(DISTINCT target) AS f FROM valid GROUP BY 1) USING (id)
  LEFT JOIN (SELECT source AS id, count(*) AS c FROM edges WHERE kind = 'call' GROUP BY 1) USING (id))"""
_REACH = """,
back(id) AS (SELECT id FROM nodes WHERE {start} UNION SELECT e.source FROM back b JOIN edges e ON e.target = b.id),
reached AS (SELECT id FROM back WHERE id NOT IN (SELECT id FROM nodes WHERE {start}))"""
_SCC = """,
steps AS (SELECT DISTINCT source, target FROM edges WHERE source <> target AND target IN (SELECT source FROM edges)),
closure(a, b) AS (SELECT source, target FROM steps UNION SELECT c.a, s.target FROM closure c JOIN steps s ON s.source = c.b),
scc AS (
  SELECT n.id, least(n.id, coalesce(m, n.id)) AS scc FROM nodes n
  LEFT JOIN (SELECT x.a, min(x.b) AS m FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a GROUP BY x.a) ON a = n.id),
sized AS (SELECT id, scc, count(*) OVER (PARTITION BY scc) AS size FROM scc)"""

#: name -> (query text, the same condition in SQL over nodes joined with degrees)
TEXT_QUERIES = {
    "incoming": ("incoming:>5", "n_in > 5"),
    "outgoing": ("outgoing:>=3 kind:function", "n_out >= 3 AND kind = 'function'"),
    "calls": ("calls:2", "n_calls = 2"),
    "number_forms": ("incoming:>0x5 or calls:junk", "n_in > 5"),
    "empty_number": ('incoming: kind:file', "n_in = 0 AND kind = 'file'"),
    "kind": ("KIND:Class", "kind = 'class'"),
    "language": ("language:rust", "\"filePath\" LIKE '%.rs'"),
    "path": ("path:asia/**/c1*.ts", "regexp_full_match(\"filePath\", 'asia/.*/c1[^/]*\\.ts')"),
    "environment": ("env:client kind:file", "environment = 'client' AND kind = 'file'"),
    "not_environment": ("-environment:client", "coalesce(environment, '') <> 'client'"),
    "dependency": ("dep:dev | dep:undeclared", "\"dependencyType\" IN ('devDependency', 'undeclared')"),
    "text": ("s1.tsx or part7", "contains(lower(label), 's1.tsx') OR contains(\"filePath\", 's1.tsx') OR contains(label, 'part7')"),
    "quoted": ('"nation_1" -kind:file', "contains(\"filePath\", 'nation_1') AND kind <> 'file'"),
    "unknown_field": ("colour:part9", "contains(label, 'part9')"),
    "groups": ("(kind:class or kind:method) and not (outgoing:>2 | env:server)", "kind IN ('class', 'method') AND NOT (n_out > 2 OR coalesce(environment, '') = 'server')"),
    "package": ("package:nation_2", "contains(coalesce(CASE WHEN \"filePath\" <> '' THEN split_part(\"filePath\", '/', 2) END, label), 'nation_2')"),
    "runtime": ("runtime:node kind:file", "kind = 'file' AND regexp_matches(\"filePath\", '\\.(ts|go)$')"),
    "language_other": ("language:other", "\"filePath\" = ''"),
}


def _packages(g: Graph) -> DataFrame:
    own = g.nodes.select("filePath").distinct().filter("filePath <> ''")
    return own.withColumn("package", F.split_part("filePath", F.lit("/"), F.lit(2)))


def _text_query(text: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = (star.graph if text.startswith(("cycle", "depends-on")) else star.bare_graph)(spark, sf_dir)
        # scripts and Go files run on two runtimes, others on one
        two, one = (F.array(*[F.lit(x) for x in xs]) for xs in (("browser", "Node"), ("browser",)))
        g = Graph(g.nodes.withColumn("runtimes", F.when(F.col("filePath").rlike(r"\.(ts|go)\z"), two).otherwise(one)), g.edges)
        return Query(text, g, _packages(g)).node_ids()

    return run


def _on(graph, f) -> Run:
    return lambda spark, sf_dir: f(graph(spark, sf_dir))


def _start(g: Graph) -> DataFrame:
    return g.nodes.filter("label = 's1.tsx'").select("id")


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star._places(spark, sf_dir).select("dir", F.concat(F.lit("pkg:npm:"), F.split_part("dir", F.lit("/"), F.lit(2))).alias("name"))


RULES = analysis.Rules(
    dependency=(("no client to server", "error", analysis.Selector(environment=("client",)), analysis.Selector(path=("**/s*.tsx",), environment=("server",))),),
    cycle=(("no cycles", "warning", None), ("no file cycles in asia", "error", analysis.Selector(path=("asia/**",)))),
    max_fan_out=12,
    max_depth=5,
)


def _revisions(g: Graph) -> tuple[Graph, Graph]:
    key = F.regexp_extract("id", r"#o(\d+)\z", 1)

    def part(left_out: int) -> Graph:
        keep = g.nodes.filter((key == "") | (F.try_element_at(F.split(key, ""), F.lit(-1)) != str(left_out)))
        renamed = F.when(F.col("kind") == "class", F.lit("interface")).otherwise(F.col("kind")) if left_out else F.col("kind")
        return Graph(keep.withColumn("kind", renamed), Graph(keep, g.edges).valid_edges())

    return part(0), part(1)


def _path_length(g: Graph) -> DataFrame:
    ends = g.nodes.agg(F.min("id"), F.max("id")).first()
    return traversal.shortest_path(g, ends[0], ends[1]).agg(F.count("*").alias("n"))


def _connection_length(g: Graph) -> DataFrame:
    ends = g.nodes.agg(F.min("id"), F.max("id")).first()
    return clusters.connection_path(g, ends[0], ends[1]).agg(F.count("*").alias("n"))


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = star._places(spark, sf_dir).select("dir").filter("dir LIKE '%/nation_1%'")
    return inner.union(spark.range(1).select(F.lit("asia")))


def _totals(g: Graph) -> DataFrame:
    n = g.nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.union(g.edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge"), "kind", "n"))


def _lines(f) -> Callable[[Graph], DataFrame]:
    return lambda g: f(g).select("line")


def queries() -> dict[str, Run]:
    graph, stored, events = star.bare_graph, star.graph, star.event_graph
    table = lambda name: lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")
    out = {f"query_{k}": _text_query(text) for k, (text, _) in TEXT_QUERIES.items()}
    return out | {
        "graph_nodes": star.nodes,
        "graph_edges": star.edges,
        "graph_totals": _on(graph, _totals),
        "degrees": _on(graph, degrees.degrees),
        "fan_out_threshold": _on(graph, lambda g: degrees.outlier_threshold(degrees.degrees(g), "n_out").select(F.round("threshold", 6).alias("threshold"))),
        "instability": _on(graph, degrees.instability),
        "query_cycle": _text_query("cycle:true"),
        "query_not_cycle": _text_query("cycle:no kind:file"),
        "query_depends_on": _text_query("depends-on:s1.tsx kind:file"),
        "query_arrow": _on(graph, lambda g: Query("env:client -> env:server", g).edge_ids()),
        "query_induced_edges": _on(graph, lambda g: Query("kind:file path:asia/**", g).edge_ids()),
        "dependents": _on(graph, lambda g: traversal.reach(g, _start(g), forward=False).select("id")),
        "dependencies_depth_2": _on(graph, lambda g: traversal.reach(g, _start(g), True, 2).select("id")),
        "neighborhood": _on(graph, lambda g: traversal.neighborhood(g, _start(g), 1)),
        "blast_radius": _on(stored, lambda g: traversal.blast_radius(g, _start(g))),
        "shortest_path_length": _on(events, _path_length),
        "scc": _on(stored, traversal.scc),
        "event_scc": _on(events, traversal.scc),
        "components": _on(events, traversal.components),
        "communities": _on(events, traversal.communities),
        "coreness": _on(events, traversal.coreness),
        "longest_chain": _on(stored, lambda g: traversal.longest_chain(g).agg(F.max("depth").alias("depth"))),
        "deep_chain": _on(star.links_graph, analysis.deep_chain),
        "insights": _on(stored, analysis.insights),
        "rules_check": _on(stored, lambda g: analysis.check(g, RULES)),
        "diff": _on(stored, lambda g: analysis.diff(*_revisions(g))),
        "file_view": _on(graph, views.file_view),
        "symbol_counts": _on(graph, views.symbol_counts),
        "folders": _on(graph, views.folders),
        "languages": _on(graph, views.languages),
        "dir_rollup": _on(graph, views.dir_rollup),
        "auto_collapse": _on(graph, lambda g: views.auto_collapse(g, 100)),
        "packages": lambda spark, d: views.assign_packages(graph(spark, d), _manifests(spark, d)),
        "package_graph": lambda spark, d: views.package_graph(graph(spark, d), _manifests(spark, d)),
        "shape": _on(graph, views.shape),
        "collapsed_nodes": lambda spark, d: clusters.collapsed_nodes(graph(spark, d), _closed(spark, d)),
        "collapsed_edges": lambda spark, d: clusters.collapsed_edges(graph(spark, d), _closed(spark, d)),
        "tree_score": _on(graph, lambda g: clusters.tree_score(g).select(F.round("score", 6).alias("score"))),
        "modularity": _on(events, lambda g: clusters.modularity(g).select(F.round("modularity", 6).alias("modularity"), "largest_community")),
        "present_scope": _on(graph, clusters.present_scope),
        "connection_length": _on(events, _connection_length),
        "export_dot": _on(graph, _lines(exports.dot)),
        "export_graphml": _on(graph, _lines(exports.graphml)),
        "export_mermaid": _on(events, _lines(exports.mermaid)),
        "page_links": lambda spark, d: files.page_links(table("pages")(spark, d)),
        "telemetry_summary": lambda spark, d: telemetry.summary(table("events")(spark, d)),
        "telemetry_counters": lambda spark, d: telemetry.counters(table("events")(spark, d)),
    } | wider.queries() | placed.queries()


def _communities_sql(rounds: int = 20) -> str:
    out = [_E, """,
steps AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
l0 AS MATERIALIZED (SELECT id, id AS label FROM nodes)"""]  # fmt: skip
    for i in range(rounds):
        out.append(f""",
l{i + 1} AS MATERIALIZED (
  SELECT id, label FROM (
    SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS rn
    FROM (SELECT a AS id, label FROM steps JOIN l{i} ON b = l{i}.id UNION ALL SELECT id, label FROM l{i}) GROUP BY id, label) WHERE rn = 1)""")
    out.append(f"\nSELECT id, dense_rank() OVER (ORDER BY first) AS community FROM (SELECT id, min(id) OVER (PARTITION BY label) AS first FROM l{rounds})")
    return "".join(out)


def _coreness_sql(most: int = 60, rounds: int = 12) -> str:
    """For each k what is left when less than k neighbours are peeled; unrolled as one recursion over (k, round)."""
    return f"""{_E.replace("steps", "moves")},
both_ways AS (SELECT source AS a, target AS b FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target),
left_at(k, r, ids) AS (
  SELECT k, 0, (SELECT list(id ORDER BY id) FROM nodes) FROM range(1, {most}) t(k)
  UNION ALL
  SELECT k, r + 1, more FROM (
    SELECT l.k, l.r, l.ids, (
      SELECT coalesce(list(a ORDER BY a), []) FROM (SELECT a FROM both_ways WHERE list_contains(l.ids, a) AND list_contains(l.ids, b) GROUP BY a HAVING count(*) >= l.k)) AS more
    FROM left_at l WHERE len(l.ids) > 0) WHERE len(more) < len(ids) AND r < 300),
final AS (SELECT k, last(ids ORDER BY r) AS ids FROM left_at GROUP BY k)
SELECT id, (SELECT coalesce(max(k), 0) FROM final WHERE list_contains(ids, nodes.id))::INT AS core FROM nodes"""


def oracle_sql() -> dict[str, str]:
    out = {f"query_{k}": f"{_G}{_VALID}\nSELECT id FROM nodes JOIN deg USING (id) WHERE {sql}" for k, (_, sql) in TEXT_QUERIES.items()}
    start = "label = 's1.tsx'"
    folder = "split_part(\"filePath\", '/', 1)"
    hub = "(SELECT greatest(6, coalesce(avg(v) + 2 * stddev_pop(v), 6)) FROM (SELECT {c} AS v FROM deg WHERE {c} > 0))"
    inst = ", inst AS (SELECT id, sum(ca)::BIGINT AS ca, sum(ce)::BIGINT AS ce, round(sum(ce) / sum(ca + ce), 6) AS instability FROM (SELECT source AS id, 1 AS ce, 0 AS ca FROM edges WHERE kind = 'import' UNION ALL SELECT target, 0, 1 FROM edges WHERE kind = 'import') GROUP BY id)"
    depth = """,
cond AS (SELECT DISTINCT a.scc AS scc, b.scc AS t FROM edges e JOIN sized a ON a.id = e.source JOIN sized b ON b.id = e.target WHERE a.scc <> b.scc),
chains(scc, depth) AS (SELECT DISTINCT scc, 1 FROM sized UNION SELECT x.scc, c.depth + 1 FROM chains c JOIN cond x ON x.t = c.scc)"""
    closed = f", closed AS (SELECT id, CASE WHEN {folder} = 'asia' THEN 'asia' WHEN split_part(\"filePath\", '/', 2) LIKE 'nation_1%' THEN {folder} || '/' || split_part(\"filePath\", '/', 2) END AS c FROM nodes)"
    communities = _communities_sql().replace("steps AS (\n", "moves AS (\n").replace("FROM steps WHERE target IS NOT NULL", "FROM moves WHERE target IS NOT NULL")
    events = _E.replace("steps", "moves")
    links = ", links AS (SELECT source AS a, target AS b FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target)"
    return out | {
        "graph_nodes": f"{_G} SELECT * FROM nodes",
        "graph_edges": f"{_G} SELECT * FROM edges",
        "graph_totals": f"{_G} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind",
        "degrees": f"{_G}{_VALID} SELECT * FROM deg",
        "fan_out_threshold": f"{_G}{_VALID} SELECT round({hub.format(c='n_out')}, 6) AS threshold",
        "instability": f"{_G}{inst} SELECT * FROM inst",
        "query_cycle": f"{_G}{_SCC} SELECT id FROM sized WHERE size > 1",
        "query_not_cycle": f"{_G}{_SCC} SELECT id FROM sized JOIN nodes USING (id) WHERE size = 1 AND kind = 'file'",
        "query_depends_on": f"{_G}{_REACH.format(start=start)} SELECT id FROM reached JOIN nodes USING (id) WHERE kind = 'file'",
        "query_arrow": f"{_G} SELECT id FROM edges WHERE source IN (SELECT id FROM nodes WHERE environment = 'client') AND target IN (SELECT id FROM nodes WHERE environment = 'server')",
        "query_induced_edges": f"{_G}, f AS (SELECT id FROM nodes WHERE kind = 'file' AND \"filePath\" LIKE 'asia/%') SELECT id FROM edges WHERE source IN (FROM f) AND target IN (FROM f)",
        "dependents": f"{_G}{_REACH.format(start=start)} SELECT id FROM reached",
        "dependencies_depth_2": f"{_G}, s AS (SELECT id FROM nodes WHERE {start}), one AS (SELECT DISTINCT target AS id FROM edges WHERE source IN (FROM s)), two AS (SELECT id FROM one UNION SELECT target FROM edges WHERE source IN (FROM one)) SELECT id FROM two WHERE id NOT IN (FROM s)",
        "neighborhood": f"{_G}, s AS (SELECT id FROM nodes WHERE {start}) SELECT id FROM s UNION SELECT target FROM edges WHERE source IN (FROM s) UNION SELECT source FROM edges WHERE target IN (FROM s)",
        "blast_radius": f"{_G}{_REACH.format(start=start)}, hit AS (SELECT n.* FROM nodes n JOIN reached USING (id)), inside AS (SELECT id FROM hit UNION SELECT id FROM nodes WHERE {start}) "
        f"SELECT 'total' AS facet, '' AS name, count(*) AS n FROM hit UNION ALL SELECT 'package', CASE WHEN kind = 'external' THEN '«external»' WHEN contains(\"filePath\", '/') THEN {folder} ELSE '/' END, count(*) FROM hit GROUP BY 2 "
        "UNION ALL SELECT 'file', \"parentFile\", count(*) FROM hit GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM edges WHERE source IN (FROM inside) AND target IN (FROM inside) GROUP BY 2",
        "shortest_path_length": f"{_E}, walk(id, d) AS (SELECT min(id), 0 FROM nodes UNION SELECT e.target, d + 1 FROM walk w JOIN edges e ON e.source = w.id WHERE d < 12) SELECT coalesce(min(d) + 1, 0) AS n FROM walk WHERE id = (SELECT max(id) FROM nodes)",
        "scc": f"{_G}{_SCC} SELECT * FROM sized",
        "event_scc": f"{_E.replace('steps', 'moves')}{_SCC} SELECT * FROM sized",
        "components": f"{_E.replace('steps', 'moves')}, both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), cc(a, b) AS (SELECT a, b FROM both_ways UNION SELECT c.a, s.b FROM cc c JOIN both_ways s ON s.a = c.b) SELECT id, least(id, coalesce(m, id)) AS label FROM nodes LEFT JOIN (SELECT a, min(b) AS m FROM cc GROUP BY a) ON a = id",
        "communities": communities,
        "longest_chain": f"{_G}{_SCC}{depth} SELECT max(depth)::INT AS depth FROM chains",
        "deep_chain": f"{_G}{_SCC}{depth} SELECT max(depth)::INT AS depth FROM chains HAVING max(depth) >= 6",
        "rules_check": f"{_G}{_VALID}{_SCC}{depth} "
        "SELECT DISTINCT 'no client to server' AS rule, 'dependency' AS kind, 'error' AS severity, a.\"parentFile\" AS subject, b.\"parentFile\" AS object FROM edges JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE a.environment = 'client' AND b.environment = 'server' AND regexp_full_match(b.\"filePath\", '(?:.*/)?s[^/]*\\.tsx') "
        "UNION ALL SELECT DISTINCT 'no cycles', 'cycle', 'warning', scc, size::VARCHAR FROM sized WHERE size > 1 "
        "UNION ALL SELECT 'no file cycles in asia', 'cycle', 'error', scc, any_value(size)::VARCHAR FROM sized JOIN nodes USING (id) WHERE size > 1 GROUP BY scc HAVING bool_and(\"filePath\" LIKE 'asia/%') "
        "UNION ALL SELECT 'maxFanOut', 'fan-out', 'warning', id, n_fan_out::VARCHAR FROM deg WHERE n_fan_out > 12 "
        "UNION ALL SELECT 'maxDependencyDepth', 'depth', 'warning', '', max(depth)::INT::VARCHAR FROM chains HAVING max(depth) > 5",
        "diff": f"{_G}, old AS (SELECT * FROM nodes WHERE NOT regexp_matches(id, '#o\\d*0$')), new AS (SELECT * REPLACE (CASE WHEN kind = 'class' THEN 'interface' ELSE kind END AS kind) FROM nodes WHERE NOT regexp_matches(id, '#o\\d*1$')), "
        "oe AS (SELECT id FROM edges WHERE source IN (SELECT id FROM old) AND target IN (SELECT id FROM old)), ne AS (SELECT id FROM edges WHERE source IN (SELECT id FROM new) AND target IN (SELECT id FROM new)) "
        "SELECT 'node' AS what, id, CASE WHEN o.kind IS NULL THEN 'added' WHEN n.kind IS NULL THEN 'removed' ELSE 'changed' END AS status FROM old o FULL JOIN new n USING (id) WHERE o.kind IS DISTINCT FROM n.kind "
        "UNION ALL SELECT 'edge', id, 'added' FROM ne WHERE id NOT IN (FROM oe) UNION ALL SELECT 'edge', id, 'removed' FROM oe WHERE id NOT IN (FROM ne)",
        "file_view": f"{_G}, face AS (SELECT id, CASE WHEN kind = 'external' THEN id ELSE \"parentFile\" END AS f FROM nodes) SELECT a.f AS source, b.f AS target, kind, sum(\"count\")::BIGINT AS \"count\", count(*) AS n_edges FROM edges JOIN face a ON a.id = source JOIN face b ON b.id = target WHERE a.f <> b.f GROUP BY 1, 2, 3",
        "symbol_counts": f"{_G} SELECT \"parentFile\", count(*) AS n FROM nodes WHERE kind <> 'file' GROUP BY 1",
        "folders": f"{_G} SELECT {folder} AS folder, count(*) AS n FROM nodes WHERE kind = 'file' GROUP BY 1",
        "languages": f"{_G} SELECT {_BADGE} AS language, count(*) AS n FROM nodes WHERE kind = 'file' GROUP BY 1",
        "dir_rollup": f"{_G}, d AS (SELECT {folder} AS dir, 1 AS depth FROM nodes WHERE kind = 'file' UNION ALL SELECT {folder} || '/' || split_part(\"filePath\", '/', 2), 2 FROM nodes WHERE kind = 'file') SELECT dir, depth, count(*) AS n_files FROM d GROUP BY 1, 2",
        "auto_collapse": f"{_G}, f AS (SELECT {folder} AS a, {folder} || '/' || split_part(\"filePath\", '/', 2) AS b FROM nodes WHERE kind = 'file'), r AS (SELECT 1 AS depth, count(DISTINCT a) AS rendered, count(*) AS total FROM f UNION ALL SELECT 2, count(DISTINCT b), count(*) FROM f) SELECT depth, rendered FROM r WHERE total > 100 AND depth = (SELECT coalesce(max(depth) FILTER (rendered <= 100), 1) FROM r)",
        "packages": f"{_G} SELECT id, CASE WHEN kind = 'external' THEN 'pkg:ext:' || label ELSE 'pkg:npm:' || split_part(\"filePath\", '/', 2) END AS package FROM nodes",
        "package_graph": f"{_G}, p AS (SELECT id, CASE WHEN kind = 'external' THEN 'pkg:ext:' || label ELSE 'pkg:npm:' || split_part(\"filePath\", '/', 2) END AS p FROM nodes) SELECT a.p AS source, b.p AS target, 'import' AS kind, sum(\"count\")::BIGINT AS \"count\" FROM edges JOIN p a ON a.id = source JOIN p b ON b.id = target WHERE a.p <> b.p GROUP BY 1, 2",
        "shape": f"{_G}, pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target), ends AS (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs), d AS (SELECT id, count(e.id) AS d FROM nodes LEFT JOIN ends e USING (id) GROUP BY id), r AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM d) "
        "SELECT count(*) AS n_nodes, (sum(d) / 2)::BIGINT AS n_edges, round(sum(d) / count(*), 6) AS mean_degree, max(d) AS max_degree, round(2 * sum(k * d) / (count(*) * sum(d)) - (count(*) + 1) / count(*), 6) AS gini, count(*) FILTER (d = 0) AS isolated FROM r",
        "collapsed_nodes": f"{_G}{closed} SELECT id, kind, label, \"filePath\" FROM nodes JOIN closed USING (id) WHERE c IS NULL UNION ALL SELECT c || '#__agg__', 'file', split_part(c, '/', -1) || ' · ' || count(*) FILTER (NOT contains(id, '#')), c FROM closed WHERE c IS NOT NULL GROUP BY c",
        "collapsed_edges": f"{_G}{closed}, moved AS (SELECT coalesce(a.c || '#__agg__', source) AS source, coalesce(b.c || '#__agg__', target) AS target, kind, \"count\" FROM edges LEFT JOIN closed a ON a.id = source LEFT JOIN closed b ON b.id = target) SELECT source, target, kind, sum(\"count\")::BIGINT AS \"count\", count(*) AS n_edges FROM moved WHERE source <> target GROUP BY ALL",
        "tree_score": f"{_G}{_VALID}, k AS (SELECT id, coalesce(k, 0) AS k FROM nodes LEFT JOIN (SELECT target AS id, count(*) AS k FROM valid WHERE source <> target GROUP BY 1) USING (id)) SELECT round(0.6 * count(*) FILTER (k <= 1) / count(*) + 0.4 * greatest(0, 1 - abs(sum(k) - (count(*) - 1)) / count(*)), 6) AS score FROM k",
        "modularity": f"{events}{links}, com AS (SELECT * FROM ({communities})), by_c AS (SELECT x.community AS c, count(*) AS d, count(*) FILTER (x.community = y.community) AS own FROM links JOIN com x ON x.id = a JOIN com y ON y.id = b GROUP BY 1) SELECT round(sum(own) / sum(d) - sum(d * d) / (sum(d) * sum(d)), 6) AS modularity, (SELECT max(n) FROM (SELECT count(*) AS n FROM com GROUP BY community)) AS largest_community FROM by_c",
        "present_scope": f"{_G} " + " UNION ".join(f"SELECT '{c}' AS facet, \"{c}\"::VARCHAR AS value FROM nodes WHERE \"{c}\" IS NOT NULL" for c in ("kind", "environment", "dependencyType")),
        "connection_length": f"{events}{links}, walk(id, d) AS (SELECT min(id), 0 FROM nodes UNION SELECT b, d + 1 FROM walk JOIN links ON a = walk.id WHERE d < 12) SELECT coalesce(min(d) + 1, 0) AS n FROM walk WHERE id = (SELECT max(id) FROM nodes)",
        "export_dot": f"{_G} SELECT '  \"' || id || '\" [label=\"' || label || '\"];' AS line FROM nodes UNION ALL SELECT '  \"' || source || '\" -> \"' || target || '\" [label=\"' || kind || '\"];' FROM edges",
        "page_links": "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1, 2",
        "telemetry_summary": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM k WHERE rn <= 1000 GROUP BY 1",
        "telemetry_counters": "SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1",
        "coreness": _coreness_sql(),
        "export_graphml": f"{_G} SELECT '    <node id=\"' || id || '\"><data key=\"label\">' || label || '</data><data key=\"kind\">' || kind || '</data><data key=\"filePath\">' || \"filePath\" || '</data><data key=\"line\">' || line || '</data></node>' AS line FROM nodes UNION ALL SELECT '    <edge source=\"' || source || '\" target=\"' || target || '\"><data key=\"ekind\">' || kind || '</data></edge>' FROM edges",
        "export_mermaid": f"{events}, n AS (SELECT id, 'n' || (row_number() OVER (ORDER BY id) - 1) AS alias FROM nodes) SELECT '  ' || alias || '[\"' || id || '\"]' AS line FROM n UNION ALL SELECT '  ' || a.alias || ' -->|call| ' || b.alias FROM edges JOIN n a ON a.id = source JOIN n b ON b.id = target",
    } | wider.oracle_sql() | placed.oracle_sql()

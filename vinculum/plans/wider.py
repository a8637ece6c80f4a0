"""More queries over the projected schema: extraction, manifests, levels, scenes, revisions, reports; with their SQL.

The source tree is made of the tables and the SQL reads the tables alone, so what the extractor
finds in texts is held against what the texts were made from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.functions.storage import store
from vinculum.model import Graph, first_wins, merge_edges
from vinculum.operators import analysis, clusters, scene, traversal, views
from vinculum.sources import exports, extraction, files, manifests, star
from vinculum.streaming import telemetry

Run = Callable[[SparkSession, str], DataFrame]
_G = "WITH RECURSIVE " + star.GRAPH_SQL
_FILTERS = scene.Filters(external=False, kinds=("class", "function"), environments=("client",), edge_kinds=("call",), folders=("asia", "europe"), languages=("TS", "TX", "RS"))
_CLOSED_RULES = analysis.Rules(dependency=(("no client to server", "error", analysis.Selector(environment=("client",)), analysis.Selector(path=("**/s*.tsx",), environment=("server",))),), cycle=(("no cycles", "warning", None),), max_fan_out=4)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return store(star.source_files(spark, d))


def _on_files(f) -> Run:
    return lambda spark, d: f(_files(spark, d))


def _deps(spark: SparkSession, d: str) -> DataFrame:
    return manifests.package_deps(star.manifest_files(spark, d))


def _revisions(spark: SparkSession, d: str) -> tuple[Graph, Graph]:
    from vinculum.plans.registry import _revisions as two

    a, b = two(star.graph(spark, d))
    return Graph(store(a.nodes), store(a.edges)), Graph(store(b.nodes), store(b.edges))


def _opened(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'file' AND label LIKE 's1%'").select("id")


def _flat_manifests(spark: SparkSession, d: str) -> DataFrame:
    found = manifests.discover(star.manifest_files(spark, d))
    one = F.transform("declared", lambda x: F.concat_ws(":", x["name"], F.coalesce(x["version"], F.lit("")), x["type"]))
    return found.select("id", "name", "ecosystem", "dir", "manifestPath", "is_root", F.array_join(F.array_sort(one), ",").alias("declared"), "workspace")


def _level_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of the nations, with dependencies declared on the nation after and on an external part."""
    p = star._places(spark, d)
    k = F.col("n_nationkey")
    dep = lambda name: F.struct(name.alias("name"))
    declared = F.array(dep(F.concat(F.lit("nation_"), ((k + 1) % 25).cast("string"))), dep(F.concat(F.lit("part"), (k + 1).cast("string"))), dep(F.lit("nowhere")))
    name = F.concat(F.lit("pkg:npm:"), F.split_part("dir", F.lit("/"), F.lit(2)))
    return p.select("dir", name.alias("name"), declared.alias("declared"), F.when(k % 3 == 0, F.split_part("dir", F.lit("/"), F.lit(1))).alias("workspace"))


def _boxes(g: Graph) -> DataFrame:
    """A box for each directory but those whose name ends in 3: regions are wide, nations sit side by side."""
    d = views.dir_rollup(g).filter("dir NOT LIKE '%3'")
    return d.select("dir", (F.length("dir") * 40).cast("double").alias("x"), F.lit(10.0).alias("y"), F.lit(100.0).alias("width"), (F.col("n_files") * 4).cast("double").alias("height"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _round_trip(g: Graph) -> DataFrame:
    lines = exports.ndjson_lines(g)
    return exports.read_ndjson(lines, g.nodes.schema, g.edges.schema).nodes


def _with_evidence(g: Graph) -> DataFrame:
    """Edges with a piece of evidence for each time they were met."""
    one = F.struct(F.col("source").alias("filePath"), F.lit(1).alias("line"), F.lit(0).alias("column"), F.lit("projection").alias("provider"), F.lit("exact").alias("confidence"))
    n = F.least("count", F.lit(40)).cast("int")
    return g.edges.withColumn("occurrences", F.transform(F.sequence(F.lit(1), n), lambda i: one.withField("line", i))).withColumn("ord", F.xxhash64("id"))


def queries() -> dict[str, Run]:
    on = lambda f: lambda spark, d: f(star.graph(spark, d))
    once = lambda f: lambda spark, d: f(star.bare_graph(spark, d))
    events = lambda f: lambda spark, d: f(star.event_graph(spark, d))
    return {
        # extraction
        "source_paths": lambda spark, d: _files(spark, d).select("path").union(star.manifest_files(spark, d).select("path")).filter(files.is_source_path(F.col("path"))),
        "import_specifiers": _on_files(files.import_specifiers),
        "resolve_imports": _on_files(files.resolve_imports),
        "unresolved_imports": _on_files(files.unresolved_imports),
        "unresolved_insights": _on_files(lambda f: analysis.unresolved_insights(files.unresolved_imports(f).select(F.col("path").alias("sourceId"), F.col("specifier").alias("name"), F.col("path").alias("filePath"), F.lit(1).alias("line")))),
        "definitions": _on_files(lambda f: extraction.definitions(extraction.lines(f)).select("path", "kind", "name")),
        "unique_definers": _on_files(lambda f: extraction.unique_definers(extraction.definitions(extraction.lines(f))).select("name", "file")),
        "external_imports": lambda spark, d: extraction.external_imports(_files(spark, d), _deps(spark, d)),
        "file_facets": _on_files(lambda f: extraction.facets(f).select("path", "environment", F.array_join("runtimes", ",").alias("runtimes"), "has_jsx")),
        "symbol_roles": _on_files(lambda f: extraction.roles(f, extraction.definitions(extraction.lines(f)))),
        "analyzed_nodes": _on_files(lambda f: extraction.analyze(f).nodes.select("id", "kind", "label", "filePath", "parentFile")),
        "analyzed_edges": _on_files(lambda f: extraction.analyze(f).edges),
        "page_scripts": lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", extraction.script_of(F.lit("a.vue"), F.col("html")).alias("script")),
        # manifests
        "manifests": _flat_manifests,
        "package_deps": _deps,
        # levels
        "packages_declared": lambda spark, d: views.package_graph(star.bare_graph(spark, d), _level_manifests(spark, d)),
        "package_names": lambda spark, d: views.package_names(star.bare_graph(spark, d), _level_manifests(spark, d)),
        "workspaces": lambda spark, d: views.assign_workspaces(star.bare_graph(spark, d), _level_manifests(spark, d)),
        "workspace_graph": lambda spark, d: views.workspace_graph(star.bare_graph(spark, d), _level_manifests(spark, d)),
        # scene
        "scene_visible": on(lambda g: scene.visible(g, _FILTERS).nodes.select("id")),
        "scene_focus": on(lambda g: scene.visible(g, _FILTERS, focus=g.nodes.filter("label LIKE 'o1%'").select("id")).nodes.select("id")),
        "scene_query": on(lambda g: scene.visible(g, _FILTERS, query=g.nodes.filter("label LIKE 'o1%'").select("id")).edges.select("id")),
        "scene_nodes": on(lambda g: scene.scene_nodes(g, _FILTERS, _opened(g))),
        "scene_edges": on(lambda g: scene.scene_edges(g, scene.Filters(edge_kinds=("import",)), _opened(g))),
        "edge_kinds": once(lambda g: scene.edges_of_kinds(g.edges, ("call",)).select("id")),
        "view_edges": once(lambda g: scene.view_edges(g, _opened(g))),
        "node_colors": once(lambda g: g.nodes.select("id", scene.node_color(F.col("kind"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("color"))),
        "trimmed_edges": once(lambda g: scene.trimmed(_with_evidence(g), 10, 5, 2).select("id", "count", F.size("occurrences").cast("long").alias("kept"))),
        "merged_edges": once(lambda g: merge_edges(_with_evidence(g).union(_with_evidence(g))).select("id", "count", F.size("occurrences").cast("long").alias("kept"))),
        "first_wins": once(lambda g: first_wins(g.nodes.filter("label LIKE 'o%'").select(F.substr("label", F.lit(2)).cast("long").alias("ord"), "parentFile", "label"), "parentFile")),
        "internal_edges": on(lambda g: scene.internal_edges(g.edges.withColumn("weight", F.col("count") * F.when(F.col("kind") == "call", 1.0).otherwise(2.0)), g.nodes.filter("kind <> 'external'"))),
        "arborescence": on(scene.arborescence),
        "graph_shape": events(lambda g: _rounded(scene.graph_shape(g))),
        "layout_engine": events(lambda g: scene.graph_shape(g).select(scene.chosen_engine().alias("engine"), F.array_join(scene.candidate_engines(scene.chosen_engine()), ",").alias("candidates"))),
        "cluster_ancestry": once(scene.cluster_ancestry),
        "grid_positions": events(lambda g: scene.grid_positions(g, 7)),
        "lod_cut": on(lambda g: scene.lod_cut(g, _boxes(g), (0.0, 0.0, 1.0), 520.0, 400.0, 30.0, 200)),
        "fit_camera": on(lambda g: scene.fit_camera(_boxes(g), 800.0, 600.0)),
        "auto_collapse_costs": once(lambda g: views.auto_collapse(g, 400, views.symbol_counts(g).select(F.col("parentFile").alias("id"), (F.col("n") + 1).alias("cost")))),
        "connection_neighbours": events(lambda g: clusters.connection_highlight(g, [g.nodes.agg(F.min("id")).first()[0]])),
        "graph_summary": on(views.summary),
        # revisions and rules
        "diff_cycles": lambda spark, d: analysis.diff_cycles(*_revisions(spark, d)),
        "diff_blast": lambda spark, d: analysis.diff_blast(*_revisions(spark, d)),
        "diff_summary": lambda spark, d: analysis.diff_summary(*_revisions(spark, d)),
        "diff_status": lambda spark, d: analysis.status_map(*_revisions(spark, d)),
        "check_baseline": lambda spark, d: _baseline(*_revisions(spark, d)),
        "check_severities": on(lambda g: analysis.severity_counts(analysis.check(g, _CLOSED_RULES))),
        "sarif_results": on(lambda g: exports.sarif_results(analysis.check(g, _CLOSED_RULES))),
        # codecs and telemetry
        "ndjson_round_trip": on(_round_trip),
        "export_json": on(lambda g: exports.raw_json(g).select("line")),
        "telemetry_ring": lambda spark, d: telemetry.ring(spark.read.parquet(f"{d}/events.parquet"), 25),
        "telemetry_since": lambda spark, d: _since(spark.read.parquet(f"{d}/events.parquet")),
    }


def _since(events: DataFrame) -> DataFrame:
    """What came after the thousandth event's time."""
    mark = events.orderBy("ts", "event_id").limit(1000).agg(F.max("ts")).first()[0]
    return telemetry.since(events, mark).select("event_id")


def _baseline(base: Graph, head: Graph) -> DataFrame:
    return analysis.new_violations(analysis.check(head, _CLOSED_RULES), analysis.check(base, _CLOSED_RULES))


def _cycle_sql(name: str, nodes: str, edges: str) -> str:
    """name(id, members) of the cycles of a graph, from the closure of its steps."""
    return f""",
{name}_s AS (SELECT DISTINCT source, target FROM {edges} WHERE source <> target AND target IN (SELECT source FROM {edges})),
{name}_c(a, b) AS (SELECT source, target FROM {name}_s UNION SELECT c.a, s.target FROM {name}_c c JOIN {name}_s s ON s.source = c.b),
{name}_m AS (SELECT x.a AS id, least(x.a, min(x.b)) AS scc FROM {name}_c x JOIN {name}_c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
{name} AS (SELECT scc AS id, string_agg(id, ',' ORDER BY id) AS members, count(*) AS n FROM {name}_m GROUP BY scc)"""


def oracle_sql() -> dict[str, str]:
    folder = "split_part(\"filePath\", '/', 1)"
    ts = "cfile LIKE '%.ts'"
    tree = f"""{_G},
uses AS (SELECT source AS cfile, target AS sfile FROM edges WHERE kind = 'import' AND target LIKE '%.tsx'),
backs AS (SELECT source AS sfile, target AS head FROM edges WHERE kind = 'import' AND source LIKE '%.tsx'),
defs AS (
  SELECT cfile AS path, CASE WHEN cfile LIKE '%.go' OR cfile LIKE '%.rs' THEN 'struct' ELSE 'class' END AS kind, 'C' || c_custkey AS name FROM customers
  UNION ALL SELECT sfile, 'function', 'S' || s_suppkey FROM suppliers
  UNION ALL SELECT sfile, 'class', 'Widget' || s_suppkey || 'System' FROM suppliers WHERE s_suppkey % 2 = 0)"""
    found = f"""{tree}, missing AS (SELECT cfile AS path, './missing' || c_custkey AS specifier FROM customers WHERE {ts} AND c_custkey % 10 = 0)"""
    imports = f"SELECT cfile AS source, sfile AS target FROM uses WHERE {ts} UNION SELECT sfile, head FROM backs"
    eco = "['npm', 'cargo', 'go', 'python', 'maven', 'gradle'][n_nationkey % 6 + 1]"
    base = "['package.json', 'Cargo.toml', 'go.mod', 'pyproject.toml', 'pom.xml', 'settings.gradle'][n_nationkey % 6 + 1]"
    two = f"""{_G}, old AS (SELECT * FROM nodes WHERE NOT regexp_matches(id, '#o\\d*0$')),
new AS (SELECT * REPLACE (CASE WHEN kind = 'class' THEN 'interface' ELSE kind END AS kind) FROM nodes WHERE NOT regexp_matches(id, '#o\\d*1$')),
oe AS (SELECT * FROM edges WHERE source IN (SELECT id FROM old) AND target IN (SELECT id FROM old)),
ne AS (SELECT * FROM edges WHERE source IN (SELECT id FROM new) AND target IN (SELECT id FROM new)),
changed AS (
  SELECT 'node' AS what, id, CASE WHEN o.kind IS NULL THEN 'added' WHEN n.kind IS NULL THEN 'removed' ELSE 'changed' END AS status FROM old o FULL JOIN new n USING (id) WHERE o.kind IS DISTINCT FROM n.kind
  UNION ALL SELECT 'edge', id, 'added' FROM ne WHERE id NOT IN (SELECT id FROM oe) UNION ALL SELECT 'edge', id, 'removed' FROM oe WHERE id NOT IN (SELECT id FROM ne))"""
    cycles = _cycle_sql("oc", "old", "oe") + _cycle_sql("nc", "new", "ne")
    new_cycles, old_cycles = "SELECT id, members, 'new' AS status FROM nc WHERE id NOT IN (SELECT id FROM oc)", "SELECT id, members, 'removed' FROM oc WHERE id NOT IN (SELECT id FROM nc)"

    def check(n: str, e: str, c: str) -> str:
        return f"""SELECT DISTINCT 'no client to server' AS rule, 'dependency' AS kind, 'error' AS severity, a."parentFile" AS subject, b."parentFile" AS object FROM {e} JOIN {n} a ON a.id = source JOIN {n} b ON b.id = target WHERE a.environment = 'client' AND b.environment = 'server' AND regexp_full_match(b."filePath", '(?:.*/)?s[^/]*\\.tsx')
UNION ALL SELECT 'no cycles', 'cycle', 'warning', id, n::VARCHAR FROM {c}
UNION ALL SELECT 'maxFanOut', 'fan-out', 'warning', source, count(DISTINCT target)::VARCHAR FROM {e} GROUP BY source HAVING count(DISTINCT target) > 4"""

    level = """, level AS (SELECT n_nationkey, dir, 'pkg:npm:' || split_part(dir, '/', 2) AS name, CASE WHEN n_nationkey % 3 = 0 THEN split_part(dir, '/', 1) END AS workspace FROM places)"""
    package = "CASE WHEN kind = 'external' THEN 'pkg:ext:' || label ELSE 'pkg:npm:' || split_part(\"filePath\", '/', 2) END"
    between = lambda t: f"SELECT a.p AS source, b.p AS target, 'import' AS kind, sum(\"count\")::BIGINT AS \"count\" FROM edges JOIN {t} a ON a.id = source JOIN {t} b ON b.id = target WHERE a.p <> b.p GROUP BY 1, 2"
    spaces = f"{_G}{level}, w AS (SELECT id, CASE WHEN kind = 'external' THEN 'pkg:ext:' || label ELSE 'ws:' || coalesce((SELECT workspace FROM level WHERE dir = regexp_extract(\"filePath\", '^(.*)/', 1)), '«workspace»') END AS p FROM nodes)"
    seen = f"""seen AS (SELECT * FROM nodes WHERE kind <> 'external' AND {folder} IN ('asia', 'europe') AND regexp_matches("filePath", '\\.(ts|tsx|rs)$') AND (environment IS NULL OR environment = 'client') AND (kind = 'file' OR kind IN ('class', 'function')))"""
    opened = "opened AS (SELECT id FROM nodes WHERE kind = 'file' AND label LIKE 's1%')"
    face = "face AS (SELECT id, CASE WHEN kind = 'external' OR \"parentFile\" IN (SELECT id FROM opened) THEN id ELSE \"parentFile\" END AS f FROM nodes)"
    view = f"""{_G}, {opened}, {face},
view AS (
  SELECT a.f AS source, b.f AS target, kind, sum("count")::BIGINT AS "count", string_agg(edges.id, ',' ORDER BY edges.id) AS originals FROM edges JOIN face a ON a.id = source JOIN face b ON b.id = target WHERE a.f <> b.f GROUP BY 1, 2, 3
  UNION ALL SELECT "parentFile", id, 'contains', 0, '' FROM nodes WHERE kind NOT IN ('file', 'external') AND "parentFile" IN (SELECT id FROM opened))"""
    colors = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{scene.KIND_COLORS[k]}'" for k in ("file", "class", "interface", "function", "method", "component")) + " ELSE '#f87171' END"
    lang = "CASE WHEN kind = 'file' THEN CASE regexp_extract(label, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'TS' WHEN 'tsx' THEN 'TX' WHEN 'rs' THEN 'RS' WHEN 'py' THEN 'PY' WHEN 'go' THEN 'GO' WHEN 'java' THEN 'JV' END END"
    dirs = f"""d AS (SELECT {folder} AS dir, 1 AS depth, count(*) AS n FROM nodes WHERE kind = 'file' GROUP BY 1 UNION ALL SELECT {folder} || '/' || split_part("filePath", '/', 2), 2, count(*) FROM nodes WHERE kind = 'file' GROUP BY 1)"""
    links = ", links AS (SELECT source AS a, target AS b FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target)"
    ev = ("WITH RECURSIVE " + star.EVENT_SQL).replace("steps", "moves")
    evidence = "least(\"count\", 40)"
    listed = lambda kind, sev, title, nodes, sql: f"(SELECT '{kind}:' || id AS id, '{kind}' AS kind, '{sev}' AS severity, {title} AS title, {nodes} AS nodes FROM ({sql}) ORDER BY id LIMIT 50)"
    hub = "(SELECT greatest(6, coalesce(avg(v) + 2 * stddev_pop(v), 6)) FROM (SELECT {c} AS v FROM deg WHERE {c} > 0))"
    around = lambda *lists: "array_to_string(list_sort(list_distinct([id] || " + " || ".join(f"coalesce({x}, [])" for x in lists) + ")), ',')"
    two_ends = "least(source, target) || ',' || greatest(source, target)"
    insights = f"""{_G},
deg AS (
  SELECT n.id, n.label, coalesce(i, 0) AS n_in, coalesce(o, 0) AS n_out, outs, ins FROM nodes n
  LEFT JOIN (SELECT target AS id, count(*) AS i, list(DISTINCT source) AS ins FROM edges GROUP BY 1) USING (id)
  LEFT JOIN (SELECT source AS id, count(*) AS o, list(DISTINCT target) AS outs FROM edges GROUP BY 1) USING (id)),
inst AS (SELECT id, sum(ca) AS ca, sum(ce) AS ce, round(sum(ce) / sum(ca + ce), 6) AS i FROM (SELECT source AS id, 1 AS ce, 0 AS ca FROM edges WHERE kind = 'import' UNION ALL SELECT target, 0, 1 FROM edges WHERE kind = 'import') GROUP BY id),
named AS (SELECT e.*, a.label AS sl, b.label AS tl, a.environment AS se, b.environment AS te FROM edges e JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target),
hubs AS (SELECT {hub.format(c='n_out')} AS o, {hub.format(c='n_in')} AS i){_cycle_sql('cyc', 'nodes', 'edges')}
""" + "\nUNION ALL ".join([
        listed("fan-out", "info", "'High fan-out: ' || label || ' (' || n_out || ')'", around("outs"), "SELECT * FROM deg, hubs WHERE n_out >= o"),
        listed("fan-in", "info", "'High fan-in: ' || label || ' (' || n_in || ')'", around("ins"), "SELECT * FROM deg, hubs WHERE n_in >= i"),
        listed("bottleneck", "warning", "'Bottleneck: ' || label", around("outs", "ins"), "SELECT * FROM deg, hubs WHERE n_in >= i AND n_out >= o"),
        "SELECT 'orphan:all', 'orphan', 'info', count(*) || CASE WHEN count(*) = 1 THEN ' isolated node' ELSE ' isolated nodes' END, string_agg(id, ',' ORDER BY id) FROM deg WHERE n_in = 0 AND n_out = 0 HAVING count(*) > 0",
        listed("client-server", "warning", "'Client imports server: ' || sl || ' → ' || tl", two_ends, "SELECT * FROM named WHERE kind = 'import' AND se = 'client' AND te = 'server'"),
        listed("undeclared", "warning", "'Undeclared dependency: ' || label", around("ins"), "SELECT deg.* FROM deg JOIN nodes USING (id) WHERE kind = 'external' AND \"dependencyType\" = 'undeclared'"),
        "SELECT 'cycle:' || id, 'cycle', 'warning', 'Circular dependency (' || n || ' nodes)', members FROM cyc",
        listed("instability", "info", "'Stable→unstable dependency: ' || sl", two_ends, "SELECT n.* FROM named n JOIN inst a ON a.id = source JOIN inst b ON b.id = target WHERE n.kind = 'import' AND a.ca + a.ce >= 6 AND b.i - a.i > 0.3"),
    ])
    from vinculum.plans.registry import _communities_sql

    com = _communities_sql().replace("steps AS (\n", "moves AS (\n").replace("FROM steps WHERE target IS NOT NULL", "FROM moves WHERE target IS NOT NULL")
    shape = f"""{ev}{links}, com AS (SELECT * FROM ({com})), cc(a, b) AS (SELECT a, b FROM links UNION SELECT c.a, l.b FROM cc c JOIN links l ON l.a = c.b), part AS (SELECT id, least(id, coalesce(m, id)) AS p FROM nodes LEFT JOIN (SELECT a, min(b) AS m FROM cc GROUP BY a) ON a = id){_cycle_sql('cyc', 'nodes', 'edges')},
io AS (SELECT id, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(d, 0) AS d FROM nodes LEFT JOIN (SELECT target AS id, count(*) AS i FROM edges GROUP BY 1) USING (id) LEFT JOIN (SELECT source AS id, count(*) AS o FROM edges GROUP BY 1) USING (id) LEFT JOIN (SELECT a AS id, count(*) AS d FROM links GROUP BY 1) USING (id)),
rk AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM io),
by_c AS (SELECT x.community AS c, count(*) AS d, count(*) FILTER (x.community = y.community) AS own FROM links JOIN com x ON x.id = a JOIN com y ON y.id = b GROUP BY 1),
shape AS (SELECT count(*) AS node_count, sum(o)::BIGINT AS edge_count, round(sum(o) / (count(*) * (count(*) - 1)), 6) AS density, (SELECT count(DISTINCT p) FROM part) AS component_count, round(count(*) FILTER (i = 0 AND o = 0) / count(*), 6) AS isolate_ratio,
  round(count(*) FILTER (i + o = 1) / count(*), 6) AS leaf_ratio, round(count(*) FILTER (i = 0 AND o > 0) / count(*), 6) AS source_ratio, round(count(*) FILTER (o = 0 AND i > 0) / count(*), 6) AS sink_ratio, round((SELECT coalesce(sum(n), 0) FROM cyc) / count(*), 6) AS scc_node_ratio, round(1 - (SELECT coalesce(sum(n), 0) FROM cyc) / count(*), 6) AS dag_score,
  round(0.6 * count(*) FILTER (i <= 1) / count(*) + 0.4 * greatest(0, 1 - abs(sum(i) - (count(*) - 1)) / count(*)), 6) AS tree_score, (SELECT round(2 * sum(k * d) / (count(*) * sum(d)) - (count(*) + 1) / count(*), 6) FROM rk) AS degree_gini,
  round(count(*) FILTER (d > (SELECT avg(d) + 1.5 * stddev_pop(d) FROM io)) / count(*), 6) AS hub_ratio, (SELECT count(DISTINCT community) FROM com) AS community_count, (SELECT round(sum(own) / sum(d) - sum(d * d) / (sum(d) * sum(d)), 6) FROM by_c) AS modularity, round((SELECT max(n) FROM (SELECT count(*) AS n FROM com GROUP BY community)) / count(*), 6) AS largest_community_ratio FROM io)"""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '' ELSE ',\"{c.strip(chr(34))}\":\"' || {c} || '\"' END"
    node = "'    {\"id\":\"' || id || '\",\"kind\":\"' || kind || '\",\"label\":\"' || label || '\",\"filePath\":\"' || \"filePath\" || '\",\"line\":' || line || ',\"parentFile\":\"' || \"parentFile\" || '\"' || " + field("environment") + " || " + field('"dependencyType"') + " || '}' || CASE WHEN id = (SELECT max(id) FROM nodes) THEN '' ELSE ',' END"
    edge = "'    {\"id\":\"' || id || '\",\"source\":\"' || source || '\",\"target\":\"' || target || '\",\"kind\":\"' || kind || '\",\"count\":' || \"count\" || '}' || CASE WHEN id = (SELECT max(id) FROM edges) THEN '' ELSE ',' END"
    engine = "CASE WHEN edge_count = 0 OR isolate_ratio > 0.9 THEN 'grid' WHEN tree_score > 0.8 AND source_ratio > 0 THEN 'tree' WHEN dag_score > 0.8 THEN 'layered' WHEN scc_node_ratio > 0.5 AND node_count <= 40 THEN 'circular' WHEN leaf_ratio > 0.4 AND scc_node_ratio > 0.1 OR leaf_ratio > 0.3 AND hub_ratio > 0.02 AND degree_gini > 0.45 THEN 'backbone' WHEN scc_node_ratio > 0.3 AND node_count <= 400 THEN 'stress' WHEN density > 0.15 OR modularity > 0.3 AND community_count >= 3 THEN 'force' ELSE 'layered' END"
    return {
        "graph_shape": f"{shape} SELECT * FROM shape",
        "layout_engine": f"{shape}, e AS (SELECT {engine} AS engine FROM shape) SELECT engine, CASE engine WHEN 'grid' THEN 'grid' WHEN 'tree' THEN 'tree' WHEN 'circular' THEN 'circular' WHEN 'stress' THEN 'stress,force,layered' WHEN 'force' THEN 'force,stress,layered' ELSE engine || ',stress,force' END AS candidates FROM e",
        "export_json": f"{_G} SELECT unnest(['{{', '  \"nodes\": [', '  ],', '  \"edges\": [', '  ]', '}}']) AS line UNION ALL SELECT {node} FROM nodes UNION ALL SELECT {edge} FROM edges",
        "insights": insights,
        "source_paths": f"{_G} SELECT cfile AS path FROM customers UNION ALL SELECT sfile FROM suppliers UNION ALL SELECT dir || '/package.json' FROM places WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'package.json'",
        "import_specifiers": f"{found} SELECT cfile AS path, '../../' || substr(sfile, 1, length(sfile) - 4) AS specifier FROM uses WHERE {ts} UNION ALL SELECT sfile, './' || split_part(head, '/', 3) FROM backs "
        f"UNION ALL SELECT cfile, 'node:fs' FROM customers WHERE {ts} AND c_custkey % 5 = 0 UNION ALL SELECT cfile, 'part' || c_custkey % 20 || '/sub' FROM customers WHERE {ts} UNION ALL SELECT * FROM missing",
        "resolve_imports": f"{tree} {imports}",
        "unresolved_imports": f"{found} SELECT * FROM missing",
        "unresolved_insights": f"{found} SELECT 'unresolved:' || path || ':' || specifier || ':1' AS id, 'unresolved' AS kind, 'warning' AS severity, 'Unresolved import \"' || specifier || '\" in ' || path AS title, path AS nodes FROM missing ORDER BY path LIMIT 50",
        "definitions": f"{tree} SELECT path, kind, name FROM defs",
        "unique_definers": f"{tree} SELECT name, path AS file FROM defs",
        "external_imports": f"{tree} SELECT cfile AS path, 'external:module:node:fs' AS id, 'node:fs' AS label, 'node' AS \"externalKind\", NULL AS version, NULL AS \"dependencyType\" FROM customers WHERE {ts} AND c_custkey % 5 = 0 "
        f"UNION ALL SELECT cfile, 'external:module:part' || k, 'part' || k, 'npm', CASE WHEN k < 9 THEN '^' || k || '.0' WHEN k = 9 THEN '^9.1' END, CASE WHEN k < 9 THEN 'dependency' WHEN k = 9 THEN 'devDependency' ELSE 'undeclared' END FROM (SELECT cfile, c_custkey % 20 AS k FROM customers WHERE {ts})",
        "file_facets": f"{tree} SELECT cfile AS path, CASE WHEN {ts} THEN environment END AS environment, CASE WHEN {ts} AND c_custkey % 5 = 0 THEN 'node' ELSE '' END AS runtimes, false AS has_jsx FROM customers UNION ALL SELECT sfile, NULL, '', false FROM suppliers",
        "symbol_roles": f"{tree} SELECT path, name, 'ecs-system' AS role FROM defs WHERE name LIKE 'Widget%'",
        "analyzed_nodes": f"{tree} SELECT path AS id, 'file' AS kind, split_part(path, '/', 3) AS label, path AS \"filePath\", path AS \"parentFile\" FROM (SELECT DISTINCT path FROM defs) UNION ALL SELECT path || '#' || name, kind, name, path, path FROM defs",
        "analyzed_edges": f"{tree}, found AS (SELECT source, target, 'import' AS kind FROM ({imports}) UNION ALL SELECT u.cfile || '#C' || c_custkey, u.sfile || '#S' || s_suppkey, 'call' FROM uses u JOIN customers USING (cfile) JOIN suppliers USING (sfile) WHERE {ts}) SELECT source || '->' || target || ':' || kind AS id, source, target, kind, 1::BIGINT AS \"count\" FROM found",
        "page_scripts": "SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10)) AS script FROM pages",
        "manifests": f"{_G}, m AS (SELECT {eco} AS e, 'm' || n_nationkey AS name, dir, dir || '/' || {base} AS \"manifestPath\", n_nationkey AS k FROM places) SELECT e || ':' || name AS id, name, e AS ecosystem, dir, \"manifestPath\", e = 'gradle' AS is_root, "
        "CASE e WHEN 'gradle' THEN '' WHEN 'python' THEN 'd' || (k + 1) || '::dependency' ELSE 'd' || (k + 1) || ':1.' || k || ':dependency' END AS declared, 'root' AS workspace FROM m "
        "UNION ALL SELECT 'npm:root', 'root', 'npm', '', 'package.json', true, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT 'part' || i || ':^' || i || '.0:dependency' AS x FROM range(10) t(i) UNION ALL SELECT 'part9:^9.1:devDependency')), 'root'",
        "package_deps": "SELECT 'part' || i AS name, CASE WHEN i = 9 THEN '^9.1' ELSE '^' || i || '.0' END AS version, CASE WHEN i = 9 THEN 'devDependency' ELSE 'dependency' END AS type FROM range(10) t(i)",
        "packages_declared": f"{_G}{level}, p AS (SELECT id, {package} AS p FROM nodes), base AS ({between('p')}), present AS (SELECT DISTINCT p FROM p), wanted AS (SELECT name AS source, unnest(['pkg:npm:nation_' || (n_nationkey + 1) % 25, 'pkg:ext:part' || n_nationkey + 1]) AS target FROM level) "
        "SELECT * FROM base UNION ALL SELECT DISTINCT source, target, 'import', 0::BIGINT FROM wanted WHERE source <> target AND source IN (FROM present) AND target IN (FROM present) AND (source, target) NOT IN (SELECT (source, target) FROM base)",
        "package_names": f"{_G} SELECT id, CASE WHEN kind = 'external' THEN label ELSE split_part(\"filePath\", '/', 2) END AS package FROM nodes",
        "workspaces": f"{spaces} SELECT id, p AS workspace FROM w",
        "workspace_graph": f"{spaces} {between('w')}",
        "scene_visible": f"{_G}, {seen} SELECT id FROM seen",
        "scene_focus": f"{_G} SELECT id FROM nodes WHERE label LIKE 'o1%' UNION SELECT \"parentFile\" FROM nodes WHERE label LIKE 'o1%' AND kind NOT IN ('file', 'external')",
        "scene_query": f"{_G}, {seen}, q AS (SELECT id FROM seen WHERE label LIKE 'o1%') SELECT id FROM edges WHERE source IN (FROM q) AND target IN (FROM q)",
        "scene_nodes": f"{_G}, {seen}, {opened}, counts AS (SELECT \"parentFile\" AS id, count(*) AS n FROM nodes WHERE kind <> 'file' GROUP BY 1) SELECT id, kind, label, {colors} AS color, coalesce(n, 0) AS symbol_count, {lang} AS lang FROM seen LEFT JOIN counts USING (id) WHERE kind = 'file' OR \"parentFile\" IN (SELECT id FROM opened)",
        "scene_edges": f"{view} SELECT source || '->' || target || ':' || v.kind AS id, source, target, v.kind, \"count\", CASE WHEN n.kind = 'external' THEN '#f87171' WHEN v.kind = 'import' THEN '#94a3b8' ELSE '#475569' END AS color, v.kind = 'contains' AS dashed, coalesce(n.kind = 'external', false) AS to_external FROM view v LEFT JOIN nodes n ON n.id = target WHERE v.kind IN ('import', 'contains')",
        "edge_kinds": f"{_G} SELECT id FROM edges WHERE kind IN ('call', 'contains')",
        "view_edges": f"{view} SELECT source || '->' || target || ':' || kind AS id, * FROM view",
        "node_colors": f"{_G} SELECT id, {colors} AS color FROM nodes",
        "trimmed_edges": f"{_G} SELECT id, \"count\", least({evidence}, 2) AS kept FROM edges",
        "merged_edges": f"{_G} SELECT id, 2 * \"count\" AS \"count\", least(2 * {evidence}, 25) AS kept FROM edges",
        "first_wins": f"{_G} SELECT substr(label, 2)::BIGINT AS ord, \"parentFile\", label FROM nodes WHERE label LIKE 'o%' QUALIFY row_number() OVER (PARTITION BY \"parentFile\" ORDER BY substr(label, 2)::BIGINT) = 1",
        "internal_edges": f"{_G}, e AS (SELECT *, \"count\" * CASE kind WHEN 'call' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM edges WHERE source <> target AND source IN (SELECT id FROM nodes WHERE kind <> 'external') AND target IN (SELECT id FROM nodes WHERE kind <> 'external')) SELECT source, target, first(kind ORDER BY w DESC, id) AS kind, sum(\"count\")::BIGINT AS \"count\", sum(w) AS weight FROM e GROUP BY 1, 2",
        "arborescence": f"{_G}, e AS (SELECT * FROM edges WHERE source <> target), roots AS (SELECT id FROM nodes WHERE id NOT IN (SELECT target FROM e)), walk(id, d) AS (SELECT id, 0 FROM roots UNION SELECT target, d + 1 FROM walk JOIN e ON source = walk.id WHERE d < 40), depth AS (SELECT id, min(d) AS d FROM walk GROUP BY 1), "
        "best AS (SELECT target AS id, first(source ORDER BY \"count\" DESC, source) AS parent FROM e JOIN depth a ON a.id = source JOIN depth b ON b.id = target WHERE b.d = a.d + 1 GROUP BY 1) SELECT id, CASE WHEN id IN (FROM roots) THEN NULL ELSE coalesce(parent, (SELECT min(id) FROM roots)) END AS parent FROM nodes LEFT JOIN best USING (id)",
        "cluster_ancestry": f"{_G} SELECT id, CASE WHEN \"filePath\" = '' THEN '' WHEN (SELECT count(DISTINCT split_part(dir, '/', 2)) FROM places p WHERE split_part(p.dir, '/', 1) = {folder} AND p.dir IN (SELECT regexp_extract(x.\"filePath\", '^(.*)/', 1) FROM nodes x)) = 1 THEN regexp_extract(\"filePath\", '^(.*)/', 1) ELSE {folder} || ',' || regexp_extract(\"filePath\", '^(.*)/', 1) END AS clusters FROM nodes",
        "grid_positions": f"{ev}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM nodes) SELECT id, (CASE WHEN k // 7 % 2 = 0 THEN k % 7 ELSE 6 - k % 7 END * 200.0)::DOUBLE AS x, (k // 7 * 80.0)::DOUBLE AS y FROM k",
        "fit_camera": f"{_G}, {dirs}, b AS (SELECT length(dir) * 40.0 AS x, n * 4.0 AS h FROM d WHERE dir NOT LIKE '%3'), f AS (SELECT min(x) AS a, max(x) + 100 AS c, max(h) AS h FROM b), s AS (SELECT *, greatest(0.02, least(640 / greatest(1, c - a), 440 / greatest(1, h), 1.2))::DOUBLE AS scale FROM f) SELECT (400 - (a + (c - a) / 2) * scale)::DOUBLE AS x, (300 - (10 + h / 2) * scale)::DOUBLE AS y, scale FROM s",
        "auto_collapse_costs": f"{_G}, f AS (SELECT {folder} AS a, {folder} || '/' || split_part(\"filePath\", '/', 2) AS b, 1 + coalesce(c, 0) AS cost FROM nodes LEFT JOIN (SELECT \"parentFile\" AS id, count(*) AS c FROM nodes WHERE kind <> 'file' GROUP BY 1) USING (id) WHERE kind = 'file'), r AS (SELECT 1 AS depth, count(DISTINCT a) AS rendered, sum(cost) AS total FROM f UNION ALL SELECT 2, count(DISTINCT b), sum(cost) FROM f) SELECT depth, rendered::BIGINT AS rendered FROM r WHERE total > 400 AND depth = (SELECT coalesce(max(depth) FILTER (rendered <= 400), 1) FROM r)",
        "connection_neighbours": f"{ev}{links}, m AS (SELECT min(id) AS m FROM nodes) SELECT 'node' AS what, m AS a, '' AS b, 'start' AS role FROM m UNION ALL SELECT 'node', links.b, '', NULL FROM links, m WHERE links.a = m UNION ALL SELECT 'pair', least(links.a, links.b), greatest(links.a, links.b), NULL FROM links, m WHERE links.a = m",
        "graph_summary": f"{_G} SELECT 'nodes' AS what, '' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges UNION ALL SELECT 'node', kind, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY 2 UNION ALL (SELECT 'hub', target, count(*) AS n FROM edges GROUP BY 2 ORDER BY n DESC, target LIMIT 10)",
        "diff_cycles": f"{two}{cycles} {new_cycles} UNION ALL {old_cycles}",
        "diff_blast": f"{two}, ends AS (SELECT id FROM (SELECT source AS id FROM edges WHERE id IN (SELECT id FROM changed WHERE what = 'edge') UNION SELECT target FROM edges WHERE id IN (SELECT id FROM changed WHERE what = 'edge')) WHERE id IN (SELECT id FROM old) AND id IN (SELECT id FROM new)), "
        "ob(s, x) AS (SELECT id, id FROM ends UNION SELECT s, source FROM ob JOIN oe ON target = x), nb(s, x) AS (SELECT id, id FROM ends UNION SELECT s, source FROM nb JOIN ne ON target = x), b AS (SELECT s AS id, count(*) - 1 AS before FROM ob GROUP BY 1), a AS (SELECT s AS id, count(*) - 1 AS after FROM nb GROUP BY 1) "
        "SELECT id, before, after, after - before AS delta, CASE WHEN before > 0 THEN round(100 * (after - before) / before, 6) END AS pct FROM a JOIN b USING (id) WHERE before <> after ORDER BY abs(after - before) DESC, id LIMIT 20",
        "diff_summary": f"{two}{cycles}, c AS ({new_cycles} UNION ALL {old_cycles}) SELECT " + ", ".join(f"(SELECT count(*) FROM changed WHERE what = '{w}' AND status = '{s}') AS {w}s_{s}" for w, s in (("node", "added"), ("node", "removed"), ("node", "changed"), ("edge", "added"), ("edge", "removed"))) + ", (SELECT count(*) FROM c WHERE status = 'new') AS new_cycles, (SELECT count(*) FROM c WHERE status = 'removed') AS removed_cycles",
        "diff_status": f"{two} SELECT id, coalesce(status, 'unchanged') AS status FROM (SELECT id FROM old UNION SELECT id FROM new) LEFT JOIN (SELECT id, status FROM changed WHERE what = 'node') USING (id)",
        "check_baseline": f"{two}{cycles}, now AS ({check('new', 'ne', 'nc')}), before AS ({check('old', 'oe', 'oc')}) SELECT * FROM now WHERE (rule, kind, subject, object) NOT IN (SELECT (rule, kind, subject, object) FROM before)",
        "check_severities": f"{_G}{_cycle_sql('cyc', 'nodes', 'edges')}, v AS ({check('nodes', 'edges', 'cyc')}) SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM v",
        "sarif_results": f"{_G}{_cycle_sql('cyc', 'nodes', 'edges')}, v AS ({check('nodes', 'edges', 'cyc')}) SELECT rule, dense_rank() OVER (ORDER BY rule) - 1 AS rule_index, severity AS level, split_part(subject, '#', 1) AS uri, kind || ': ' || subject || ' ' || object AS message FROM v",
        "ndjson_round_trip": f"{_G} SELECT * FROM nodes",
        "telemetry_ring": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 25",
        "telemetry_since": "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM (SELECT ts FROM events ORDER BY ts, event_id LIMIT 1000))",
    }

"""A code graph projected from the star schema: the same rules in Spark and in SQL.

Customers and suppliers are files under region/nation, orders are symbols of their
customer's file, parts are external modules; lineitems and order sequences give the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.functions.storage import store
from vinculum.model import Graph, edge_id

#: Fixed values of the projection.
SEGMENT_EXT = {"BUILDING": "ts", "AUTOMOBILE": "py", "MACHINERY": "go", "HOUSEHOLD": "rs", "FURNITURE": "java"}
PRIORITY_KIND = ["class", "interface", "function", "method", "component"]
DEPENDENCY_TYPES = ["dependency", "devDependency", "peerDependency", "optionalDependency", "undeclared"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.concat(F.replace(F.lower("r_name"), F.lit(" "), F.lit("_")), F.lit("/"), F.lower("n_name")).alias("dir")
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.create_map(*[F.lit(x) for kv in SEGMENT_EXT.items() for x in kv])[F.col("c_mktsegment")]
    c = _table(spark, sf_dir, "customer").join(_places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    side = F.when(F.col("c_custkey") % 3 == 0, "client").when(F.col("c_custkey") % 3 == 1, "server")
    path = F.concat("dir", F.lit("/c"), "c_custkey", F.lit("."), ext)
    return c.select("c_custkey", "c_nationkey", path.alias("cfile"), side.alias("environment"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").join(_places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", "s_nationkey", F.concat("dir", F.lit("/s"), "s_suppkey", F.lit(".tsx")).alias("sfile"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, label, filePath, line, parentFile, environment, dependencyType; operators that go by graph order go by id."""
    none = F.lit(None).cast("string")

    def row(id_, kind, label, path, line, env, dep):
        return [id_.alias("id"), kind.alias("kind"), label.alias("label"), path.alias("filePath"), line.cast("int").alias("line"),
                path.alias("parentFile"), env.alias("environment"), dep.alias("dependencyType")]

    customers = _customers(spark, sf_dir)
    base = lambda p: F.substring_index(p, "/", -1)
    files = customers.select(*row(F.col("cfile"), F.lit("file"), base("cfile"), F.col("cfile"), F.lit(0), F.col("environment"), none))
    server = F.when(F.col("s_suppkey") % 2 == 0, "server")
    more = _suppliers(spark, sf_dir).select(*row(F.col("sfile"), F.lit("file"), base("sfile"), F.col("sfile"), F.lit(0), server, none))
    orders = _table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    kind = _pick(PRIORITY_KIND, F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    name = F.concat(F.lit("o"), "o_orderkey")
    symbols = orders.select(*row(F.concat("cfile", F.lit("#"), name), kind, name, F.col("cfile"), 1 + F.col("o_orderkey") % 500, F.col("environment"), none))
    part = F.concat(F.lit("part"), "p_partkey")
    externals = _table(spark, sf_dir, "part").select(
        *row(F.concat(F.lit("external:module:"), part), F.lit("external"), part, F.lit(""), F.lit(0), none, _pick(DEPENDENCY_TYPES, F.col("p_size") % 5))
    )
    return files.union(more).union(symbols).union(externals)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, target, kind, count."""
    customers, suppliers = _customers(spark, sf_dir), _suppliers(spark, sf_dir)
    orders = _table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.withColumn("symbol", F.concat("cfile", F.lit("#o"), "o_orderkey"))
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    sold = items.join(orders.select("o_orderkey", "symbol", "cfile"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = sold.filter("l_linenumber = 1").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))

    def links(df, source, target, kind):
        return df.select(F.col(source).alias("source"), target.alias("target"), F.lit(kind).alias("kind"))

    head = customers.groupBy("c_nationkey").agg(F.min_by("cfile", "c_custkey").alias("head"))
    following = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    every = [
        links(first, "cfile", F.col("sfile"), "import"),
        links(suppliers.join(head, F.col("s_nationkey") == F.col("c_nationkey")), "sfile", F.col("head"), "import"),
        links(first, "symbol", F.col("sfile"), "call"),
        links(sold.filter("l_linenumber = 2"), "symbol", F.concat(F.lit("external:module:part"), "l_partkey"), "import"),
        links(orders.withColumn("next", F.lead("symbol").over(following)).filter("next IS NOT NULL"), "symbol", F.col("next"), "call"),
    ]
    out = every[0]
    for e in every[1:]:
        out = out.union(e)
    out = out.groupBy("source", "target", "kind").agg(F.count("*").alias("count"))
    return out.select(edge_id(F.col("source"), F.col("target"), F.col("kind")).alias("id"), "source", "target", "kind", "count")


def bare_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The projected graph as a plan, for what reads it once."""
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The projected graph, written once a query: operators read it several times."""
    return Graph(store(nodes(spark, sf_dir)), store(edges(spark, sf_dir)))


def links_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The projected graph's ids and the ends of its edges alone, written once a query: for what looks at no facet."""
    return Graph(store(nodes(spark, sf_dir).select("id")), store(edges(spark, sf_dir).select("source", "target")))


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A small cyclic graph: what a user did next, self-transitions left out."""
    at = W.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat(F.lit("u"), F.col("user_id") % 50, F.lit("/"), "event_type")
    steps = _table(spark, sf_dir, "events").withColumn("source", node).withColumn("target", F.lead("source").over(at))
    steps = steps.filter("target IS NOT NULL AND source <> target")
    e = steps.groupBy("source", "target").agg(F.count("*").alias("count")).withColumn("kind", F.lit("call"))
    e = e.withColumn("id", edge_id(F.col("source"), F.col("target"), F.col("kind")))
    n = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return Graph(n.withColumn("kind", F.lit("file")).withColumn("label", F.col("id")).withColumn("filePath", F.col("id")), e)


#: The same projection as DuckDB common table expressions: nodes(...), edges(...).
GRAPH_SQL = """
places AS (SELECT n_nationkey, replace(lower(r_name), ' ', '_') || '/' || lower(n_name) AS dir FROM nation JOIN region ON n_regionkey = r_regionkey),
customers AS (
  SELECT c_custkey, c_nationkey, dir || '/c' || c_custkey || '.' || CASE c_mktsegment WHEN 'BUILDING' THEN 'ts' WHEN 'AUTOMOBILE' THEN 'py'
    WHEN 'MACHINERY' THEN 'go' WHEN 'HOUSEHOLD' THEN 'rs' WHEN 'FURNITURE' THEN 'java' END AS cfile,
    CASE c_custkey % 3 WHEN 0 THEN 'client' WHEN 1 THEN 'server' END AS environment
  FROM customer JOIN places ON c_nationkey = n_nationkey),
suppliers AS (SELECT s_suppkey, s_nationkey, dir || '/s' || s_suppkey || '.tsx' AS sfile FROM supplier JOIN places ON s_nationkey = n_nationkey),
symbols AS (SELECT o.*, cfile, environment, cfile || '#o' || o_orderkey AS symbol FROM orders o JOIN customers ON o_custkey = c_custkey),
nodes AS (
  SELECT cfile AS id, 'file' AS kind, split_part(cfile, '/', 3) AS label, cfile AS "filePath", 0 AS line, cfile AS "parentFile", environment, NULL::VARCHAR AS "dependencyType" FROM customers
  UNION ALL SELECT sfile, 'file', split_part(sfile, '/', 3), sfile, 0, sfile, CASE WHEN s_suppkey % 2 = 0 THEN 'server' END, NULL FROM suppliers
  UNION ALL SELECT symbol, ['class', 'interface', 'function', 'method', 'component'][substr(o_orderpriority, 1, 1)::INT], 'o' || o_orderkey, cfile,
    (1 + o_orderkey % 500)::INT, cfile, environment, NULL FROM symbols
  UNION ALL SELECT 'external:module:part' || p_partkey, 'external', 'part' || p_partkey, '', 0, '', NULL,
    ['dependency', 'devDependency', 'peerDependency', 'optionalDependency', 'undeclared'][p_size % 5 + 1] FROM part),
links AS (
  SELECT cfile AS source, sfile AS target, 'import' AS kind FROM lineitem JOIN symbols ON l_orderkey = o_orderkey JOIN suppliers ON l_suppkey = s_suppkey WHERE l_linenumber = 1
  UNION ALL SELECT sfile, head, 'import' FROM suppliers JOIN (SELECT c_nationkey, arg_min(cfile, c_custkey) AS head FROM customers GROUP BY 1) ON s_nationkey = c_nationkey
  UNION ALL SELECT symbol, sfile, 'call' FROM lineitem JOIN symbols ON l_orderkey = o_orderkey JOIN suppliers ON l_suppkey = s_suppkey WHERE l_linenumber = 1
  UNION ALL SELECT symbol, 'external:module:part' || l_partkey, 'import' FROM lineitem JOIN symbols ON l_orderkey = o_orderkey WHERE l_linenumber = 2
  UNION ALL SELECT symbol, nxt, 'call' FROM (SELECT symbol, lead(symbol) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM symbols) WHERE nxt IS NOT NULL),
edges AS (SELECT source || '->' || target || ':' || kind AS id, source, target, kind, count(*) AS "count" FROM links GROUP BY source, target, kind)
"""
EVENT_SQL = """
steps AS (
  SELECT source, lead(source) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target
  FROM (SELECT *, 'u' || user_id % 50 || '/' || event_type AS source FROM events)),
edges AS (SELECT source, target, 'call' AS kind, count(*) AS "count" FROM steps WHERE target IS NOT NULL AND source <> target GROUP BY source, target),
nodes AS (SELECT source AS id FROM edges UNION SELECT target FROM edges)
"""


#: How each language of the projection begins a class.
_CLASS = {"ts": "export class C%s {", "py": "class C%s:", "go": "type C%s struct {", "rs": "pub struct C%s {", "java": "public class C%s {"}
CLASS_KIND = {"ts": "class", "py": "class", "go": "struct", "rs": "struct", "java": "class"}


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of a source tree that says in code what the projected graph says in tables.

    Customers' files define a class that calls its suppliers' functions; those in TypeScript
    import them, a package and now and then a built-in or a file that is missing.
    """
    c, s = _customers(spark, sf_dir), _suppliers(spark, sf_dir)
    e = edges(spark, sf_dir).filter("kind = 'import'").select("source", "target")
    uses = e.join(s.select(F.col("sfile").alias("target"), F.col("s_suppkey").cast("string").alias("k")), "target")
    uses = uses.groupBy(F.col("source").alias("cfile")).agg(F.array_sort(F.collect_list(F.struct("target", "k"))).alias("uses"))
    key, ext = F.col("c_custkey").cast("string"), F.substring_index("cfile", ".", -1)
    is_ts, quote = ext == "ts", lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    bare = lambda u: F.regexp_replace(u["target"], r"\.tsx\z", "")
    none = F.array().cast("array<string>")
    imports = F.transform("uses", lambda u: F.concat(F.lit("import { S"), u["k"], F.lit(" } from "), quote(F.concat(F.lit("../../"), bare(u))), F.lit(";")))
    head = F.lit("")
    for k, v in _CLASS.items():
        head = F.when(ext == k, F.format_string(v, key)).otherwise(head)
    lines = F.concat(
        F.when(is_ts & F.col("environment").isNotNull(), F.array(F.concat(F.lit('"use '), "environment", F.lit('";')))).otherwise(none),
        F.when(is_ts & (F.col("c_custkey") % 5 == 0), F.array(F.lit('import fs from "node:fs";'))).otherwise(none),
        F.when(is_ts, F.array(F.concat(F.lit('import part from "part'), (F.col("c_custkey") % 20).cast("string"), F.lit('/sub";')))).otherwise(none),
        F.when(is_ts, F.coalesce(imports, none)).otherwise(none),
        F.when(is_ts & (F.col("c_custkey") % 10 == 0), F.array(F.concat(F.lit('import "./missing'), key, F.lit('";')))).otherwise(none),
        F.array(head), F.coalesce(F.transform("uses", lambda u: F.concat(F.lit("  S"), u["k"], F.lit("();"))), none),
    )
    customers = c.join(uses, "cfile", "left").select(F.col("cfile").alias("path"), F.array_join(lines, "\n").alias("text"))
    back = s.join(e.toDF("sfile", "head"), "sfile", "left")
    k = F.col("s_suppkey").cast("string")
    more = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("\nexport class Widget"), k, F.lit("System {}"))).otherwise("")
    link = F.coalesce(F.concat(F.lit('import { C } from "./'), F.substring_index("head", "/", -1), F.lit('";\n')), F.lit(""))
    suppliers = back.select(F.col("sfile").alias("path"), F.concat(link, F.lit("export function S"), k, F.lit("() {\n}"), more).alias("text"))
    return customers.union(suppliers)


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of a manifest for each nation, of six ecosystems in turn, and of the root's package.json."""
    p = _places(spark, sf_dir).withColumn("k", F.col("n_nationkey").cast("string")).withColumn("d", (F.col("n_nationkey") + 1).cast("string"))
    texts = [
        ("package.json", '{"name": "m%1$s", "dependencies": {"d%2$s": "1.%1$s"}}'), ("Cargo.toml", '[package]\nname = "m%1$s" # a crate\n\n[dependencies]\nd%2$s = { version = "1.%1$s", features = ["x"] }\n'),
        ("go.mod", "module m%1$s\n\nrequire (\n\td%2$s 1.%1$s // indirect\n)\n"), ("pyproject.toml", '[project]\nname = "m%1$s"\ndependencies = [\n  "d%2$s>=1.%1$s",\n]\n'),
        ("pom.xml", "<project><parent><artifactId>up</artifactId></parent><artifactId>m%1$s</artifactId><dependencies><dependency><artifactId>d%2$s</artifactId><version>1.%1$s</version></dependency></dependencies></project>"),
        ("settings.gradle", "rootProject.name = 'm%1$s'\n"),
    ]
    out = F.lit(None).cast("struct<name:string,text:string>")
    for i, (name, text) in enumerate(texts):
        out = F.when(F.col("n_nationkey") % 6 == i, F.struct(F.lit(name).alias("name"), F.format_string(text, "k", "d").alias("text"))).otherwise(out)
    rows = p.withColumn("m", out).select(F.concat("dir", F.lit("/"), "m.name").alias("path"), "m.text")
    deps = ", ".join(f'"part{i}": "^{i}.0"' for i in range(10))
    root = spark.range(1).select(F.lit("package.json").alias("path"), F.lit('{"name": "root", "workspaces": ["*/*"], "dependencies": {%s}, "devDependencies": {"part9": "^9.1"}}' % deps).alias("text"))
    return rows.union(root)

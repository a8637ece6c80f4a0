"""Graph text formats, a row per line; ``ord`` orders the lines of a file."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vinculum.model import Graph


def _quoted(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dot(g: Graph) -> DataFrame:
    node = F.format_string('  "%s" [label="%s"];', _quoted(F.col("id")), _quoted(F.col("label")))
    edge = F.format_string('  "%s" -> "%s" [label="%s"];', _quoted(F.col("source")), _quoted(F.col("target")), F.col("kind"))
    return g.nodes.select(F.lit(0).alias("part"), "id", node.alias("line")).union(g.edges.select(F.lit(1), "id", edge))


def graphml(g: Graph) -> DataFrame:
    data = "".join(f'<data key="{k}">%s</data>' for k in ("label", "kind", "filePath", "line"))
    node = F.format_string(f'    <node id="%s">{data}</node>', *[_xml(F.col(c).cast("string")) for c in ("id", "label", "kind", "filePath", "line")])
    edge = F.format_string('    <edge source="%s" target="%s"><data key="ekind">%s</data></edge>', _xml(F.col("source")), _xml(F.col("target")), F.col("kind"))
    return g.nodes.select(F.lit(0).alias("part"), "id", node.alias("line")).union(g.edges.select(F.lit(1), "id", edge))


def mermaid(g: Graph) -> DataFrame:
    """Aliases n0, n1, ... by id; edges with unknown ends are left out."""
    alias = F.concat(F.lit("n"), F.row_number().over(W.orderBy("id")) - 1)
    n = g.nodes.select("id", alias.alias("alias"), F.regexp_replace("label", r'["\[\]{}()<>|#;]', " ").alias("label"))
    e = g.edges.join(n.select(F.col("id").alias("source"), F.col("alias").alias("a")), "source")
    e = e.join(n.select(F.col("id").alias("target"), F.col("alias").alias("b")), "target")
    lines = n.select(F.lit(0).alias("part"), "id", F.format_string('  %s["%s"]', "alias", "label").alias("line"))
    return lines.union(e.select(F.lit(1), "id", F.format_string("  %s -->|%s| %s", "a", "kind", "b")))


def write_lines(lines: DataFrame, path: str, head: str = "", tail: str = "") -> None:
    """One ordered text file per range of lines, with the head and the tail as first and last lines."""
    spark = lines.sparkSession
    ends = spark.createDataFrame([(-1, "", head), (9, "", tail)], "part int, id string, line string").filter("line <> ''")
    lines.unionByName(ends).orderBy("part", "id").select("line").write.text(path)


def ndjson(g: Graph) -> DataFrame:
    n = g.nodes.select(F.lit(0).alias("part"), "id", F.to_json(F.struct(*g.nodes.columns)).alias("line"))
    return n.union(g.edges.select(F.lit(1), "id", F.to_json(F.struct(*g.edges.columns))))


def ndjson_lines(g: Graph) -> DataFrame:
    """part, id, line: a head line with the counts, then the nodes, then the edges."""
    spark = g.nodes.sparkSession
    head = json.dumps({"meta": {"nodes": g.nodes.count(), "edges": g.edges.count()}})
    return spark.createDataFrame([(-1, "", head)], "part int, id string, line string").union(ndjson(g))


def read_ndjson(lines: DataFrame, nodes: StructType, edges: StructType) -> Graph:
    """The graph of NDJSON lines (line); the head line is told by its key, edges by their ends, so lines may come in any order."""
    body = lines.filter(F.get_json_object("line", "$.meta").isNull()).withColumn("is_edge", F.get_json_object("line", "$.source").isNotNull())
    n = body.filter("NOT is_edge").select(F.from_json("line", nodes).alias("x")).select("x.*")
    return Graph(n, body.filter("is_edge").select(F.from_json("line", edges).alias("x")).select("x.*"))


def raw_json(g: Graph) -> DataFrame:
    """part, id, line: the model as one JSON document, an element a line, with separators."""
    def elements(df: DataFrame, part: int) -> DataFrame:
        last = df.agg(F.max("id")).first()[0]
        text = F.concat(F.lit("    "), F.to_json(F.struct(*df.columns)), F.when(F.col("id") == last, "").otherwise(","))
        return df.select(F.lit(part).alias("part"), "id", text.alias("line"))

    frame = g.nodes.sparkSession.createDataFrame([(0, "", "{"), (1, "", '  "nodes": ['), (3, "", "  ],"), (4, "", '  "edges": ['), (6, "", "  ]"), (7, "", "}")], "part int, id string, line string")
    return frame.union(elements(g.nodes, 2)).union(elements(g.edges, 5))


def svg(boxes: DataFrame, edges: DataFrame) -> str:
    """A drawing of placed cards (id, x, y, width, height, color, label) and edges (source, target, color), which is a picture and small."""
    held = {r["id"]: r for r in boxes.collect()}
    if not held:
        return '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 0 0"></svg>'
    x0, y0 = min(r["x"] for r in held.values()) - 32, min(r["y"] for r in held.values()) - 32
    x1, y1 = max(r["x"] + r["width"] for r in held.values()) + 32, max(r["y"] + r["height"] for r in held.values()) + 32
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{x0:g} {y0:g} {x1 - x0:g} {y1 - y0:g}">']
    middle = lambda r: (r["x"] + r["width"] / 2, r["y"] + r["height"] / 2)
    for e in edges.collect():
        if e["source"] in held and e["target"] in held:
            (ax, ay), (bx, by) = middle(held[e["source"]]), middle(held[e["target"]])
            out.append(f'  <line x1="{ax:g}" y1="{ay:g}" x2="{bx:g}" y2="{by:g}" stroke="{e["color"]}"/>')
    for r in held.values():
        out.append(f'  <rect x="{r["x"]:g}" y="{r["y"]:g}" width="{r["width"]:g}" height="{r["height"]:g}" fill="{r["color"]}"/>')
        out.append(f'  <text x="{r["x"] + 8:g}" y="{r["y"] + 20:g}">{escape(r["label"])}</text>')
    return "\n".join([*out, "</svg>"])


def html_report(title: str, counts: DataFrame, findings: DataFrame, drawing: str = "") -> str:
    """A page with counts (what, kind, n), findings (severity, title) and a drawing: a report, made at the driver."""
    rows = "".join(f"<tr><td>{r['what']}</td><td>{escape(r['kind'])}</td><td>{r['n']}</td></tr>" for r in counts.orderBy("what", "kind").collect())
    items = "".join(f'<li class="{r["severity"]}">{escape(r["title"])}</li>' for r in findings.orderBy("severity", "title").collect())
    return f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{rows}</table><ul>{items}</ul>{drawing}</body></html>"


def sarif_results(violations: DataFrame) -> DataFrame:
    """rule, rule_index (of the rules in order), level, uri, message: the results of a SARIF log."""
    from vinculum.functions.storage import store

    held = store(violations)
    names = held.select("rule").distinct()  # one row a rule
    index = names.withColumn("rule_index", (F.row_number().over(W.orderBy("rule")) - 1).cast("long"))
    text = F.concat("kind", F.lit(": "), "subject", F.lit(" "), "object")
    return held.join(index, "rule").select("rule", "rule_index", F.col("severity").alias("level"), F.substring_index("subject", "#", 1).alias("uri"), text.alias("message"))


def sarif(violations: DataFrame, tool: str = "vinculum") -> str:
    """A SARIF 2.1.0 log of a check's result, which is a report and small."""
    rows = violations.orderBy("rule", "kind", "subject", "object").collect()
    names = list(dict.fromkeys(r["rule"] for r in rows))
    results = [
        {
            "ruleId": r["rule"], "ruleIndex": names.index(r["rule"]), "level": r["severity"], "message": {"text": f"{r['kind']}: {r['subject']} {r['object']}"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["subject"].split("#")[0]}, "region": {"startLine": 1}}}],
        }
        for r in rows
    ]
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": n} for n in names]}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})

"""Insights, architecture rules and revision diffs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.functions.storage import store
from vinculum.model import Graph, with_facets
from vinculum.operators import degrees, traversal

CAP, CHAIN, SWING, BUSY = 50, 6, 0.3, 6


def _capped(df: DataFrame) -> DataFrame:
    """The first CAP findings of a kind, in graph order: a report limit."""
    return df.orderBy("ord" if "ord" in df.columns else "id").limit(CAP)


def insights(g: Graph) -> DataFrame:
    """id, kind, severity, title, nodes (ids in order, comma-joined): the detectors' findings, a row each."""
    g = Graph(with_facets(g.nodes), g.edges)
    d = store(degrees.degrees(g))
    limits = {c: degrees.outlier_threshold(d, c).first()[0] for c in ("n_in", "n_out")}
    named = g.nodes.select("id", "label")
    known = store(g.valid_edges().select("source", "target"))
    after = known.groupBy(F.col("source").alias("id")).agg(F.collect_set("target").alias("after"))
    before = known.groupBy(F.col("target").alias("id")).agg(F.collect_set("source").alias("before"))
    label = F.coalesce("label", "id")
    none = F.array().cast("array<string>")

    def found(df: DataFrame, kind: str, severity: str, title: Column, nodes: Column) -> DataFrame:
        row = F.concat(F.lit(f"{kind}:"), F.col("id")), F.lit(kind), F.lit(severity), title, F.array_join(F.array_sort(F.array_distinct(nodes)), ",")
        return df.select(*[c.alias(n) for c, n in zip(row, ("id", "kind", "severity", "title", "nodes"), strict=True)])

    def around(df: DataFrame) -> DataFrame:
        out = df.join(after, "id", "left").join(before, "id", "left").join(named, "id", "left")
        return out.withColumns({"after": F.coalesce("after", none), "before": F.coalesce("before", none)})

    out_hub, in_hub, own = F.col("n_out") >= limits["n_out"], F.col("n_in") >= limits["n_in"], F.array("id")
    counted = lambda text, n: F.concat(F.lit(f"High {text}: "), label, F.lit(" ("), F.col(n).cast("string"), F.lit(")"))
    parts = [
        found(around(_capped(d.filter(out_hub))), "fan-out", "info", counted("fan-out", "n_out"), F.concat(own, "after")),
        found(around(_capped(d.filter(in_hub))), "fan-in", "info", counted("fan-in", "n_in"), F.concat(own, "before")),
        found(around(_capped(d.filter(out_hub & in_hub))), "bottleneck", "warning", F.concat(F.lit("Bottleneck: "), label), F.concat(own, "after", "before")),
    ]
    alone = d.filter("n_in = 0 AND n_out = 0").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") > 0).withColumn("id", F.lit("all"))
    many = F.when(F.size("ids") == 1, " isolated node").otherwise(" isolated nodes")
    parts.append(found(alone, "orphan", "info", F.concat(F.size("ids").cast("string"), many), F.col("ids")))

    ends = g.edges.join(named.toDF("source", "sl"), "source").join(named.toDF("target", "tl"), "target")
    both, arrow = F.array("source", "target"), F.concat("sl", F.lit(" → "), "tl")
    side = g.nodes.select("id", "environment")
    crossing = ends.filter("kind = 'import'").join(side.toDF("source", "se"), "source").join(side.toDF("target", "te"), "target")
    crossing = _capped(crossing.filter("se = 'client' AND te = 'server'"))
    parts.append(found(crossing, "client-server", "warning", F.concat(F.lit("Client imports server: "), arrow), both))
    undeclared = _capped(g.nodes.filter("kind = 'external' AND dependencyType = 'undeclared'").select("id"))
    parts.append(found(around(undeclared), "undeclared", "warning", F.concat(F.lit("Undeclared dependency: "), label), F.concat(own, "before")))
    cyclic = traversal.scc(g).filter("size > 1").groupBy(F.col("scc").alias("id")).agg(F.collect_list(F.col("id")).alias("ids"))
    parts.append(found(cyclic, "cycle", "warning", F.concat(F.lit("Circular dependency ("), F.size("ids").cast("string"), F.lit(" nodes)")), F.col("ids")))

    i = store(degrees.instability(g).withColumn("degree", F.col("ca") + F.col("ce")))
    e = ends.filter("kind = 'import'").join(i.filter(F.col("degree") >= BUSY).select(F.col("id").alias("source"), F.col("instability").alias("si")), "source")
    e = e.join(i.select(F.col("id").alias("target"), F.col("instability").alias("ti")), "target")
    swing = _capped(e.filter(F.col("ti") - F.col("si") > SWING))
    parts.append(found(swing, "instability", "info", F.concat(F.lit("Stable→unstable dependency: "), "sl"), both))
    if "occurrences" in g.edges.columns:
        unclear = _capped(ends.filter(F.exists("occurrences", lambda x: x["confidence"] == "ambiguous")))
        parts.append(found(unclear, "ambiguous", "warning", F.concat(F.lit("Ambiguous "), "kind", F.lit(": "), arrow), both))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def unresolved_insights(refs: DataFrame) -> DataFrame:
    """Findings of unresolved references (sourceId, name, filePath, line): the first CAP by file and line."""
    first = refs.orderBy("filePath", "line", "name").limit(CAP)
    return first.select(
        F.concat_ws(":", F.lit("unresolved"), "sourceId", "name", F.col("line").cast("string")).alias("id"), F.lit("unresolved").alias("kind"),
        F.lit("warning").alias("severity"), F.concat(F.lit('Unresolved import "'), "name", F.lit('" in '), "filePath").alias("title"), F.col("sourceId").alias("nodes"),
    )


def deep_chain(g: Graph) -> DataFrame:
    """One row, if the longest chain has at least CHAIN nodes: depth."""
    return traversal.deepest(g)[1].filter(F.col("depth") >= CHAIN)


# --- rules ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Selector:
    """Facets are ANDed, values within one ORed; a node without the facet does not match."""

    path: tuple[str, ...] = ()
    kind: tuple[str, ...] = ()
    environment: tuple[str, ...] = ()
    role: tuple[str, ...] = ()
    category: tuple[str, ...] = ()

    def column(self, prefix: str = "") -> Column:
        tests = [F.lit(True)]
        if self.path:
            tests.append(F.col(f"{prefix}filePath").rlike("|".join(paths.rule_glob(x) for x in self.path)))
        for name in ("kind", "environment", "role", "category"):
            if getattr(self, name):
                tests.append(F.col(f"{prefix}{name}").isin(*getattr(self, name)))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Rules:
    """dependency: (name, severity, from, disallow); cycle: (name, severity, scope or None)."""

    dependency: tuple = ()
    cycle: tuple = ()
    max_fan_out: int | None = None
    max_depth: int | None = None
    severity: str = field(default="warning")


def check(g: Graph, rules: Rules) -> DataFrame:
    """rule, kind, severity, subject, object of each violation; the triple (rule, subject, object) is its fingerprint."""
    rows: list[DataFrame] = []
    g = Graph(with_facets(g.nodes), g.edges)

    def add(df: DataFrame, rule: str, kind: str, severity: str) -> None:
        rows.append(df.select(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "subject", "object"))

    for name, severity, source, target in rules.dependency:
        a = g.nodes.filter(source.column()).select(F.col("id").alias("source"), F.col("parentFile").alias("subject"))
        b = g.nodes.filter(target.column()).select(F.col("id").alias("target"), F.col("parentFile").alias("object"))
        add(g.edges.join(a, "source").join(b, "target").select("subject", "object").distinct(), name, "dependency", severity)
    of = chain = None
    if rules.max_depth is not None:
        of, chain = traversal.deepest(g)
    if rules.cycle:
        of = (traversal.scc(g) if of is None else of).filter("size > 1")
        for name, severity, scope in rules.cycle:
            hit = of
            if scope is not None:
                inside = of.join(g.nodes.filter(scope.column()).select("id"), "id", "left_semi").groupBy("scc").agg(F.count("*").alias("n"))
                hit = of.join(inside, "scc").filter("n = size")
            add(hit.select(F.col("scc").alias("subject"), F.col("size").cast("string").alias("object")).distinct(), name, "cycle", severity)
    if rules.max_fan_out is not None:
        wide = degrees.fan_out_above(g, rules.max_fan_out)
        add(wide.select(F.col("id").alias("subject"), F.col("n_fan_out").cast("string").alias("object")), "maxFanOut", "fan-out", rules.severity)
    if rules.max_depth is not None:
        deep = chain.filter(F.col("depth") > rules.max_depth)
        add(deep.select(F.lit("").alias("subject"), F.col("depth").cast("string").alias("object")), "maxDependencyDepth", "depth", rules.severity)
    if not rows:
        return g.nodes.sparkSession.createDataFrame([], "rule string, kind string, severity string, subject string, object string")
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def severity_counts(violations: DataFrame) -> DataFrame:
    """One row: errors, warnings."""
    return violations.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def new_violations(now: DataFrame, baseline: DataFrame) -> DataFrame:
    return now.join(baseline.select("rule", "kind", "subject", "object"), ["rule", "kind", "subject", "object"], "left_anti")


# --- diff ----------------------------------------------------------------------------------

COMPARED = ("kind", "label", "role", "environment", "category")


def diff(base: Graph, head: Graph) -> DataFrame:
    """what (node, edge), id, status (added, removed, changed): moved lines and edge counts are no change."""
    fields = [c for c in COMPARED if c in base.nodes.columns and c in head.nodes.columns]
    old = base.nodes.select("id", F.struct(*fields).alias("old"))
    new = head.nodes.select("id", F.struct(*fields).alias("new"))
    n = old.join(new, "id", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    nodes = n.withColumn("status", status).filter("status IS NOT NULL").select(F.lit("node").alias("what"), "id", "status")
    a, b = base.edges.select("id").distinct(), head.edges.select("id").distinct()
    added = b.join(a, "id", "left_anti").select(F.lit("edge"), "id", F.lit("added"))
    return nodes.union(added).union(a.join(b, "id", "left_anti").select(F.lit("edge"), "id", F.lit("removed")))


def _cycles(g: Graph) -> DataFrame:
    """id (least member), members (in order, comma-joined) of components of more than one node."""
    found = traversal.scc(g).filter("size > 1").groupBy(F.col("scc").alias("cycle")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))
    return found.withColumnRenamed("cycle", "id")


def diff_cycles(base: Graph, head: Graph) -> DataFrame:
    """id, members, status (new, removed): cycles by their least member."""
    a, b = store(_cycles(base)), store(_cycles(head))
    new = b.join(a.select("id"), "id", "left_anti").withColumn("status", F.lit("new"))
    return new.union(a.join(b.select("id"), "id", "left_anti").withColumn("status", F.lit("removed")))


def diff_blast(base: Graph, head: Graph, cap: int = 20) -> DataFrame:
    """id, before, after, delta, pct: the largest changes of what depends on the ends of changed edges, a report limit.

    Only nodes of both revisions are compared; pct is null where nothing depended before.
    """
    changed = diff(base, head).filter("what = 'edge'").select("id")
    e = base.edges.select("id", "source", "target").union(head.edges.select("id", "source", "target")).join(changed, "id", "left_semi")
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    ends = store(ends.join(base.nodes.select("id"), "id", "left_semi").join(head.nodes.select("id"), "id", "left_semi"))
    a, b = traversal.reached_by_each(base, ends).toDF("id", "before"), traversal.reached_by_each(head, ends).toDF("id", "after")
    out = a.join(b, "id").filter("before <> after").withColumn("delta", F.col("after") - F.col("before"))
    out = out.withColumn("pct", F.when(F.col("before") > 0, F.round(100 * F.col("delta") / F.col("before"), 6)))
    return out.orderBy(F.desc(F.abs("delta")), "id").limit(cap)


def diff_summary(base: Graph, head: Graph) -> DataFrame:
    """One row: counts of added, removed and changed nodes, added and removed edges, new and removed cycles."""
    d, c = diff(base, head), diff_cycles(base, head).groupBy().agg(F.count_if(F.col("status") == "new").alias("new_cycles"), F.count_if(F.col("status") == "removed").alias("removed_cycles"))
    n = lambda what, status: F.count_if((F.col("what") == what) & (F.col("status") == status)).alias(f"{what}s_{status}")
    counts = d.agg(n("node", "added"), n("node", "removed"), n("node", "changed"), n("edge", "added"), n("edge", "removed"))
    return counts.join(c)  # both sides are one row


def status_map(base: Graph, head: Graph) -> DataFrame:
    """id, status of every node of either revision."""
    changed = diff(base, head).filter("what = 'node'").select("id", "status")
    every = base.nodes.select("id").union(head.nodes.select("id")).distinct()
    return every.join(changed, "id", "left").select("id", F.coalesce("status", F.lit("unchanged")).alias("status"))


def diff_report(summary: DataFrame, blast: DataFrame, base: str, head: str) -> str:
    """The text of a diff: counts, cycles, and the largest changes of 10 % or more (five at most)."""
    s, out = summary.first(), [f"{'Current branch' if head == 'working tree' else head} ↔ {base}", ""]
    out += [f"+ {s['nodes_added']} nodes", f"- {s['nodes_removed']} nodes"]
    out += [f"~ {s['nodes_changed']} changed nodes"] if s["nodes_changed"] else []
    out += [f"+ {s['edges_added']} relationships", f"- {s['edges_removed']} relationships"]
    plural = lambda n: "" if n == 1 else "s"
    out += [f"⚠ {s['new_cycles']} new cycle{plural(s['new_cycles'])}"] if s["new_cycles"] else []
    out += [f"✓ {s['removed_cycles']} cycle{plural(s['removed_cycles'])} resolved"] if s["removed_cycles"] else []
    for r in [r for r in blast.collect() if r["pct"] is None or abs(r["pct"]) >= 10][:5]:
        change = f"{'increased' if r['delta'] > 0 else 'decreased'} by {abs(round(r['pct']))}%" if r["pct"] is not None else "appeared"
        out.append(f"{'⚠' if r['delta'] > 0 else '✓'} {r['id']} blast radius {change} ({r['before']} → {r['after']})")
    if not any(s[c] for c in ("nodes_added", "nodes_removed", "nodes_changed", "edges_added", "edges_removed")):
        out += ["", "No structural changes."]
    return "\n".join(out) + "\n"


def check_report(violations: DataFrame, rules: list[str], root: str, n_files: int, baseline: str | None = None) -> str:
    """The text of a check: every rule, with ten violations at most."""
    by: dict[str, list] = {}
    for r in violations.orderBy("rule", "subject", "object").collect():
        by.setdefault(r["rule"], []).append(r)
    out = [f"check · {root} · {n_files} files"] + ([f"baseline: {baseline} (reporting new violations only)"] if baseline else []) + [""]
    for name in [*rules, *(x for x in by if x not in rules)]:
        hits = by.get(name, [])
        if not hits:
            out.append(f"✓ {name}")
            continue
        out.append(f"{'✗' if hits[0]['severity'] == 'error' else '⚠'} {name} ({hits[0]['severity']}) — {len(hits)} violation{'' if len(hits) == 1 else 's'}")
        out += [f"    {r['subject']} → {r['object']}" for r in hits[:10]]
        out += [f"    … and {len(hits) - 10} more"] if len(hits) > 10 else []
    return "\n".join(out) + "\n"

"""Projections: file view, folder and language counts, packages, workspaces, directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.model import Graph


def faces(g: Graph, expanded: DataFrame | None = None) -> DataFrame:
    """id, face: the card that stands for a node; its file, or itself if it is external or its file is ``expanded`` (id)."""
    files = g.nodes.select("id", F.when(F.col("kind") == "external", F.col("id")).otherwise(F.col("parentFile")).alias("face"))
    if expanded is not None:
        open_ = expanded.select(F.col("id").alias("face"), F.lit(True).alias("open"))
        files = files.join(open_, "face", "left").select("id", F.when(F.col("open"), F.col("id")).otherwise(F.col("face")).alias("face"))
    return files


def file_view(g: Graph, expanded: DataFrame | None = None) -> DataFrame:
    """source, target, kind, count, n_edges: symbols stand for their files unless these are expanded.

    ``expanded`` (id) adds ``contains`` edges from its files to their symbols.
    """
    files = faces(g, expanded)
    e = g.edges.join(files.toDF("source", "a"), "source").join(files.toDF("target", "b"), "target").filter("a <> b")
    out = e.groupBy(F.col("a").alias("source"), F.col("b").alias("target"), "kind").agg(F.sum("count").alias("count"), F.count("*").alias("n_edges"))
    if expanded is not None:
        inner = g.nodes.filter("kind NOT IN ('file', 'external')").join(expanded.select(F.col("id").alias("parentFile")), "parentFile", "left_semi")
        out = out.union(inner.select("parentFile", "id", F.lit("contains"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    return out


def symbol_counts(g: Graph) -> DataFrame:
    return g.nodes.filter("kind <> 'file'").groupBy("parentFile").agg(F.count("*").alias("n"))


def folders(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'file'").groupBy(paths.top_folder(F.col("filePath")).alias("folder")).agg(F.count("*").alias("n"))


def languages(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'file'").groupBy(paths.language(F.col("filePath")).alias("language")).agg(F.count("*").alias("n"))


def dir_rollup(g: Graph) -> DataFrame:
    """dir, depth, n_files below it."""
    d = g.nodes.filter("kind = 'file'").select(F.posexplode(paths.dir_prefixes(F.col("filePath"))).alias("at", "dir"))
    return d.groupBy("dir", (F.col("at") + 1).alias("depth")).agg(F.count("*").alias("n_files"))


def auto_collapse(g: Graph, max_cards: int = 2000, costs: DataFrame | None = None) -> DataFrame:
    """depth, rendered: the deepest directory depth whose cards fit, else 1; no row if all files fit.

    ``costs`` (id, cost) tells how many cards a file stands for, 1 by default.
    """
    f = g.nodes.filter("kind = 'file'").select("id", paths.dir_prefixes(F.col("filePath")).alias("p"))
    f = f.join(costs.select("id", "cost"), "id", "left").fillna(1, ["cost"]) if costs is not None else f.withColumn("cost", F.lit(1).cast("long"))
    d = f.select("cost", F.posexplode("p").alias("at", "dir")).groupBy((F.col("at") + 1).alias("depth")).agg(
        F.count_distinct("dir").alias("dirs"), F.sum("cost").alias("absorbed")
    )
    total = f.agg(F.sum("cost").alias("total"))
    every = d.join(total.filter(F.col("total") > max_cards)).withColumn("rendered", F.col("dirs") + F.col("total") - F.col("absorbed"))
    # rendered grows with depth, so the first that does not fit ends the search
    best = F.greatest(F.coalesce(F.max(F.when(F.col("rendered") <= max_cards, F.col("depth"))), F.lit(1)), F.lit(1))
    chosen = every.agg(best.alias("chosen"))
    return every.join(chosen, F.col("depth") == F.col("chosen")).select("depth", "rendered")


def assign_packages(g: Graph, manifests: DataFrame) -> DataFrame:
    """id, package: the manifest (dir, name) of the nearest enclosing directory; externals keep their label.

    A file's directories are exploded and joined by equality, so no pair is tested twice.
    """
    n = g.nodes.select("id", "kind", "label", F.explode_outer(F.concat(F.array(F.lit("")), paths.dir_prefixes(F.col("parentFile")))).alias("dir"))
    hit = n.join(manifests.select("dir", "name"), "dir", "left")
    best = hit.groupBy("id", "kind", "label").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.length("dir"))).alias("name"))
    name = F.when(F.col("kind") == "external", F.concat(F.lit("pkg:ext:"), "label")).otherwise(F.coalesce("name", F.lit("pkg:«root»")))
    return best.select("id", name.alias("package"))


def package_graph(g: Graph, manifests: DataFrame) -> DataFrame:
    """source, target, kind, count: base edges between packages, always ``import``.

    Where ``manifests`` has ``declared`` (an array of structs with a name), a declared
    dependency on another package of the graph, by its manifest's name or else external, is an
    edge too, of count 0 if nothing else makes it.  A manifest's package is its ``name``, which
    ``label`` names in declarations (by default what follows the last colon).
    """
    of = assign_packages(g, manifests)
    out = _between(g, of)
    if "declared" in manifests.columns:
        label = F.col("label") if "label" in manifests.columns else F.substring_index("name", ":", -1)
        present = of.select(F.col("package").alias("name")).distinct()
        own = manifests.select("name", label.alias("label"), "declared").join(present, "name", "left_semi")
        inside = own.groupBy("label").agg(F.max("name").alias("inside")).withColumnRenamed("label", "dep")
        outside = present.filter(F.col("name").startswith("pkg:ext:")).select(F.col("name").alias("outside"), F.substr("name", F.lit(9)).alias("dep"))
        wanted = own.select(F.col("name").alias("source"), F.explode(F.transform("declared", lambda d: d["name"])).alias("dep"))
        wanted = wanted.join(inside, "dep", "left").join(outside, "dep", "left").select("source", F.coalesce("inside", "outside").alias("target"))
        wanted = wanted.filter("target IS NOT NULL AND target <> source").distinct().join(out, ["source", "target"], "left_anti")
        out = out.union(wanted.select("source", "target", F.lit("import"), F.lit(0).cast("long")))
    return out


def _between(g: Graph, of: DataFrame) -> DataFrame:
    """source, target, kind, count of edges between groups (id, group)."""
    e = g.edges.join(of.toDF("source", "a"), "source").join(of.toDF("target", "b"), "target").filter("a <> b")
    return e.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.sum("count").alias("count")).select(
        "source", "target", F.lit("import").alias("kind"), "count"
    )


def assign_workspaces(g: Graph, manifests: DataFrame, default: str = "«workspace»") -> DataFrame:
    """id, workspace: that of the nearest manifest (dir, workspace); externals stand for themselves."""
    named = manifests.select("dir", F.coalesce("workspace", F.lit(default)).alias("name"))
    of = assign_packages(g, named)
    inner = F.when(F.col("package") == "pkg:«root»", F.lit(f"ws:{default}")).otherwise(F.concat(F.lit("ws:"), "package"))
    return of.select("id", F.when(F.col("package").startswith("pkg:ext:"), F.col("package")).otherwise(inner).alias("workspace"))


def workspace_graph(g: Graph, manifests: DataFrame) -> DataFrame:
    """source, target, kind, count: base edges between workspaces and externals."""
    return _between(g, assign_workspaces(g, manifests))


def package_names(g: Graph, manifests: DataFrame) -> DataFrame:
    """id, package: the name that ``package:`` looks in, without its ecosystem."""
    return assign_packages(g, manifests).select("id", F.regexp_replace("package", r"\Apkg:(?:[^:]*:)?", "").alias("package"))


def summary(g: Graph, hubs: int = 10) -> DataFrame:
    """what, name, n: totals, counts by kind, and the nodes that most edges reach (a top-k report)."""
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("name"), "n")
    kinds = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what), "kind", "n")
    top = g.valid_edges().groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(hubs)
    return one(g.nodes, "nodes").union(one(g.edges, "edges")).union(kinds(g.nodes, "node")).union(kinds(g.edges, "edge")).union(top.select(F.lit("hub"), "id", "n"))


def shape(g: Graph) -> DataFrame:
    """One row: n_nodes, n_edges, mean_degree, max_degree, gini, hub_share, isolated."""
    e = g.valid_edges().filter("source <> target")
    pairs = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    d = g.nodes.select("id").join(ends, "id", "left").fillna(0)
    # ranks of equal degrees may be averaged: counts per degree are a small table
    by = d.groupBy("d").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    by = by.withColumn("rank_sum", F.col("n") * (2 * upto - F.col("n") + 1) / 2)
    s = by.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("d")).alias("t"), F.sum(F.col("rank_sum") * F.col("d")).alias("w"),
               F.max("d").alias("most"), F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)).alias("isolated"))
    gini = F.when(F.col("t") > 0, 2 * F.col("w") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)
    return s.select(F.col("n").alias("n_nodes"), (F.col("t") / 2).cast("long").alias("n_edges"), F.round(F.col("t") / F.col("n"), 6).alias("mean_degree"),
                    F.col("most").alias("max_degree"), F.round(gini, 6).alias("gini"), "isolated")

"""What is drawn of a graph: visibility, kinds of edges, styles, card counts, engines, and the level-of-detail cut."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.functions.storage import store
from vinculum.model import Graph
from vinculum.operators import clusters, traversal, views

#: Colours of node kinds, external sources, roles and edge kinds.
KIND_COLORS = {
    "file": "#94a3b8", "class": "#a855f7", "interface": "#06b6d4", "struct": "#6366f1", "trait": "#22d3ee", "protocol": "#67e8f9", "enum": "#f97316",
    "union": "#a78bfa", "record": "#818cf8", "object": "#c084fc", "type": "#eab308", "namespace": "#fbbf24", "module": "#f59e0b", "function": "#3b82f6",
    "method": "#60a5fa", "constructor": "#2563eb", "accessor": "#38bdf8", "component": "#22c55e", "macro": "#ec4899",
    "variable": "#14b8a6", "constant": "#84cc16", "field": "#2dd4bf", "property": "#5eead4", "annotation": "#f472b6", "external": "#94a3b8",
}
EXTERNAL_COLORS = {"npm": "#f87171", "node": "#4ade80", "deno": "#60a5fa", "bun": "#f472b6"}
ROLE_COLORS = {
    "react-component": "#22d3ee", "vue-component": "#42b883", "svelte-component": "#ff3e00", "angular-component": "#dd0031", "angular-service": "#f0506e",
    "angular-module": "#b52e31", "angular-directive": "#e2533a", "angular-pipe": "#c026d3", "ecs-component": "#f97316", "ecs-system": "#ec4899", "ecs-entity": "#eab308",
}
EDGE_COLORS = {
    "import": "#94a3b8", "call": "#60a5fa", "extends": "#c084fc", "implements": "#22d3ee", "renders": "#4ade80", "instantiates": "#fb923c", "has": "#2dd4bf",
    "injects": "#f472b6", "contains": "#475569",
}
#: Signs and icon shapes of node kinds and roles.
KIND_SIGNS = {
    "file": "▣", "class": "◆", "interface": "◇", "struct": "▤", "trait": "✦", "protocol": "◈", "enum": "≣", "union": "⊍", "record": "▦", "object": "◉", "type": "𝓣",
    "namespace": "❏", "module": "❏", "function": "ƒ", "method": "ƒ", "constructor": "⊕", "accessor": "⇄", "component": "⬡", "macro": "!", "variable": "▪", "constant": "=",
    "field": "▫", "property": "◦", "annotation": "@", "external": "↗",
}
ROLE_SIGNS = {
    "react-component": "⬡", "vue-component": "▽", "svelte-component": "◤", "angular-component": "Ⓐ", "angular-service": "⚙", "angular-module": "▦", "angular-directive": "✦",
    "angular-pipe": "▸", "ecs-component": "◈", "ecs-system": "⚙", "ecs-entity": "◉",
}
KIND_SHAPES = {
    "file": "doc", "class": "diamond", "interface": "diamond-o", "struct": "square", "trait": "diamond-o", "protocol": "diamond-o", "enum": "bars", "union": "diamond",
    "record": "square", "object": "hexagon", "type": "rounded", "namespace": "hexagon", "module": "hexagon", "function": "circle", "method": "circle", "constructor": "circle",
    "accessor": "circle", "component": "hexagon", "macro": "diamond", "variable": "square", "constant": "circle", "field": "square", "property": "rounded",
    "annotation": "diamond", "external": "arrow",
}
ROLE_SHAPES = {
    "react-component": "hexagon", "vue-component": "hexagon", "svelte-component": "hexagon", "angular-component": "hexagon", "angular-service": "circle",
    "angular-module": "square", "angular-directive": "diamond", "angular-pipe": "arrow", "ecs-component": "diamond", "ecs-system": "hexagon", "ecs-entity": "circle",
}
#: Above so many nodes so many pieces of evidence an edge stay; files beyond which a scan is refused.
TRIM_NODES, TRIM_KEPT, OVERSIZE_FILES = 20_000, 1, 3000


def _pick(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _or_null(g: DataFrame, name: str) -> Column:
    return F.col(name) if name in g.columns else F.lit(None).cast("string")


def node_color(kind: Column, role: Column, external: Column) -> Column:
    """The external source's colour for externals (npm by default), else the role's, else the kind's."""
    return F.when(kind == "external", _pick(EXTERNAL_COLORS, F.coalesce(external, F.lit("npm")))).otherwise(F.coalesce(_pick(ROLE_COLORS, role), _pick(KIND_COLORS, kind)))


def _face(kind: Column, role: Column, kinds: dict[str, str], roles: dict[str, str]) -> Column:
    return F.when(kind == "external", kinds["external"]).otherwise(F.coalesce(_pick(roles, role), _pick(kinds, kind)))


def node_sign(kind: Column, role: Column) -> Column:
    """The externals' sign, else the role's, else the kind's; null for unknown ones."""
    return _face(kind, role, KIND_SIGNS, ROLE_SIGNS)


def icon_shape(kind: Column, role: Column) -> Column:
    """The shape a card's icon has, by the same precedence as :func:`node_sign`."""
    return _face(kind, role, KIND_SHAPES, ROLE_SHAPES)


@dataclass(frozen=True)
class Filters:
    """What is switched on; None means all.  ``projected`` graphs (packages) pass every gate but the query's."""

    external: bool = True
    kinds: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    environments: tuple[str, ...] | None = None
    runtimes: tuple[str, ...] | None = None
    edge_kinds: tuple[str, ...] | None = None
    folders: tuple[str, ...] | None = None
    languages: tuple[str, ...] | None = None
    projected: bool = False


def _in(c: Column, allowed: tuple[str, ...] | None) -> Column:
    return F.lit(True) if allowed is None else c.isin(*allowed) if allowed else F.lit(False)


def visible(g: Graph, f: Filters, focus: DataFrame | None = None, query: DataFrame | None = None) -> Graph:
    """The nodes that pass the gates and the edges between them.

    ``focus`` (id) shows exactly those nodes, and the files of its symbols; else ``query`` (id)
    narrows what the switches leave.  Folder, language, environment and runtime gates hold for
    files and their symbols; kinds and categories for symbols.
    """
    n = g.nodes
    if focus is not None:
        own = n.join(focus.select("id").distinct(), "id", "left_semi")
        parents = own.filter("kind NOT IN ('file', 'external')").select(F.col("parentFile").alias("id"))
        return g.induced(own.select("id").union(parents))
    if query is not None:
        n = n.join(query.select("id").distinct(), "id", "left_semi")
    if not f.projected:
        category, environment = _or_null(n, "category"), _or_null(n, "environment")
        gate = _in(paths.top_folder(F.col("filePath")), f.folders) & _in(paths.language(F.col("filePath")), f.languages)
        gate = gate & (environment.isNull() | (environment == "") | _in(environment, f.environments))
        if "runtimes" in n.columns and f.runtimes is not None:
            wanted = F.array(*[F.lit(x) for x in f.runtimes]).cast("array<string>")
            gate = gate & (F.coalesce(F.size("runtimes"), F.lit(0)).isin(0, -1) | F.arrays_overlap("runtimes", wanted))
        symbol = _in(F.col("kind"), f.kinds) & (category.isNull() | (category == "") | _in(category, f.categories))
        n = n.filter(F.when(F.col("kind") == "external", F.lit(f.external)).otherwise(gate & ((F.col("kind") == "file") | symbol)))
    return g.induced(n.select("id"))


def edges_of_kinds(edges: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    """Edges of the kinds that are switched on; ``contains`` always stays."""
    return edges.filter((F.col("kind") == "contains") | _in(F.col("kind"), kinds))


def view_edges(g: Graph, expanded: DataFrame | None = None) -> DataFrame:
    """id, source, target, kind, count, originals (edge ids in order, comma-joined) of the file view; see :func:`views.file_view`."""
    face = views.faces(g, expanded)
    e = g.edges.join(face.toDF("source", "a"), "source").join(face.toDF("target", "b"), "target").filter("a <> b")
    out = e.groupBy(F.col("a").alias("source"), F.col("b").alias("target"), "kind").agg(F.sum("count").alias("count"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("originals"))
    if expanded is not None:
        inner = g.nodes.filter("kind NOT IN ('file', 'external')").join(expanded.select(F.col("id").alias("parentFile")), "parentFile", "left_semi")
        out = out.union(inner.select("parentFile", "id", F.lit("contains"), F.lit(0).cast("long"), F.lit("")))
    return out.select(F.concat("source", F.lit("->"), "target", F.lit(":"), "kind").alias("id"), "source", "target", "kind", "count", "originals")


def scene_nodes(g: Graph, f: Filters, expanded: DataFrame | None = None) -> DataFrame:
    """id, kind, label, color, symbol_count (of the whole graph), lang of the cards: files, externals, and symbols of expanded files."""
    seen = visible(g, f).nodes
    face = views.faces(Graph(seen, g.edges), expanded).filter("id = face").select("id")
    counts = views.symbol_counts(g).toDF("id", "symbol_count")
    shown = seen.join(face, "id", "left_semi").join(counts, "id", "left")
    color = node_color(F.col("kind"), _or_null(seen, "role"), _or_null(seen, "externalKind"))
    lang = F.when(F.col("kind") == "file", paths.language(F.col("label")))
    return shown.select("id", "kind", "label", color.alias("color"), F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), lang.alias("lang"))


def scene_edges(g: Graph, f: Filters, expanded: DataFrame | None = None) -> DataFrame:
    """id, source, target, kind, count, color, dashed, to_external of the view's edges."""
    seen = visible(g, f)
    e = edges_of_kinds(view_edges(seen, expanded), f.edge_kinds)
    ext = seen.nodes.filter("kind = 'external'").select(F.col("id").alias("target"), node_color(F.lit("external"), F.lit(None).cast("string"), _or_null(seen.nodes, "externalKind")).alias("xc"))
    return e.join(ext, "target", "left").select(
        "id", "source", "target", "kind", "count", F.coalesce("xc", _pick(EDGE_COLORS, F.col("kind"))).alias("color"),
        (F.col("kind") == "contains").alias("dashed"), F.col("xc").isNotNull().alias("to_external"),
    )


def trimmed(edges: DataFrame, n_nodes: int, threshold: int = TRIM_NODES, kept: int = TRIM_KEPT) -> DataFrame:
    """Edges with fewer pieces of evidence where the graph is large; their counts stay."""
    return edges.withColumn("occurrences", F.slice("occurrences", 1, kept)) if n_nodes > threshold else edges


def internal_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """source, target, kind, count, weight: parallel edges (weight) within ``ids`` (id) as one, of the heaviest one's kind (ties: the first by id)."""
    e = edges.filter("source <> target").join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    heaviest = F.min_by("kind", F.struct((-F.col("weight")).alias("w"), "id"))
    return e.groupBy("source", "target").agg(heaviest.alias("kind"), F.sum("count").alias("count"), F.sum("weight").alias("weight"))


def arborescence(g: Graph) -> DataFrame:
    """id, parent: each node's heaviest incoming edge (by count; ties: the least id) from the level above; null for roots.

    Roots have no way in; without any, the node of most outgoing edges is one.  What no root
    reaches hangs from the first root.
    """
    e = store(g.valid_edges().filter("source <> target").select("source", "target", F.col("count").alias("weight")))
    ids = g.nodes.select("id")
    roots = store(ids.join(e.select(F.col("target").alias("id")), "id", "left_anti"))
    if roots.isEmpty():
        out = e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
        roots = store(ids.join(out, "id", "left").orderBy(F.desc(F.coalesce("n", F.lit(0))), "id").limit(1).select("id"))
    depth = store(traversal.reach(g, roots).union(roots.withColumn("depth", F.lit(0))))
    hop = e.join(depth.toDF("target", "dt"), "target").join(depth.toDF("source", "ds"), "source").filter("dt = ds + 1")
    best = hop.groupBy(F.col("target").alias("id")).agg(F.min_by("source", F.struct((-F.col("weight")).alias("w"), "source")).alias("parent"))
    first = roots.agg(F.min("id").alias("first"))
    out = ids.join(best, "id", "left").join(roots.withColumn("is_root", F.lit(True)), "id", "left").join(first)  # one row
    return out.select("id", F.when(F.col("is_root"), None).otherwise(F.coalesce("parent", "first")).alias("parent"))


def graph_shape(g: Graph) -> DataFrame:
    """One row of sixteen descriptors, by which a layout engine is chosen; an empty graph is a tree without cycles."""
    e = store(g.valid_edges().filter("source <> target").select("source", "target"))
    ends = e.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("source", F.lit(0), F.lit(1)))
    io = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    near = clusters.plain_pairs(e).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d"))
    d = store(g.nodes.select("id").join(io, "id", "left").join(near, "id", "left").fillna(0, ["i", "o", "d"]))
    share = lambda condition: F.count_if(F.expr(condition)) / F.greatest(F.count("*"), F.lit(1))
    base = d.agg(
        F.count("*").alias("nodes"), F.coalesce(F.sum("o"), F.lit(0)).alias("edges"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("sd"),
        share("i = 0 AND o = 0").alias("isolate_ratio"), share("i + o = 1").alias("leaf_ratio"), share("i = 0 AND o > 0").alias("source_ratio"), share("o = 0 AND i > 0").alias("sink_ratio"),
    ).first()
    n = base["nodes"]
    hubs = d.agg(F.count_if(F.col("d") > base["mean"] + 1.5 * base["sd"])).first()[0]
    of = store(traversal.communities(g))
    many = of.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
    q = clusters.modularity(Graph(g.nodes, g.edges), of).first()["modularity"] if n else 0.0
    cyclic = traversal.scc(g).agg(F.count_if(F.col("size") > 1)).first()[0]
    parts = traversal.components(g).agg(F.count_distinct("label")).first()[0]
    gini, tree = views.shape(g).first()["gini"] if n else 0.0, clusters.tree_score(g).first()["score"] if n else 1.0
    in_cycles = cyclic / n if n else 0.0
    row = {
        "node_count": n, "edge_count": base["edges"], "density": base["edges"] / (n * (n - 1)) if n > 1 else 0.0, "component_count": parts, "isolate_ratio": base["isolate_ratio"],
        "leaf_ratio": base["leaf_ratio"], "source_ratio": base["source_ratio"], "sink_ratio": base["sink_ratio"], "scc_node_ratio": in_cycles, "dag_score": 1 - in_cycles, "tree_score": tree,
        "degree_gini": gini, "hub_ratio": hubs / n if n else 0.0, "community_count": many[0], "modularity": q, "largest_community_ratio": (many[1] or 0) / n if n else 0.0,
    }
    kinds = ", ".join(f"{k} {'long' if k.endswith('_count') else 'double'}" for k in row)
    return g.nodes.sparkSession.createDataFrame([tuple(float(v) if not k.endswith("_count") else int(v) for k, v in row.items())], kinds)


def chosen_engine(circular_most: int = 40, stress_most: int = 400) -> Column:
    """The layout engine for a row of :func:`graph_shape`."""
    c = F.col
    out = F.when((c("edge_count") == 0) | (c("isolate_ratio") > 0.9), "grid").when((c("tree_score") > 0.8) & (c("source_ratio") > 0), "tree").when(c("dag_score") > 0.8, "layered")
    out = out.when((c("scc_node_ratio") > 0.5) & (c("node_count") <= circular_most), "circular")
    hubs = (c("leaf_ratio") > 0.3) & (c("hub_ratio") > 0.02) & (c("degree_gini") > 0.45)
    out = out.when(((c("leaf_ratio") > 0.4) & (c("scc_node_ratio") > 0.1)) | hubs, "backbone").when((c("scc_node_ratio") > 0.3) & (c("node_count") <= stress_most), "stress")
    return out.when((c("density") > 0.15) | ((c("modularity") > 0.3) & (c("community_count") >= 3)), "force").otherwise("layered")


def candidate_engines(chosen: Column) -> Column:
    """The chosen engine and, unless it is clear-cut, the versatile ones; three at most."""
    more = F.slice(F.array_distinct(F.array(chosen, F.lit("stress"), F.lit("force"), F.lit("layered"))), 1, 3)
    return F.when(chosen.isin("grid", "tree", "circular"), F.array(chosen)).otherwise(more)


def cluster_ancestry(g: Graph) -> DataFrame:
    """id, clusters (outermost first, comma-joined): the directories of each node; one with a single child and no node of its own is one with that child."""
    n = g.nodes.select("id", paths.dir_prefixes(F.col("filePath")).alias("dirs"))
    own = n.filter(F.size("dirs") > 0).select(F.try_element_at("dirs", F.lit(-1)).alias("dir")).distinct().withColumn("own", F.lit(True))
    every = n.select(F.explode("dirs").alias("dir")).distinct()
    children = every.filter(F.contains("dir", F.lit("/"))).groupBy(paths.dir_of(F.col("dir")).alias("dir")).agg(F.count("*").alias("children"))
    merged = every.join(own, "dir", "left").join(children, "dir", "left").filter("own IS NULL AND children = 1").select("dir", F.lit(True).alias("merged"))
    chain = n.select("id", F.posexplode_outer("dirs").alias("at", "dir")).join(merged, "dir", "left").filter("merged IS NULL")
    chain = chain.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "dir"))), lambda x: x["dir"]), ",").alias("clusters"))
    return n.select("id").join(chain, "id", "left").select("id", F.coalesce("clusters", F.lit("")).alias("clusters"))


# --- positions and the cut --------------------------------------------------------------------


def grid_positions(g: Graph, columns: int, width: float = 200.0, height: float = 80.0) -> DataFrame:
    """id, x, y: nodes by id in rows that turn at the ends (serpentine)."""
    at = F.row_number().over(W.orderBy("id")) - 1
    row = F.floor(F.col("at") / columns)
    column = F.when(row % 2 == 0, F.col("at") % columns).otherwise(columns - 1 - F.col("at") % columns)
    return g.nodes.select("id", at.alias("at")).select("id", (column * width).cast("double").alias("x"), (row * height).cast("double").alias("y"))


def radial_positions(g: Graph, roots: DataFrame, ring: float = 150.0) -> DataFrame:
    """id, x, y: rings by distance from ``roots`` (id), evenly dealt by id; what they do not reach stands on the outermost ring."""
    depth = traversal.reach(g, roots).union(roots.select("id", F.lit(0).alias("depth")))
    last = depth.agg((F.max("depth") + 1).alias("last"))
    d = g.nodes.select("id").join(depth, "id", "left").join(last).select("id", F.coalesce("depth", "last").alias("depth"))  # one row
    place = (F.row_number().over(W.partitionBy("depth").orderBy("id")) - 1) / F.count("*").over(W.partitionBy("depth"))
    angle = 2 * F.pi() * place
    return d.withColumn("angle", angle).select("id", (ring * F.col("depth") * F.cos("angle")).alias("x"), (ring * F.col("depth") * F.sin("angle")).alias("y"))


def bounds_of(boxes: DataFrame, padding: float = 32.0) -> DataFrame:
    """One row x, y, width, height: the padded frame of boxes (x, y, width, height)."""
    s = boxes.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max(F.col("x") + F.col("width")).alias("c"), F.max(F.col("y") + F.col("height")).alias("d")).filter("a IS NOT NULL")
    return s.select((F.col("a") - padding).alias("x"), (F.col("b") - padding).alias("y"), (F.col("c") - F.col("a") + 2 * padding).alias("width"), (F.col("d") - F.col("b") + 2 * padding).alias("height"))


def fit_camera(boxes: DataFrame, vw: float, vh: float, most: float = 1.2, padding: float = 80.0) -> DataFrame:
    """One row x, y, scale: the camera that frames boxes in a viewport; no row without a box or a viewport."""
    f = bounds_of(boxes, 0.0).filter(F.lit(vw > 0 and vh > 0))
    fit = F.least((vw - 2 * padding) / F.greatest(F.lit(1.0), F.col("width")), (vh - 2 * padding) / F.greatest(F.lit(1.0), F.col("height")), F.lit(most))
    f = f.withColumn("scale", F.greatest(F.lit(0.02), fit))
    return f.select((vw / 2 - (F.col("x") + F.col("width") / 2) * F.col("scale")).alias("x"), (vh / 2 - (F.col("y") + F.col("height") / 2) * F.col("scale")).alias("y"), "scale")


def on_screen(x: Column, y: Column, w: Column, h: Column, cam: tuple[float, float, float], vw: float, vh: float, margin: float = 0.0) -> Column:
    """Whether a box's projection (world * scale + offset) meets the padded viewport."""
    left, top = x * cam[2] + cam[0], y * cam[2] + cam[1]
    return (left + w * cam[2] >= -margin) & (left <= vw + margin) & (top + h * cam[2] >= -margin) & (top <= vh + margin)


def walk_cut(rows: Iterable[tuple], open_px: float, max_cards: int, hysteresis: float = 0.8, was_collapsed: set[str] | None = None) -> list[tuple[str, str, str]]:
    """(dir, decision, reason) of directories (dir, depth, files, seen, height, children, boxed), parents before children and the heaviest child first.

    A directory is collapsed if it is off screen, empty, too small or beyond the card budget;
    else it opens and its children are looked at.
    """
    out, cards, shut = [], 0, []
    for dir_, files, seen, height, children, boxed in rows:
        if any(dir_.startswith(f"{s}/") for s in shut[-1:]):
            continue
        threshold = open_px * hysteresis if was_collapsed is not None and dir_ not in was_collapsed else open_px
        if cards >= max_cards:
            reason = "budget"
        elif not boxed or not seen:
            reason = "off-screen"
        elif not files and not children:
            reason = "no-content"
        elif height < threshold:
            reason = "too-small"
        elif cards + files > max_cards:
            reason = "budget"
        else:
            reason = "opened"
        if reason == "opened":
            cards += files
        else:
            cards += 1
            shut.append(dir_)
        out.append((dir_, "open" if reason == "opened" else "collapse", reason))
    return out


def lod_cut(g: Graph, boxes: DataFrame, cam: tuple[float, float, float], vw: float, vh: float, open_px: float, max_cards: int, hysteresis: float = 0.8, previous: DataFrame | None = None) -> DataFrame:
    """dir, decision, reason: the directories shown open or as one card at a camera (x, y, scale).

    ``boxes`` is (dir, x, y, width, height).  What a directory holds, its visibility and its
    height are columns; the walk, whose budget depends on its order, is one pass over the
    directories, in one task: there are as many as the card budget lets it open, and those below.
    """
    tree = views.dir_rollup(g)
    n = g.nodes.filter("kind = 'file'").select(paths.dir_of(F.col("filePath")).alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))
    children = tree.filter("depth > 1").groupBy(paths.dir_of(F.col("dir")).alias("dir")).agg(F.count("*").alias("children"))
    d = tree.join(n, "dir", "left").join(children, "dir", "left").join(boxes, "dir", "left").fillna(0, ["files", "children"])
    seen = F.coalesce(on_screen(F.col("x"), F.col("y"), F.col("width"), F.col("height"), cam, vw, vh), F.lit(False))
    weight = tree.select(F.col("dir").alias("up"), F.col("n_files").alias("up_files"))
    # the place of a directory in the walk: for each of its prefixes, the heaviest first, then the name
    steps = d.select("dir", F.posexplode(paths.dir_prefixes(F.concat("dir", F.lit("/x")))).alias("at", "up")).join(weight, "up")
    key = steps.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", (-F.col("up_files")).alias("w"), "up"))), lambda x: F.struct(x["w"], x["up"])).alias("key"))
    old = {r["dir"] for r in previous.select("dir").collect()} if previous is not None else None
    rows = d.join(key, "dir").select("key", "dir", "files", seen.alias("seen"), F.coalesce(F.col("height") * cam[2], F.lit(0.0)).alias("height"), "children", F.col("x").isNotNull().alias("boxed"))

    def run(batches):
        held = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        found = walk_cut(held, open_px, max_cards, hysteresis, old)
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.string())], ["dir", "decision", "reason"])

    return rows.coalesce(1).sortWithinPartitions("key").drop("key").mapInArrow(run, "dir string, decision string, reason string")

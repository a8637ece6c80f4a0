"""Positions of whole graphs: budgets of engines, components side by side, nested directories, and how good they are."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.functions.storage import store
from vinculum.model import Graph
from vinculum.operators import engines
from vinculum.operators.ordering import by_component, placed

#: The pull of each kind of edge; others pull with 1.
PULL = {"extends": 8, "implements": 8, "injects": 6, "has": 5, "import": 4, "renders": 3, "instantiates": 2, "call": 1, "contains": 0}
#: Nodes of a component beyond which an engine gives way to the grid; edges likewise (not for stress);
#: edges a node in layered components of more than so many nodes.
MOST_NODES = {"stress": 6000, "layered": 1200, "tree": 2500, "backbone": 1500, "force": 1800}
MOST_EDGES, DENSE_EDGES, DENSE_NODES = 8000, 2.5, 32


def edge_weight(kind: Column, count: Column) -> Column:
    """What an edge pulls with: its kind's weight times log2(1 + count)."""
    pull = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PULL.items() for x in kv]), kind), F.lit(1))
    return pull * F.log2(1 + F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)))


def within_budget(engine: Column, nodes: Column, edges: Column) -> Column:
    """struct(engine, reason): the engine itself, or the grid and why (node-cap, edge-cap)."""
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in MOST_NODES.items() for x in kv]), engine)
    dense = (engine == "layered") & (nodes > DENSE_NODES) & (edges > nodes * DENSE_EDGES)
    reason = F.when(cap.isNotNull() & (nodes > cap), "node-cap").when(cap.isNotNull() & ((engine != "stress") & (edges > MOST_EDGES) | dense), "edge-cap")
    return F.struct(F.when(reason.isNull(), engine).otherwise("grid").alias("engine"), reason.alias("reason"))


def fallbacks(resolved: DataFrame) -> DataFrame:
    """substitution, areas: how often an engine (requested, engine, reason) gave way to another."""
    return resolved.filter("reason IS NOT NULL").groupBy(F.concat(F.initcap("requested"), F.lit(" → "), F.initcap("engine")).alias("substitution")).agg(F.count("*").alias("areas"))


def fallback_summary(resolved: DataFrame) -> str | None:
    """One line of :func:`fallbacks`, the most frequent first; None without any."""
    found = fallbacks(resolved).orderBy(F.desc("areas"), "substitution").collect()  # a row per pair of engines
    if not found:
        return None
    parts = ", ".join(r["substitution"] + (f" ({r['areas']} areas)" if r["areas"] > 1 else "") for r in found)
    return f"Layout simplified — {parts} (too large for the chosen engine)"


def circular_positions(nodes: DataFrame, spacing: float = 220.0, within: str | None = None) -> DataFrame:
    """id, x, y: nodes by id around one circle, or one for each value of ``within``."""
    n = placed(nodes.select("id", *([within] if within else [])), "id", within=within)
    sizes = n.groupBy(*([within] if within else [])).agg(F.count("*").alias("n"))
    n = n.join(sizes, within) if within else n.join(sizes)  # one row
    angle, radius = 2 * F.pi() * F.col("place") / F.col("n"), F.col("n") * spacing / (2 * math.pi)
    return n.select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def square_positions(nodes: DataFrame, within: str, width: float = 220.0, height: float = 90.0) -> DataFrame:
    """id, x, y: for each value of ``within`` a square grid by id whose rows turn at the ends."""
    n = placed(nodes.select("id", within), "id", within=within)
    n = n.join(n.groupBy(within).agg(F.ceil(F.sqrt(F.count("*"))).alias("columns")), within)
    row, at = F.floor(F.col("place") / F.col("columns")), F.col("place") % F.col("columns")
    at = F.when(row % 2 == 0, at).otherwise(F.col("columns") - 1 - at)
    return n.select("id", (at * width).cast("double").alias("x"), (row * height).cast("double").alias("y"))


def shelves(boxes: DataFrame, gap: float = 60.0) -> DataFrame:
    """label, x, y: offsets of boxes (label, width, height) on shelves, by label; about square over all.

    One pass in one task, which holds nothing but the shelf it fills.
    """
    boxes = store(boxes.select("label", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")))
    area, widest = boxes.agg(F.sum((F.col("width") + gap) * (F.col("height") + gap)), F.max("width")).first()
    if area is None:
        return boxes.select("label", F.col("width").alias("x"), F.col("height").alias("y"))
    row = max(widest, math.sqrt(area) * 1.4)

    def run(batches):
        x = y = tall = 0.0
        for batch in batches:
            labels, widths, heights = batch.columns
            xs, ys = [], []
            for w, h in zip(widths.to_pylist(), heights.to_pylist(), strict=True):
                if x > 0 and x + w > row:
                    x, y, tall = 0.0, y + tall + gap, 0.0
                xs.append(x)
                ys.append(y)
                x, tall = x + w + gap, max(tall, h)
            yield pa.RecordBatch.from_arrays([labels, pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], ["label", "x", "y"])

    return boxes.coalesce(1).sortWithinPartitions("label").mapInArrow(run, "label string, x double, y double")


def laid_out(g: Graph, engine: str, width: float = 180.0, height: float = 60.0, part: bool = True) -> DataFrame:
    """id, label (the component's least id), engine, x, y (top left): each component by ``engine``, side by side.

    Components beyond the engine's budget, and all with ``grid`` and ``circular``, are laid out
    by expressions; the others one a task, whose size the budget bounds.  ``radial``, which has
    no budget of its own, takes that of stress.  ``part`` pushes overlapping boxes apart.
    """
    from vinculum.operators import traversal

    of = store(traversal.components(g))
    e = g.valid_edges().filter("source <> target").select("source", "target").distinct()
    links = e.join(of.toDF("source", "label"), "source").groupBy("label").agg(F.count("*").alias("edges"))
    sizes = of.groupBy("label").agg(F.count("*").alias("nodes")).join(links, "label", "left").fillna(0, ["edges"])
    budget = within_budget(F.lit("stress" if engine == "radial" else engine), F.col("nodes"), F.col("edges"))
    sizes = store(sizes.withColumn("engine", F.when(budget["reason"].isNull(), F.lit(engine)).otherwise("grid")))
    named = of.join(sizes.select("label", "engine"), "label")
    if engine == "circular":
        xy = circular_positions(named, within="label")
    else:
        xy = square_positions(named.filter("engine = 'grid'"), "label")
        if engine != "grid":

            def solve(key, ids, a, b):
                at = engines.positions(engine, len(ids), a, b)
                at = engines.apart(at, width + 20, height + 20) if part else at
                return [ids.tolist(), at[:, 0].tolist(), at[:, 1].tolist()]

            xy = xy.union(by_component(g, solve, "id string, x double, y double", named.filter("engine <> 'grid'").select("id", "label")))
    xy = store(xy.join(named, "id"))
    box = xy.groupBy("label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + width).alias("width"), (F.max("y") - F.min("y") + height).alias("height"))
    box = store(box)
    moves = shelves(box).toDF("label", "dx", "dy").join(box.select("label", "x0", "y0"), "label")
    return xy.join(moves, "label").select("id", "label", "engine", (F.col("x") - F.col("x0") + F.col("dx")).alias("x"), (F.col("y") - F.col("y0") + F.col("dy")).alias("y"))


def nested(g: Graph, width: float = 180.0, height: float = 60.0, gap: float = 20.0, head: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Boxes in boxes: (id, x, y) of files and (dir, depth, x, y, width, height) of directories.

    A directory holds a square grid of its own files and, below it, a square grid of its
    directories in cells of the largest one.  Sizes go up from the deepest directory, places
    down from the top: two rounds a level, of expressions alone.
    """
    files = g.nodes.filter("kind = 'file'").select("id", paths.dir_of(F.col("filePath")).alias("dir"))
    inner = store(square_positions(files, "dir", width + gap, height + gap).join(files, "id"))
    own = inner.groupBy("dir").agg((F.max("x") + width).alias("fw"), (F.max("y") + height).alias("fh"))
    every = files.select(F.explode(paths.dir_prefixes(F.concat("dir", F.lit("/x")))).alias("dir")).filter("dir <> ''").union(files.select(F.lit(""))).distinct()
    every = every.withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))).withColumn("up", paths.dir_of(F.col("dir")))
    every = store(every.join(own, "dir", "left").fillna(0.0, ["fw", "fh"]))
    deepest = every.agg(F.max("depth")).first()[0] or 0
    levels, below = {}, None
    for depth in range(deepest, -1, -1):
        mine = every.filter(F.col("depth") == depth)
        if below is not None:
            kids = below.groupBy(F.col("up").alias("dir")).agg(F.count("*").alias("kids"), F.max("width").alias("cw"), F.max("height").alias("ch"))
            mine = mine.join(kids, "dir", "left")
        else:
            mine = mine.withColumns({"kids": F.lit(0).cast("long"), "cw": F.lit(0.0), "ch": F.lit(0.0)})
        mine = mine.fillna(0, ["kids"]).fillna(0.0, ["cw", "ch"]).withColumn("columns", F.greatest(F.ceil(F.sqrt("kids")), F.lit(1)))
        rows, between = F.ceil(F.col("kids") / F.col("columns")), F.when((F.col("kids") > 0) & (F.col("fh") > 0), gap).otherwise(0.0)
        wide = F.greatest("fw", F.col("columns") * (F.col("cw") + gap) - gap)
        tall = F.col("fh") + between + F.greatest(rows * (F.col("ch") + gap) - gap, F.lit(0.0))
        mine = mine.withColumns({"width": wide + 2 * gap, "height": tall + 2 * gap + head, "shelf": head + gap + F.col("fh") + between})
        below = levels[depth] = store(mine)
    at = store(levels[0].select("dir", "depth", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "width", "height"))
    boxes = at
    for depth in range(1, deepest + 1):
        kids = placed(levels[depth].select("dir", "up", "depth", "width", "height"), "dir", within="up")
        over = levels[depth - 1].select(F.col("dir").alias("up"), "columns", "cw", "ch", "shelf").join(at.select(F.col("dir").alias("up"), F.col("x").alias("px"), F.col("y").alias("py")), "up")
        row, column = F.floor(F.col("place") / F.col("columns")), F.col("place") % F.col("columns")
        x, y = F.col("px") + gap + column * (F.col("cw") + gap), F.col("py") + F.col("shelf") + row * (F.col("ch") + gap)
        at = store(kids.join(over, "up").select("dir", "depth", x.alias("x"), y.alias("y"), "width", "height"))
        boxes = boxes.union(at)
    of = boxes.select("dir", F.col("x").alias("bx"), F.col("y").alias("by"))
    return inner.join(of, "dir").select("id", (F.col("bx") + gap + F.col("x")).alias("x"), (F.col("by") + head + gap + F.col("y")).alias("y")), boxes


# --- how good positions are -------------------------------------------------------------------


def overlaps(boxes: DataFrame) -> DataFrame:
    """a, b (a < b): boxes (id, x, y, w, h; centres) that overlap.

    Boxes meet in the cells of a grid that they touch, and a pair counts in the cell of its
    common part's lower corner alone, so only boxes near each other are compared.
    """
    b = store(boxes.select("id", (F.col("x") - F.col("w") / 2).alias("x0"), (F.col("x") + F.col("w") / 2).alias("x1"), (F.col("y") - F.col("h") / 2).alias("y0"), (F.col("y") + F.col("h") / 2).alias("y1")))
    cw, ch = b.agg(F.coalesce(F.avg(F.col("x1") - F.col("x0")), F.lit(1.0)), F.coalesce(F.avg(F.col("y1") - F.col("y0")), F.lit(1.0))).first()
    return _meeting(b, 2 * max(cw, 1e-9), 2 * max(ch, 1e-9)).filter("x0 < ox1 AND ox0 < x1 AND y0 < oy1 AND oy0 < y1").select("id", F.col("oid")).toDF("a", "b")


def _meeting(b: DataFrame, cw: float, ch: float) -> DataFrame:
    """Pairs id < oid of boxes (id, x0, x1, y0, y1, ...) that touch, each once; the other's columns start with o."""
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    b = b.withColumn("cx", F.explode(F.sequence(cell("x0", cw), cell("x1", cw)))).withColumn("cy", F.explode(F.sequence(cell("y0", ch), cell("y1", ch))))
    o = b.select("cx", "cy", *[F.col(c).alias(f"o{c}") for c in b.columns if c not in ("cx", "cy")])
    pairs = b.join(o, ["cx", "cy"]).filter("id < oid AND x0 <= ox1 AND ox0 <= x1 AND y0 <= oy1 AND oy0 <= y1")
    return pairs.filter((F.floor(F.greatest("x0", "ox0") / cw) == F.col("cx")) & (F.floor(F.greatest("y0", "oy0") / ch) == F.col("cy")))


def _segments(positions: DataFrame, edges: DataFrame) -> DataFrame:
    weight = F.col("weight") if "weight" in edges.columns else F.lit(0.0)
    e = edges.select("source", "target", (1 + F.log2(1 + F.coalesce(weight, F.lit(0.0)))).alias("importance"))
    at = positions.select("id", "x", "y")
    return e.join(at.toDF("source", "ax", "ay"), "source").join(at.toDF("target", "bx", "by"), "target")


def crossings(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, importance: pairs of edges (source, target[, weight]) without a common end whose lines cross between positions (id, x, y)."""
    s = _segments(positions, edges)
    s = placed(s, "source", "target", "importance", name="id")
    s = store(s.select("*", F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"), F.least("ay", "by").alias("y0"), F.greatest("ay", "by").alias("y1")))
    cw, ch = s.agg(F.coalesce(F.avg(F.col("x1") - F.col("x0")), F.lit(1.0)), F.coalesce(F.avg(F.col("y1") - F.col("y0")), F.lit(1.0))).first()
    p = _meeting(s, max(cw, 1e-3), max(ch, 1e-3)).filter("source NOT IN (osource, otarget) AND target NOT IN (osource, otarget)")
    side = lambda a, b, c: f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x) > 0)"
    p = p.filter(f"{side('oa', 'ob', 'a')} <> {side('oa', 'ob', 'b')} AND {side('a', 'b', 'oa')} <> {side('a', 'b', 'ob')}")
    return p.select(F.col("id").alias("a"), F.col("oid").alias("b"), ((F.col("importance") + F.col("oimportance")) / 2).alias("importance"))


def layout_score(boxes: DataFrame, edges: DataFrame, direction: str = "LR", flow_weight: float = 4.0, previous: DataFrame | None = None, movement_weight: float = 0.0) -> DataFrame:
    """One row overlaps, crossings, backward, movement, aspect, score (the lower, the better) of boxes (id, x, y, w, h; centres)."""
    runs_back = {"LR": "bx < ax", "RL": "bx > ax", "BT": "by > ay"}.get(direction, "by < ay")
    frame = boxes.agg((F.max("x") - F.min("x")).alias("fw"), (F.max("y") - F.min("y")).alias("fh"))
    out = overlaps(boxes).agg(F.count("*").alias("overlaps")).join(crossings(boxes, edges).agg(F.coalesce(F.sum("importance"), F.lit(0.0)).alias("crossings")))
    back = _segments(boxes, edges).filter(F.expr(runs_back)).agg(F.coalesce(F.sum("importance"), F.lit(0.0)).alias("backward"))
    out = out.join(back).join(frame).withColumn("movement", F.lit(0.0))  # one row each
    if previous is not None and movement_weight > 0:
        d = boxes.select("id", "x", "y").join(previous.select("id", F.col("x").alias("px"), F.col("y").alias("py")), "id").select((F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy"))
        mean = d.agg(F.avg("dx").alias("mx"), F.avg("dy").alias("my"))
        moved = d.join(mean).agg(F.coalesce(F.sum(F.hypot(F.col("dx") - F.col("mx"), F.col("dy") - F.col("my"))), F.lit(0.0)).alias("moved"))
        out = out.join(moved).withColumn("movement", F.col("moved") / F.greatest(F.lit(1.0), F.hypot("fw", "fh")))
    w, h = F.greatest(F.lit(1.0), F.coalesce("fw", F.lit(0.0))), F.greatest(F.lit(1.0), F.coalesce("fh", F.lit(0.0)))
    out = out.withColumn("aspect", F.greatest(F.lit(0.0), F.greatest(w / h, h / w) - 4) * 3)
    score = F.col("overlaps") * 100 + F.col("crossings") * 10 + F.col("backward") * flow_weight + F.col("movement") * movement_weight + F.col("aspect")
    return out.select("overlaps", "crossings", "backward", "movement", "aspect", score.alias("score"))

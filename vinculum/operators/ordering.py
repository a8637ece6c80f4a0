"""Orders of nodes: places in a table, the tie-break stack, bandwidth, spectrum and mean positions of neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.functions import paths
from vinculum.functions.storage import store
from vinculum.model import Graph
from vinculum.operators import clusters, engines, traversal


def placed(df: DataFrame, *order: str | Column, within: str | None = None, name: str = "place") -> DataFrame:
    """``df`` with its rows' place (from 0) in ``order``, of all rows or of those with equal ``within``.

    Rows are dealt to tasks by ranges of the order, so neither a window over all rows nor a
    group in one task is needed; what is numbered across tasks is the ranges' counts.
    """
    keys = {f"__k{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)}
    parts = [F.col(within)] if within else [F.lit(0)]
    cut = df.withColumn("__of", parts[0]).withColumns(keys)
    cut = store(cut.repartitionByRange("__of", *keys).withColumn("__slice", F.spark_partition_id()))
    counts = cut.groupBy("__of", "__slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("__of").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(F.col("__of").alias("__f"), F.col("__slice").alias("__s"), before.alias("__first"))
    own = F.row_number().over(W.partitionBy("__of", "__slice").orderBy(*keys)) - 1
    out = cut.withColumn("__own", own).join(first, (F.col("__of").eqNullSafe(F.col("__f"))) & (F.col("__slice") == F.col("__s")))
    return out.select(*df.columns, (F.col("__first") + F.col("__own")).alias(name))


def stable_order(nodes: DataFrame) -> DataFrame:
    """id, place: pinned first, then by the previous place, community, directory, depth, kind, path and id.

    The columns pinned (boolean), previous, community, depth and kind are looked at where they
    are there; a null one comes after all values.
    """
    path = F.substring_index("id", "#", 1)
    has = lambda c: [F.col(c).asc_nulls_last()] if c in nodes.columns else []
    keys = {"a_pin": ~F.coalesce(F.col("pinned"), F.lit(False))} if "pinned" in nodes.columns else {}
    for at, c in (("b", "previous"), ("c", "community"), ("e", "depth"), ("f", "kind")):
        if has(c):
            keys[f"{at}_none"], keys[f"{at}_value"] = F.col(c).isNull(), F.col(c)
    keys["d_dir"], keys["g_path"], keys["h_id"] = paths.dir_of(path), path, F.col("id")
    return placed(nodes, *[keys[k] for k in sorted(keys)]).select("id", "place")


def rcm_order(g: Graph) -> DataFrame:
    """id, place: reverse Cuthill-McKee, components by their seed (least degree, then id).

    The order of a breadth-first queue is that of (level, place of the first parent, degree,
    id), so each level is one ranking; there are as many rounds as the longest way from a seed.
    """
    pairs = store(clusters.plain_pairs(g.valid_edges().filter("source <> target")))
    degree = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    n = store(traversal.components(g).join(degree, "id", "left").fillna(0, ["degree"]))
    seeds = n.groupBy("label").agg(F.min(F.struct("degree", "id")).alias("s"))
    seeds = store(placed(seeds.select("label", "s.degree", "s.id"), "degree", "id", name="component"))
    found = [store(seeds.select("label", "id", F.lit(0).cast("long").alias("place"), F.lit(0).alias("level")))]
    seen = found[0].select("id")
    while True:
        last = found[-1]
        hop = last.select(F.col("id").alias("a"), "place").join(pairs, "a").groupBy(F.col("b").alias("id")).agg(F.min("place").alias("parent"))
        new = hop.join(seen, "id", "left_anti").join(n, "id")
        new = store(placed(new, "parent", "degree", "id", within="label").select("label", "id", "place", F.lit(len(found)).alias("level")))
        if new.isEmpty():
            break
        found.append(new)
        seen = store(seen.union(new.select("id"))) if len(found) % 8 == 0 else seen.union(new.select("id"))
    rows = found[0]
    for f in found[1:]:
        rows = rows.union(f)
    rows = rows.join(seeds.select("label", "component"), "label")
    return placed(rows, "component", -F.col("level"), -F.col("place"), name="at").select("id", F.col("at").alias("place"))


def by_component(g: Graph, solve, schema: str, of: DataFrame | None = None) -> DataFrame:
    """``solve(part key, ids in order, link ends a, link ends b)`` of each component, or of those in ``of`` (id, label).

    A component is in one task; ``solve`` gives the columns of ``schema``.
    """
    of = store(traversal.components(g)) if of is None else of
    e = g.valid_edges().filter("source <> target").select("source", "target").distinct().join(of.toDF("source", "label"), "source")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(nodes, links):
        key = nodes.column("label")[0].as_py()
        ids = np.array(sorted(nodes.column("id").to_pylist()), object)
        number = {x: i for i, x in enumerate(ids)}
        ends = sorted((number[s], number[t]) for s, t in zip(links.column("source").to_pylist(), links.column("target").to_pylist(), strict=True))
        a, b = (np.array([p[k] for p in ends], np.int64) for k in (0, 1))
        return pa.table(dict(zip(names, solve(key, ids, a, b), strict=True)))

    return of.select("label", "id").groupBy("label").cogroup(e.groupBy("label")).applyInArrow(run, schema)


def fiedler_order(g: Graph) -> DataFrame:
    """id, place: components by their least id, each along its Laplacian's second axis."""

    def solve(key, ids, a, b):
        order = engines.fiedler(len(ids), a, b)
        return [[key] * len(ids), ids[order].tolist(), list(range(len(ids)))]

    found = by_component(g, solve, "label string, id string, own long")
    return placed(found, "label", "own").select("id", "place")


def barycenter_order(layer: DataFrame, neighbours: DataFrame) -> DataFrame:
    """id, place: a layer (id, place) by the weighted mean place of neighbours (id, pos, weight).

    Nodes without neighbours, or without any weight, count with their own place; ties keep theirs.
    """
    mean = neighbours.groupBy("id").agg((F.sum(F.col("pos") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0))).alias("mean"))
    want = layer.join(mean, "id", "left").select("id", F.coalesce("mean", F.col("place").cast("double")).alias("want"), F.col("place").alias("old"))
    return placed(want, "want", "old").select("id", "place")


def circular_means(neighbours: DataFrame) -> DataFrame:
    """id, angle: the direction of the weighted mean of neighbours' angles (id, angle, weight); null without weight."""
    s = neighbours.groupBy("id").agg(F.sum(F.sin("angle") * F.col("weight")).alias("y"), F.sum(F.cos("angle") * F.col("weight")).alias("x"), F.sum("weight").alias("w"))
    return s.select("id", F.when(F.col("w") != 0, F.atan2("y", "x")).alias("angle"))


def circular_order(ring: DataFrame, neighbours: DataFrame) -> DataFrame:
    """id, place: a ring (id, place) by :func:`circular_means`; nodes without one come last, in their order."""
    want = ring.withColumnRenamed("place", "old").join(circular_means(neighbours), "id", "left")
    return placed(want, F.col("angle").isNull(), "angle", "old").select("id", "place")

"""Degrees and other per-node counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.model import Graph


def degrees(g: Graph) -> DataFrame:
    """id, n_in, n_out, n_calls, n_fan_out: parallel edges of other kinds count, unknown ends do not.

    n_calls counts ``call`` edges whatever their target; n_fan_out counts distinct targets.
    One shuffle by node: each edge gives a row for either end.
    """
    known = g.valid_edges()
    ends = known.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("c"), F.lit(None).cast("string").alias("t"))
    ends = ends.union(known.select("source", F.lit(0), F.lit(1), F.lit(0), "target"))
    ends = ends.union(g.edges.filter("kind = 'call'").select("source", F.lit(0), F.lit(0), F.lit(1), F.lit(None).cast("string")))
    sums = ends.groupBy("id").agg(
        F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.sum("c").alias("n_calls"), F.count_distinct("t").alias("n_fan_out")
    )
    return g.nodes.select("id").join(sums, "id", "left").fillna(0)


def fan_out_above(g: Graph, most: int) -> DataFrame:
    """id, n_fan_out of the nodes with more than ``most`` distinct targets; only sources of more edges than that are looked at."""
    if most < 0:
        return degrees(g).filter(F.col("n_fan_out") > most).select("id", "n_fan_out")
    busy = g.edges.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("source")
    known = Graph(g.nodes, g.edges.join(busy, "source", "left_semi")).valid_edges()
    wide = known.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("n_fan_out")).filter(F.col("n_fan_out") > most)
    return g.nodes.select("id").join(wide, "id")


def outlier_threshold(d: DataFrame, column: str) -> DataFrame:
    """One row: max(6, mean + 2 population deviations) of the non-zero values."""
    seen = d.filter(F.col(column) > 0)
    return seen.agg(F.greatest(F.lit(6.0), F.coalesce(F.avg(column) + 2 * F.stddev_pop(column), F.lit(6.0))).alias("threshold"))


def instability(g: Graph) -> DataFrame:
    """id, ca, ce, instability over import edges, ends not validated."""
    imports = g.edges.filter("kind = 'import'")
    ends = imports.select(F.col("source").alias("id"), F.lit(1).alias("ce"), F.lit(0).alias("ca")).union(imports.select("target", F.lit(0), F.lit(1)))
    out = ends.groupBy("id").agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce"))
    return out.withColumn("instability", F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 6))

"""The property graph: schemas, ids and the pair of DataFrames that carry it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVIDENCE = "struct<filePath:string,line:int,column:int,provider:string,confidence:string>"
NODE_SCHEMA = (
    "ord long, id string, kind string, label string, filePath string, line int, parentFile string, role string, category string, "
    "environment string, runtimes array<string>, externalKind string, version string, dependencyType string"
)
EDGE_SCHEMA = f"ord long, id string, source string, target string, kind string, count long, occurrences array<{EVIDENCE}>"
EVIDENCE_CAP = 25


@dataclass(frozen=True)
class Graph:
    """Nodes and edges; ``ord`` carries the order that first-wins rules go by."""

    nodes: DataFrame
    edges: DataFrame

    def valid_edges(self) -> DataFrame:
        """Edges both of whose ends are nodes."""
        ids = self.nodes.select("id")
        return self.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
            ids.withColumnRenamed("id", "target"), "target", "left_semi"
        )

    def induced(self, ids: DataFrame) -> Graph:
        """The nodes in ``ids`` (id) and the edges between them."""
        keep = ids.select("id").distinct()
        return Graph(self.nodes.join(keep, "id", "left_semi"), Graph(keep, self.edges).valid_edges())


def with_facets(nodes: DataFrame) -> DataFrame:
    """Nodes with all facets that operators look at; those that are not there are null."""
    missing = [c for c in ("role", "category", "environment", "externalKind", "version", "dependencyType") if c not in nodes.columns]
    return nodes.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else nodes


def edge_id(source, target, kind):
    return F.concat(source, F.lit("->"), target, F.lit(":"), kind)


def symbol_id(path, name):
    return F.concat(path, F.lit("#"), name)


def merge_edges(edges: DataFrame) -> DataFrame:
    """Equal edge ids become one: counts add up, the first 25 pieces of evidence stay, by ord."""
    return edges.groupBy("id", "source", "target", "kind").agg(
        F.min("ord").alias("ord"), F.sum("count").alias("count"),
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "occurrences"))), lambda x: x["occurrences"])), 1, EVIDENCE_CAP).alias("occurrences"),
    )


def first_wins(df: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys the one of the least ``ord``."""
    best = df.groupBy(*keys).agg(F.min(F.struct("ord", *[c for c in df.columns if c not in (*keys, "ord")])).alias("x"))
    return best.select(*keys, "x.*").select(*df.columns)

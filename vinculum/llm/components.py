"""Connected components of an edge table, as a checkpointed DataFrame loop."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm.common import lean, materialize, release


@lean
def _contract(batches):
    """A spanning forest of the partition's edges, as stars around each tree's smallest node."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent[p]
            v = p
        return v

    def stars():
        rows = [(v, r) for v in parent if (r := root(v)) != v]
        a, b = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounded memory: what is known so far goes out as stars
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node of ``edges`` (a, b long).

    Each round takes the smallest label among neighbours, then the label's label, until
    nothing changes; the rounds grow with the logarithm of a component's width.  The result is a
    written table, which its reader releases.
    """
    stars = materialize(edges.select("a", "b").mapInArrow(_contract, "a long, b long"))
    both = materialize(stars.union(stars.select("b", "a")).toDF("node", "other").distinct())
    labels = last = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        pulled = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = pulled.join(jump, "label", "left").select(
            "node", F.coalesce(F.least("label", "further"), F.col("label")).alias("label"), "old"
        )
        new = materialize(new)
        changed = not new.filter(F.col("label") != F.col("old")).isEmpty()
        labels = new.select("node", "label")
        if not changed:
            release(stars, both, last)
            labels._written_at = new._written_at
            return labels
        release(last)
        last = new

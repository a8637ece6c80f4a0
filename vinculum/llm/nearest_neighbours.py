"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

Distinct vectors are dealt to shards by hash; a shard's graph is built in one task from a
bounded number of vectors and written to the shared folder as flat neighbour arrays.  The
queries visit every shard; ``ef_search`` holds a recall of 0.9 on independent random vectors
of 64 dimensions, the hardest case, at the full size of a shard: an index row is read, then its queries stream past it.  Exact
copies share one node, which keeps the smallest ids (k + 1 of them can ever be reported).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.llm.common import isolate, materialize
from vinculum.llm.hnsw import Hnsw

_INDEX = "shard int, vectors binary, copies array<array<long>>, nodes array<binary>, links array<binary>, entry long"


def _build(m: int, ef: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        v = np.array(table.column("v").to_pylist(), kind)
        nodes, links, entry = Hnsw.build(v, m, ef).pack()
        return pa.table(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                "vectors": pa.array([v.tobytes()], pa.binary()),
                "copies": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
                "nodes": pa.array([nodes], pa.list_(pa.binary())),
                "links": pa.array([links], pa.list_(pa.binary())),
                "entry": pa.array([entry], pa.int64()),
            }
        )

    return run


def _ask(index: Hnsw, v: np.ndarray, copies: list[list[int]], own: list[int], q: np.ndarray, k: int, ef: int):
    """(query id, vec id, score) of the k nearest ids of each query in this shard."""
    exact = v.astype(np.float64)
    step = max(1, min(256, (1 << 25) // max(1, len(v))))
    for at in range(0, len(q), step):
        found, near = index.search(q[at : at + step], ef)
        for i, rows in enumerate(found):
            rows = rows[rows < len(v)]  # all that were found: the graph's order is that of single precision
            score = (exact[rows] * q[at + i]).sum(1)
            best = sorted((-s, x) for s, r in zip(score.tolist(), rows.tolist(), strict=True) for x in copies[r] if x != own[at + i])[:k]
            for s, x in best:
                yield own[at + i], x, -s


def _search(k: int, ef: int, kind: str):
    """Rows sorted by shard, the index first, then its queries."""

    def run(batches):
        index = v = copies = None
        for batch in batches:
            bits = batch.column("vectors")
            is_index = ~bits.is_null().to_numpy(zero_copy_only=False)
            edges = [0, *np.flatnonzero(is_index).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                at = lo
                if lo < hi and is_index[lo]:
                    row = batch.slice(lo, 1).to_pylist()[0]
                    copies = row["copies"]
                    v = np.frombuffer(row["vectors"], kind).reshape(len(copies), -1)
                    index = Hnsw.unpack(v, row["nodes"], row["links"], row["entry"])
                    at += 1
                if at >= hi or index is None:
                    continue
                q = np.array(batch.column("q").slice(at, hi - at).to_pylist(), np.float64)
                own = batch.column("query_id").slice(at, hi - at).to_pylist()
                out = list(_ask(index, v, copies, own, q, k, ef))
                if out:
                    a, b, c = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"]
                    )

    return run


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    m: int = 24,
    ef_build: int = 128,
    ef_search: int = 400,
    shard_rows: int = 20_000,
    least_shards: int = 8,
) -> DataFrame:
    """The ``k`` nearest found ids by inner product, for the rows that ``queries`` (over ``id``) selects.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller id; a
    query never finds its own id.  Scores are double products of the original vectors.

    Vectors that are null, zero, hold null or non-finite components, have a null id, or a
    length other than the most frequent (ties: the greater) take no part.  Of rows with
    equal ids the smallest vector counts.  An empty table gives no row.
    """
    spark = vectors.sparkSession
    frame, (vec, emb), _ = isolate(vectors, id_col, vector_col)
    kind = "<f4" if frame.schema[emb].dataType.simpleString() == "array<float>" else "<f8"
    if kind == "<f8":
        frame = frame.withColumn(emb, F.col(emb).cast("array<double>"))
    limit = F.lit(float("inf"))
    sound = F.forall(emb, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(emb, lambda x: x != 0)
    rows = frame.select(F.col(vec).cast("long").alias("id"), F.col(emb).alias("v")).filter(
        F.col("id").isNotNull() & F.coalesce(sound, F.lit(False))
    )
    by_size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    top = by_size.agg(F.max(F.struct("n", "d"))["d"].alias("d"), F.sum("n").alias("n")).first()
    if top["d"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == top["d"]).groupBy("id").agg(F.min("v").alias("v"))
    rows = materialize(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}))

    # the k + 1 smallest ids of each distinct vector, by a tree: a vector may be in a third of all rows
    ids = rows.select("id", "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    for salts in (64, 8, 1):
        at = W.partitionBy("h1", "h2", F.col("salt") % salts).orderBy("id")
        ids = ids.withColumn("rn", F.row_number().over(at)).filter(F.col("rn") <= k + 1).drop("rn")
    held = ids.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = held.withColumn("first", F.get("ids", F.lit(0))).join(
        rows.select(F.col("id").alias("first"), "v"), "first"
    )
    shards = max(least_shards, -(-top["n"] // shard_rows))
    index = materialize(
        nodes.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "v", "ids")
        .groupBy("shard")
        .applyInArrow(_build(m, ef_build, kind), _INDEX)
    )
    asked = rows.filter(queries).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = index.unionByName(asked, allowMissingColumns=True)
    order = both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("vectors").isNull())
    found = order.mapInArrow(_search(k, ef_search, kind), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

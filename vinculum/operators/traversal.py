"""Reachability, paths, strongly connected components, communities and cores as DataFrame loops.

Every round is one or two joins on the node id; its result is written to the shared folder,
so plans stay short and lost executors cost one round.  What is left of a graph is finished by one
task as soon as it has at most ``LOCAL`` steps, which that task can hold: the answer is the same,
and a graph of few nodes does not pay for a job a hop.

Larger graphs are numbered in the order of their ids for components and chains, and cut into
blocks of neighbouring numbers (a file and its symbols).  In a round each block goes as far as it
can by itself, so rounds are paid for steps between blocks, not for every step of a chain.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.functions.storage import store
from vinculum.model import Graph

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # no executor needs this package installed

#: Steps (distinct pairs of nodes) that one task takes: about 100 MB.
LOCAL = 400_000


def _in_one_task(rows: DataFrame, solve: Callable[[list, list], Iterator[tuple]], schema: str) -> DataFrame:
    """``solve`` over the two columns of at most about LOCAL rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64()}.get(c.split()[1], pa.string()) for c in schema.split(", ")]

    def run(batches):
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
        found = list(zip(*solve(a, b), strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names)

    return rows.coalesce(1).mapInArrow(run, schema)


def _fits(steps: DataFrame) -> bool:
    return steps.limit(LOCAL + 1).count() <= LOCAL


def _after(a: list, b: list) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for x, y in zip(a, b, strict=True):
        if y is not None:
            out.setdefault(x, []).append(y)
    return out


def _solve_reach(limit: int | None):
    """Rows (node, next), and (start, null)."""

    def solve(a: list, b: list):
        after = _after(a, b)
        front = {x for x, y in zip(a, b, strict=True) if y is None}
        seen, depth = set(front), 0
        while front and (limit is None or depth < limit):
            depth += 1
            front = {y for x in front for y in after.get(x, ())} - seen
            seen |= front
            yield from ((x, depth) for x in front)

    return solve


def _solve_scc(a: list, b: list):
    """Tarjan's algorithm without recursion: (id, least member)."""
    after = _after(a, b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on: set[str] = set()
    for root in sorted(after):
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(held.pop())
                    on.difference_update(members)
                    least = min(members)
                    yield from ((m, least) for m in members)
            elif w not in index:
                index[w] = low[w] = len(index)
                held.append(w)
                on.add(w)
                work.append((w, iter(after.get(w, ()))))
            elif w in on:
                low[v] = min(low[v], index[w])


def _solve_depth(a: list, b: list):
    """Of a graph without cycles: (node, nodes on the longest path that starts there)."""
    after = _after(a, b)
    left = {x: len(ys) for x, ys in after.items()}
    before: dict[str, list[str]] = {}
    for x, ys in after.items():
        for y in ys:
            before.setdefault(y, []).append(x)
    ready = [y for y in before if y not in after]
    depth = dict.fromkeys(ready, 1)
    while ready:
        y = ready.pop()
        for x in before.get(y, ()):
            depth[x] = max(depth.get(x, 1), depth[y] + 1)
            left[x] -= 1
            if not left[x]:
                ready.append(x)
    yield from depth.items()


def _steps(g: Graph, forward: bool | None) -> DataFrame:
    """Distinct (node, next) pairs: along edges, against them, or both ways (None)."""
    e = g.valid_edges().filter("source <> target").select(F.col("source").alias("node"), F.col("target").alias("next"))
    back = e.select(F.col("next").alias("node"), F.col("node").alias("next"))
    return (e if forward else back if forward is False else e.union(back)).distinct()


def reach(g: Graph, start: DataFrame, forward: bool = True, depth: int | None = None) -> DataFrame:
    """id, depth of what the set ``start`` reaches, its own nodes left out."""
    steps = store(_steps(g, forward))
    if _fits(steps) and _fits(start):
        rows = steps.union(start.select("id", F.lit(None).cast("string")).distinct())
        return store(_in_one_task(rows, _solve_reach(depth), "id string, depth int"))
    seen = store(start.select("id").distinct().withColumn("depth", F.lit(0)))
    front, at = seen, 0
    while depth is None or at < depth:
        at += 1
        front = front.join(steps, F.col("id") == F.col("node")).select(F.col("next").alias("id")).distinct()
        front = store(front.join(seen, "id", "left_anti").withColumn("depth", F.lit(at)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.filter("depth > 0")


def neighborhood(g: Graph, start: DataFrame, depth: int) -> DataFrame:
    """id within ``depth`` undirected steps, the start included."""
    e = g.edges.select("source", "target").union(g.edges.select("target", "source")).toDF("source", "target")
    both = Graph(g.nodes, e)
    return reach(both, start, True, depth).select("id").union(start.select("id")).distinct()


def shortest_path(g: Graph, a: str, b: str) -> DataFrame:
    """step, id along one shortest directed path from a to b (least ids first); no row if there is none."""
    spark = g.nodes.sparkSession
    start = spark.createDataFrame([(a,)], "id string")
    if a == b:
        return start.select(F.lit(0).alias("step"), "id")
    found = store(reach(g, start).union(start.withColumn("depth", F.lit(0))))
    row = found.filter(F.col("id") == b).first()
    if row is None:
        return start.select(F.lit(0).alias("step"), "id").limit(0)
    steps, here, path = store(_steps(g, False)), b, [(row["depth"], b)]
    for at in range(row["depth"] - 1, -1, -1):
        prior = steps.filter(F.col("node") == here).join(found.filter(F.col("depth") == at), F.col("next") == F.col("id"))
        here = prior.agg(F.min("id")).first()[0]
        path.append((at, here))
    return spark.createDataFrame(sorted(path), "step int, id string")


def why_connected(g: Graph, a: str, b: str) -> DataFrame:
    """step, source, target, kind: a shortest path with the kind of each hop's first edge (by ord, or id)."""
    p = shortest_path(g, a, b)
    hops = p.select("step", F.col("id").alias("source")).join(p.select((F.col("step") - 1).alias("step"), F.col("id").alias("target")), "step")
    kinds = g.edges.groupBy("source", "target").agg(F.min_by("kind", "ord" if "ord" in g.edges.columns else "id").alias("kind"))
    return hops.join(kinds, ["source", "target"]).select("step", "source", "target", "kind")


def blast_radius(g: Graph, start: DataFrame) -> DataFrame:
    """facet (total, package, file, kind), name, n: what depends on the start, and the edges among them."""
    hit = store(reach(g, start, forward=False).select("id"))
    n = g.nodes.join(hit, "id", "left_semi")
    from vinculum.functions.paths import top_folder

    kind = F.col("kind") if "kind" in g.nodes.columns else F.lit("")
    total = n.agg(F.count("*").alias("n")).select(F.lit("total").alias("facet"), F.lit("").alias("name"), "n")
    by_package = n.groupBy(top_folder(F.col("filePath"), kind).alias("name")).agg(F.count("*").alias("n")).select(F.lit("package"), "name", "n")
    if "parentFile" in g.nodes.columns:
        by_package = by_package.union(n.groupBy(F.col("parentFile").alias("name")).agg(F.count("*").alias("n")).select(F.lit("file"), "name", "n"))
    inside = g.induced(hit.union(start.select("id"))).edges
    by_kind = inside.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind"), "name", "n")
    return total.union(by_package).union(by_kind)


def components(g: Graph) -> DataFrame:
    """id, label: the least id in the undirected component."""
    steps = store(_steps(g, None))
    labels = store(g.nodes.select("id", F.col("id").alias("label")).distinct())
    while True:
        near = steps.join(labels.withColumnRenamed("id", "next"), "next").groupBy("node").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("id") == F.col("node"), "left").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = store(new.join(jump, "label").select("id", F.least("label", "further").alias("label"), "old"))
        done = new.filter("label <> old").isEmpty()
        labels = new.select("id", "label")
        if done:
            return labels


def _label(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """id, color: the greatest id that reaches the node."""
    color = store(nodes.select("id", F.col("id").alias("color")))
    while True:
        near = steps.join(color, F.col("node") == F.col("id")).groupBy(F.col("next").alias("to")).agg(F.max("color").alias("near"))
        new = store(color.join(near, F.col("id") == F.col("to"), "left").select("id", F.greatest("color", "near").alias("color"), F.col("color").alias("old")))
        done = new.filter("color <> old").isEmpty()
        color = new.select("id", "color")
        if done:
            return color


# --- components and chains -----------------------------------------------------------------

_PART = 33  # bits of monotonically_increasing_id below the partition's number


@dataclass(frozen=True)
class _Numbered:
    """ids (id, k): k counts the ids in their order from 0; steps (node, next): distinct pairs of numbers."""

    ids: DataFrame
    steps: DataFrame
    n: int


def _numbered(g: Graph) -> _Numbered:
    ids = g.nodes.select("id").filter("id IS NOT NULL").repartitionByRange("id").distinct().sortWithinPartitions("id")
    ids = store(ids.withColumn("at", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in ids.groupBy(F.shiftright("at", _PART).alias("part")).count().collect()}
    first = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0) + 1))]).tolist()
    start = F.get(F.array(*[F.lit(x).cast("long") for x in first]), F.shiftright("at", _PART).cast("int"))
    ids = ids.select("id", (start + F.col("at").bitwiseAND(F.lit((1 << _PART) - 1))).alias("k"))
    e = g.edges.filter("source <> target").select("source", "target")
    e = e.join(ids.toDF("source", "node"), "source").join(ids.toDF("target", "next"), "target")
    return _Numbered(ids, store(e.select("node", "next").distinct()), first[-1])


def _settle(batches):
    """Of a block's rows (node, next, null) and (node, null, least depth): the nodes whose steps all lead to settled ones, and what is open."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    node, nxt, depth = (c.combine_chunks().fill_null(-1).to_numpy() for c in table.columns)
    keys, own = np.unique(node, return_inverse=True)
    best, step = np.ones(len(keys), np.int32), nxt >= 0
    np.maximum.at(best, own[~step], depth[~step])
    source, target = own[step], nxt[step]
    left = np.bincount(source, minlength=len(keys))
    at = np.minimum(np.searchsorted(keys, target), len(keys) - 1)
    inside = np.flatnonzero(keys[at] == target)
    inside = inside[np.argsort(at[inside], kind="stable")]  # by the node they lead to
    before, many = source[inside], np.bincount(at[inside], minlength=len(keys))
    start = np.cumsum(many) - many
    done, ready = np.zeros(len(keys), bool), np.flatnonzero(left == 0)
    while len(ready):
        done[ready] = True
        runs = many[ready]
        x = before[np.repeat(start[ready] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())]
        np.maximum.at(best, x, np.repeat(best[ready] + 1, runs))
        np.subtract.at(left, x, 1)
        ready = np.unique(x[left[x] == 0])
    gone = np.zeros(len(target), bool)
    gone[inside] = done[at[inside]]
    rest = np.flatnonzero(~gone)
    names = ["node", "next", "depth", "done"]
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(keys), pa.int64()), pa.array(best), pa.array(done)], names)
    yield pa.RecordBatch.from_arrays([pa.array(keys[source[rest]]), pa.array(target[rest]), pa.nulls(len(rest), pa.int32()), pa.array(np.zeros(len(rest), bool))], names)


def _rows(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """node, next, depth: the steps, and for each node (k) a row with the least depth that it can have."""
    return steps.select("node", "next", F.lit(None).cast("int").alias("depth")).union(nodes.select("k", F.lit(None).cast("long"), F.lit(1)))


def _back(steps: DataFrame) -> DataFrame:
    return steps.select(F.col("next").alias("node"), F.col("node").alias("next"))


def _peeled(rows: DataFrame, n: int, size: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(node, depth) of what is settled, and the open rows; ``size`` is about that of ``rows``.

    Nodes without open steps settle, block by block as far as that goes, then between blocks:
    ``whole``, until all have (there must be no cycle); else until the rest fits in one task or
    only nodes are left that reach a cycle.
    """
    done = None
    while True:
        parts = max(1, -(-size // max(1, LOCAL)))
        block = F.expr(f"CAST(node * {parts}L DIV {max(1, n)}L AS INT)")
        out = store(rows.repartitionById(parts, block).mapInArrow(_settle, "node long, next long, depth int, done boolean"))
        new, rest = out.filter("done").select("node", "depth"), out.filter("NOT done").select("node", "next", "depth")
        done = new if done is None else done.union(new)
        rows = rest.join(new.toDF("next", "d"), "next", "left")
        rows = rows.select("node", F.when(F.col("d").isNull(), F.col("next")).alias("next"), F.coalesce(F.col("d") + 1, "depth").alias("depth"))
        size = rest.count()
        if not size or not whole and (size <= LOCAL or new.isEmpty()):
            return done, rows


def _from_sources(num: _Numbered) -> tuple[DataFrame, DataFrame]:
    """(node, depth) of the nodes that no cycle reaches, the longest path that ends there, and open rows against the steps of the others."""
    done, rows = _peeled(_rows(num.ids.select("k"), _back(num.steps)), num.n, num.n + num.steps.count(), False)
    return done, store(rows)


def _cycles(num: _Numbered, steps: DataFrame) -> DataFrame:
    """id, scc (numbers; the least member) of nodes in components of more than one: trim, colour forwards, confirm backwards, repeat.

    ``steps`` hold all cycles, in one direction or the other.
    """
    done = num.steps.toDF("id", "scc").limit(0)
    while not _fits(steps):
        for _ in range(2):  # what has no way in goes, what has no way out
            nodes = store(steps.select(F.col("node").alias("k")).union(steps.select("next")).distinct())
            _, rows = _peeled(_rows(nodes, _back(steps)), num.n, nodes.count() + steps.count(), False)
            steps = store(rows.filter("next IS NOT NULL").select("node", "next"))
            if _fits(steps):
                break
        else:
            nodes = steps.select(F.col("node").alias("k")).union(steps.select("next")).distinct()
            color = _label(nodes.toDF("id"), steps)
            # within a colour, what reaches the node that gave it
            found = front = store(color.filter("id = color"))
            inside = steps.join(color.toDF("node", "c1"), "node").join(color.toDF("next", "c2"), "next").filter("c1 = c2").select("node", "next")
            inside = store(inside)
            while not front.isEmpty():
                front = front.join(inside, F.col("id") == F.col("next")).select(F.col("node").alias("id"), "color").distinct()
                front = store(front.join(found, "id", "left_anti"))
                found = found.union(front)
            found = store(found)
            least = found.groupBy("color").agg(F.min("id").alias("scc"), F.count("*").alias("n")).filter("n > 1")
            done = done.union(found.join(least, "color").select("id", "scc"))
            steps = store(steps.join(found, F.col("node") == F.col("id"), "left_anti").join(found, F.col("next") == F.col("id"), "left_anti"))
            if steps.isEmpty():
                return store(done)
    last = store(_in_one_task(steps, _solve_scc, "id long, scc long"))
    return store(done.union(last.join(last.filter("id <> scc").select("scc").distinct(), "scc", "left_semi").select("id", "scc")))


def _named(num: _Numbered, cycles: DataFrame) -> DataFrame:
    sized = cycles.groupBy("scc").agg(F.count("*").alias("size")).join(num.ids.select(F.col("id").alias("name"), F.col("k").alias("scc")), "scc")
    found = store(cycles.join(sized, "scc").select(F.col("id").alias("k"), "name", "size"))
    return num.ids.join(found, "k", "left").select("id", F.coalesce("name", "id").alias("scc"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))


def _merged(rows: DataFrame, cycles: DataFrame) -> DataFrame:
    """Rows with components for their members, without the steps inside."""
    rows = rows.join(cycles.toDF("node", "s"), "node", "left").join(cycles.toDF("next", "t"), "next", "left")
    rows = rows.select(F.coalesce("s", "node").alias("node"), F.coalesce("t", "next").alias("next"), "depth")
    return rows.filter("next IS NULL OR node <> next")


def _is_large(g: Graph) -> bool:
    return not _fits(g.edges.select("source"))


def scc(g: Graph) -> DataFrame:
    """id, scc (least member), size."""
    if _is_large(g):
        num = _numbered(g)
        return _named(num, _cycles(num, _from_sources(num)[1].filter("next IS NOT NULL").select("node", "next")))
    found = store(_in_one_task(store(_steps(g, True)), _solve_scc, "id string, scc string"))
    nodes = g.nodes.select("id").distinct()
    done = store(nodes.join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc")))
    return done.join(done.groupBy("scc").agg(F.count("*").alias("size")), "scc").select("id", "scc", "size")


def _small_chains(g: Graph, of: DataFrame) -> DataFrame:
    a, b = of.select(F.col("id").alias("node"), F.col("scc").alias("s")), of.select(F.col("id").alias("next"), F.col("scc").alias("t"))
    steps = store(_steps(g, True).join(a, "node").join(b, "next").filter("s <> t").select("s", "t").distinct())
    found = _in_one_task(steps, _solve_depth, "scc string, depth int")
    return store(of.select("scc").distinct().join(found, "scc", "left").select("scc", F.coalesce("depth", F.lit(1)).alias("depth")))


def deepest(g: Graph) -> tuple[DataFrame, DataFrame]:
    """``scc``, and one row: the greatest depth of ``longest_chain`` (null without nodes), found from the paths' ends."""
    if not _is_large(g):
        of = store(scc(g))
        return of, _small_chains(g, of).agg(F.max("depth").alias("depth"))
    num = _numbered(g)
    done, rows = _from_sources(num)
    cycles = _cycles(num, rows.filter("next IS NOT NULL").select("node", "next"))
    more, _ = _peeled(_merged(rows, cycles), num.n, rows.count(), True)
    return _named(num, cycles), done.union(more).agg(F.max("depth").alias("depth"))


def longest_chain(g: Graph) -> DataFrame:
    """scc, depth: nodes of the condensation on the longest path that starts there."""
    if not _is_large(g):
        return _small_chains(g, store(scc(g)))
    num = _numbered(g)
    cycles = _cycles(num, _from_sources(num)[1].filter("next IS NOT NULL").select("node", "next"))
    rows = _merged(_rows(num.ids.select("k"), num.steps), cycles)
    done, _ = _peeled(rows, num.n, num.n + num.steps.count(), True)
    return done.join(num.ids.select(F.col("id").alias("scc"), F.col("k").alias("node")), "node").select("scc", "depth")


def communities(g: Graph, rounds: int = 20) -> DataFrame:
    """id, community: synchronous label propagation with a self-vote; ties go to the least label.

    Numbered by the least node, from 1.
    """
    steps = store(_steps(g, None))
    labels = store(g.nodes.select("id", F.col("id").alias("label")).distinct())
    linked = store(steps.select(F.col("node").alias("id")).distinct())
    for _ in range(rounds):
        votes = steps.join(labels.withColumnRenamed("id", "next"), "next").select(F.col("node").alias("id"), "label")
        votes = votes.union(labels.join(linked, "id", "left_semi")).groupBy("id", "label").agg(F.count("*").alias("n"))
        # most votes, then the least label: the least of (-votes, label)
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("best"))
        new = store(labels.join(best, "id", "left").select("id", F.coalesce("best", "label").alias("label"), F.col("label").alias("old")))
        done = new.filter("label <> old").isEmpty()
        labels = new.select("id", "label")
        if done:
            break
    first = labels.groupBy("label").agg(F.min("id").alias("first"))
    number = F.row_number().over(W.orderBy("first"))
    return labels.join(first.withColumn("community", number), "label").select("id", "community")


def coreness(g: Graph) -> DataFrame:
    """id, core: peel what has at most k neighbours left, k growing to the least degree left."""
    steps = store(_steps(g, None))
    left = store(g.nodes.select("id").distinct())
    done, k = left.withColumn("core", F.lit(0)).limit(0), 0
    while True:
        d = steps.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("d"))
        d = store(left.join(d, "id", "left").fillna(0, ["d"]))
        least = d.agg(F.min("d")).first()[0]
        if least is None:
            return done
        k = max(k, least)
        gone = store(d.filter(F.col("d") <= k).select("id", F.lit(k).alias("core")))
        done = done.union(gone)
        left = store(d.join(gone, "id", "left_anti").select("id"))
        steps = store(steps.join(gone, F.col("node") == F.col("id"), "left_anti").join(gone, F.col("next") == F.col("id"), "left_anti"))


def reached_by_each(g: Graph, starts: DataFrame) -> DataFrame:
    """start, n: how many nodes depend on each of ``starts`` (id).

    Few steps go to all tasks, which walk from their own starts; else (start, node) pairs grow
    in one loop.
    """
    steps = store(_steps(g, False))
    starts = starts.select("id").distinct()
    if _fits(steps):
        held = g.nodes.sparkSession.sparkContext.broadcast(steps.toArrow())  # at most LOCAL rows

        def run(batches):
            after = _after(*(held.value.column(c).to_pylist() for c in ("node", "next")))
            for batch in batches:
                ids, counts = batch.column(0).to_pylist(), []
                for start in ids:
                    seen, front = {start}, [start]
                    while front:
                        front = [y for y in {y for x in front for y in after.get(x, ())} if y not in seen]
                        seen.update(front)
                    counts.append(len(seen) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(counts, pa.int64())], ["start", "n"])

        return starts.repartition("id").mapInArrow(run, "start string, n long")
    seen = front = store(starts.select(F.col("id").alias("start"), F.col("id").alias("node")))
    while True:
        front = front.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        front = store(front.join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.groupBy("start").agg((F.count("*") - 1).alias("n"))

"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source's target divided by its size is how often each of its documents is wanted, r.
Every document is taken floor(r) times for certain; the rest of the target is a sample of a
fixed number of words: documents are ranked by random odds over inclusion odds, u/(1-u) :
p/(1-p), and the first ones are taken until the words that are left of the target are reached
as nearly as whole documents allow.  Inclusion is unequal: the odds of p = r - floor(r) are
multiplied by the document's size over the mean size of its source (or by ``weight_col``).

The cut is found without ordering a source in one task: documents are counted by a fixed grid
of ranks, running sums over the grid give the cell in which the target falls, and the same is
done within that cell, then among its ranks, then, as many rows can share id and size and so
their rank, among a grid of row numbers.  Only rows of the last cell are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.llm.common import WORD, isolate, materialize, release, restore

GRID = 1024
#: Levels of the search for the cut, coarse to fine; rows of one "_tie" differ by "_row" alone.
LEVELS = ("_cell", "_fine", "_key", "_tie")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """A written table with "_n", the place of each row in a total order, from 0; no task sees more than a range of it."""
    ranges = materialize(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranges.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition
        offsets.append((r["_part"], before))
        before += r["n"]
    if not offsets:
        return ranges.withColumn("_n", F.lit(0).cast("long")).drop("_part")
    first = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair])
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    out = materialize(ranges.withColumn("_n", own + first[F.col("_part").cast("long")]).drop("_part"))
    release(ranges)
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, n_docs, target for a table (source, source_size, n_docs) with a row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the total of all
    sizes; no target exceeds ``cap`` times its source's size, and the excess goes to the
    others by weight.  Each round caps those whose share at the present level is too large;
    the driver holds two sums.
    """
    order = (F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = numbered(sizes, *order).withColumn("weight", F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("_n") % len(weights)))
    room = cap * F.col("source_size")
    left, weigh, capped = 0, 0, -1
    over = F.lit(False)
    while True:
        r = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(over, room)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weigh"), F.count_if(over).alias("capped"),
        ).first()
        left, weigh = r["all"] - r["held"], r["weigh"]
        if r["capped"] == capped or not weigh:
            break
        capped = r["capped"]
        over = F.col("weight") * F.lit(left) > room * F.lit(weigh)
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(max(1, weigh)).cast("double")
    return weighed.select("source", "source_size", "n_docs", F.when(over, room.cast("double")).otherwise(share).alias("target"))


def _uniform(doc: Column, seed: str) -> Column:
    """A number in (0, 1) from the id alone: 52 bits of an md5, the same in every engine."""
    hex_ = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(hex_, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: str = "mix:",
    weight_col: str | None = None,
    size_col: str | None = None,
) -> DataFrame:
    """How often each document is taken, so that each source meets its target of words.

    Returns all columns and size (words of the text, or ``size_col``, null counting as 0),
    source_size, target (double, the source's), copies and taken (size times copies), which
    replace columns so named.

    Null and empty texts have size 0 and are taken by the same rule, which costs no word.  A
    null source is one more source, last in order.  The random number depends on the id
    alone, so reruns agree; rows of equal ids (null counts as '') share it and are put in
    order of size, and rows of equal id and size are taken one by one, so that the target is
    met within half a document all the same.  Sources of size 0 have target 0 and no copies.
    ``weight_col`` (positive, null counts as 1) multiplies the inclusion odds in place of the
    relative size.  An empty table gives an empty table.
    """
    wanted = [id_col, source_col, size_col or text_col] + ([weight_col] if weight_col else [])
    frame, (doc, source, sized, *odds), pairs = isolate(docs, *wanted)
    size = F.coalesce(F.col(sized).cast("long"), F.lit(0)).cast("long") if size_col else word_count(F.col(sized))
    held = materialize(
        frame.withColumns({
            "_size": size, "_id": F.coalesce(F.col(doc).cast("string"), F.lit("")), "_row": F.monotonically_increasing_id(),
            "_boost": F.coalesce(F.col(odds[0]).cast("double"), F.lit(1.0)) if odds else F.lit(1.0),
        })
    )
    sizes = held.groupBy(F.col(source).alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sizes, weights, cap).withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # how many whole copies are certain, the odds of one more, and the words these have to make
    targets = targets.withColumns({"_whole": F.floor(ratio), "_p": ratio - F.floor(ratio)})
    marks = materialize(targets.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))

    thin = held.select(F.col(source).alias("_s"), "_size", "_id", "_row", "_boost")
    rank = _ranked(thin, "_s", marks, seed, not odds)
    older = []
    for by in LEVELS:
        older.append(marks)
        marks = materialize(_cut(rank, marks, by))
        rank = rank.select(*thin.columns, "_q", *LEVELS).join(marks, F.col("_s").eqNullSafe(F.col("_source")))
        rank = rank.filter(F.col(by) == F.col(f"{by}_cut"))
    # the rows of the last cell, in order: one is taken while half of it at least is wanted
    upto = F.sum("_size").over(W.partitionBy("_s").orderBy("_row").rowsBetween(W.unboundedPreceding, 0))
    taken = rank.withColumn("_in", upto - F.col("_size") / 2.0 <= F.col("_rest")).filter("_in")
    taken = taken.groupBy(F.col("_s").alias("_t")).agg(F.max("_row").alias("_last"))
    older.append(marks)
    marks = materialize(marks.join(taken, F.col("_source").eqNullSafe(F.col("_t")), "left").drop("_t"))
    release(*older)

    out = _ranked(held, source, marks, seed, not odds)
    place, cut = F.struct(*LEVELS), F.struct(*[F.col(f"{x}_cut") for x in LEVELS])
    # without a cut the whole source falls short of what is left, by rounding: all is taken
    more = F.when(F.col(f"{LEVELS[-1]}_cut").isNull(), F.col("_p") > 0.5).when(place < cut, True).when(place > cut, False)
    more = more.otherwise(F.coalesce(F.col("_row") <= F.col("_last"), F.lit(False)))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("_whole") + more.cast("long"))).otherwise(0).cast("long")
    out = out.withColumn("_copies", copies).withColumn("_taken", F.col("_size") * F.col("_copies"))
    return restore(out, pairs, {"size": "_size", "source_size": "source_size", "target": "target", "copies": "_copies", "taken": "_taken"})


def _ranked(df: DataFrame, source: str, marks: DataFrame, seed: str, by_size: bool) -> DataFrame:
    """With its source's marks, each document's Pareto rank _q and its place at each level."""
    p = F.least(F.greatest(F.col("_p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    u = _uniform(F.col("_id"), seed)
    share = F.col("_q") / (1 + F.col("_q"))  # the odds as a share of 1, so that the grid is finite
    df = df.join(marks, F.col(source).eqNullSafe(F.col("_source")))
    size = F.greatest(F.col("_size"), F.lit(1)).cast("double") * F.col("n_docs").cast("double") / F.greatest(F.col("source_size"), F.lit(1)).cast("double")
    df = df.withColumn("_q", (u / (1 - u)) / (p / (1 - p) * (size if by_size else F.col("_boost"))))
    df = df.withColumn("_cell", F.floor(share * GRID))
    df = df.withColumn("_fine", F.floor((share * GRID - F.col("_cell")) * GRID))
    return df.withColumns({"_key": F.struct("_q", "_id", "_size"), "_tie": F.floor(F.col("_row") % (GRID * GRID) / GRID)})


def _cut(rank: DataFrame, marks: DataFrame, by: str) -> DataFrame:
    """Marks with the cell in which the running sum of a source passes _rest; _rest less the sum before it.

    A document that lies across _rest is in the cell if half of it at least is wanted.
    """
    cells = rank.groupBy("_s", by).agg(F.sum("_size").alias("s"), F.first("_rest").alias("rest"))
    upto = F.sum("s").over(W.partitionBy("_s").orderBy(by).rowsBetween(W.unboundedPreceding, 0))
    cells = cells.withColumn("upto", upto).filter(F.col("upto") >= F.col("rest"))
    cut = cells.groupBy(F.col("_s").alias("_t")).agg(F.min(F.struct(F.col(by), (F.col("upto") - F.col("s")).alias("before"))).alias("c"))
    joined = marks.join(cut, F.col("_source").eqNullSafe(F.col("_t")), "left")
    return joined.withColumn(f"{by}_cut", F.col("c")[by]).withColumn("_rest", F.col("_rest") - F.coalesce("c.before", F.lit(0))).drop("_t", "c")

"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles (tokens, 64-bit hashes); texts of the same words are one
*class*, and only one document of a class is looked at.

1. Frequencies.  Blocks of classes send their tokens' fingerprints, sorted and delta-coded, to
   the fingerprints' shards; a shard counts how many classes hold each one and answers for
   those that two or more hold.  A class of which more than a fifth (at a similarity of 0.8)
   is its own alone can link with nothing and is done.  Of the others the shared fingerprints
   are kept, rarest first.
2. Tokens.  Let x and y link, and t be their first common token in the order (frequency,
   fingerprint).  What stands before t in x is not common, so the overlap is at most n - place,
   and it must be at least 0.8 / 1.8 of both sizes: so t bounds the size of a partner,
   ``most``.  A class has a posting for each token whose bound still admits a partner.  Every
   linked pair shares a posting whose bounds admit both: nothing is lost by looking no further.
3. Leaders: of each token the class with the fewest rarer tokens is compared with one round
   of the others, each with the leader it shares most tokens with.  This is linear and joins
   most of a large group of near copies without meeting its pairs; it only saves work.
4. Groups: classes of one component (others: those that share their most common token) are
   similar and are dealt into groups of about ``CHUNK``.  The matrix has a row for each token
   of a group's union of postings, with the group's sizes and bounds.  A class probes groups
   with members of larger components through the tokens that still span two components; a
   group met is opened only if its whole token union holds enough of the class's tokens, and
   one link to each component is kept.
5. Components of all links found.

Fingerprints are as wide as the corpus asks for (48 bits or more): the sets compared are those
fingerprints that two classes hold, which is all that an overlap can consist of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.llm.common import byte_rows, isolate, lean, materialize, parts_for, release
from vinculum.llm.compact import binaries, lists, narrow, pack_sorted, unpack_sorted, widen
from vinculum.llm.components import components
from vinculum.llm.line_dedup import Bloom

#: Classes in a group; queries that one task compares with a group; leader rounds.
CHUNK, LOAD, ROUNDS = 128, 512, 2
_HEAD = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("n", "<i8")])
_NODES = "node long, hi long, lo long, n int, items binary, t array<long>, most array<int>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(words: list[bytes], hashes: dict[bytes, int], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` are one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    take = min(width, n)
    h = np.full(n - take + 1, take, np.uint64)
    for i in range(take):
        h = (h ^ w[i : n - take + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def need(n, m, percent: int):
    """Tokens that sets of sizes n and m must share to link (whole numbers, arrays or columns' SQL alike)."""
    return -(-percent * (n + m) // (100 + percent))


def bounds(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The largest size of a partner whose first common token is at ``place``."""
    return (100 + percent) * (n - place) // percent - n


def _digest(words: list[bytes]) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), ">i8")
    return int(both[0]), int(both[1])


@lean
def _keys(batches):
    """(doc, hi, lo, words): the hash of each text's words, null for none."""
    for batch in batches:
        ids = batch.column(0)
        for at, texts in byte_rows(batch, 1):
            split = [t.lower().split() for t in texts]
            keys = [_digest(w) if w else (None, None) for w in split]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(texts)), *(pa.array(x, pa.int64()) for x in zip(*keys, strict=True)), pa.array(list(map(len, split)), pa.int64())],
                ["doc", "hi", "lo", "words"],
            )


def _requests(width: int, bits: int, log_shards: int, wanted, block_tokens: int):
    """Blocks of classes: a head row (width 0), and a row of sorted fingerprints and places in the block for each shard."""

    def flush(block: int, heads: list, sets: list[np.ndarray]):
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) >> np.uint64(64 - bits)
        own = np.repeat(np.arange(len(sets), dtype="<u2"), n)
        order = np.argsort(flat, kind="stable")
        flat, own = flat[order], own[order]
        head = np.array([(*h, k) for h, k in zip(heads, n.tolist(), strict=True)], _HEAD)
        shard = (flat >> np.uint64(bits - log_shards)).astype(np.int64)
        found, starts = np.unique(shard, return_index=True)
        ends = [*starts[1:].tolist(), len(flat)]
        rows = [(hash(block) % (1 << log_shards), block, 0, head.tobytes(), b"")]
        for s, a, b in zip(found.tolist(), starts.tolist(), ends, strict=True):
            rows.append((s, block, *pack_sorted(flat[a:b] - np.uint64(s << (bits - log_shards))), own[a:b].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "block", "width", "a", "b"])

    def run(batches):
        part, serial, size = TaskContext.get().partitionId(), 0, 0
        hashes, heads, sets = _Hashes(), [], []
        bloom = Bloom.unpack(*wanted.value)
        for batch in batches:
            keep = bloom.has(batch.column(0).fill_null(-1).to_numpy().view(np.uint64)) if batch.num_rows else np.zeros(0, bool)
            batch = batch.filter(pa.array(keep))
            for _, texts in byte_rows(batch, 1, 64):
                for text in texts:
                    words = text.lower().split()
                    if words:
                        heads.append(_digest(words))
                        sets.append(shingles(words, hashes, width))
                        size += len(sets[-1])
                if len(hashes) > 250_000:
                    hashes.clear()
                if size >= block_tokens or len(sets) > 60_000:
                    yield flush(part << 20 | serial, heads, sets)
                    serial, size, heads, sets = serial + 1, 0, [], []
        if sets:
            yield flush(part << 20 | serial, heads, sets)

    return lean(run)


def _counted(bits: int, log_shards: int):
    """Rows sorted by shard: heads go through; of fingerprints that two classes hold: the number, whose it is, and the frequency's logarithm."""

    def answer(shard: int, rows: list):
        parts = [unpack_sorted(w, a) for _, w, a, _ in rows]
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        run = np.cumsum(first) - 1
        count = np.bincount(run)
        level = np.ceil(np.log2(count)).astype(np.uint8)  # 0: one class alone
        own = np.zeros(len(flat), np.uint8)
        own[order] = level[run]
        out, at = [], 0
        for (block, _, _, b), part in zip(rows, parts, strict=True):
            mine = own[at : at + len(part)]
            at += len(part)
            shared = mine > 0
            if shared.any():
                wide, data = narrow(part[shared] + np.uint64(shard << (bits - log_shards)))
                out.append((block, wide, data, np.frombuffer(b, "<u2")[shared].tobytes(), mine[shared].tobytes()))
        return out

    def run(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for shard, block, width, a, b in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "width", "a", "b")), strict=True):
                if not width:
                    out.append((block, 0, a, b"", b""))
                    continue
                if shard != now:
                    if held:
                        out += answer(now, held)
                    now, held = shard, []
                held.append((block, width, a, b))
            if out:
                yield _replies(out)
        if held and (out := answer(now, held)):
            yield _replies(out)

    return lean(run)


def _replies(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "width", "a", "b", "c"])


def _placed(percent: int, item_bytes: int):
    """Rows sorted by block, its head first: the classes, with shared fingerprints and postings of those that may link."""

    def out(block: int, head: np.ndarray, rows: list):
        n = head["n"].astype(np.int64)
        tokens = np.concatenate([widen(w, a) for w, a, _, _ in rows]) if rows else np.zeros(0, np.uint64)
        own = np.concatenate([np.frombuffer(b, "<u2") for _, _, b, _ in rows]) if rows else np.zeros(0, np.uint16)
        level = np.concatenate([np.frombuffer(c, np.uint8) for _, _, _, c in rows]) if rows else np.zeros(0, np.uint8)
        shared = np.bincount(own, minlength=len(n))
        may = (100 * shared >= percent * n) & (shared > 0)
        keep = may[own]
        tokens, own, level = tokens[keep], own[keep], level[keep]
        order = np.argsort(tokens, kind="stable")
        order = order[np.argsort(own[order], kind="stable")]  # by class, then fingerprint
        tokens, own, level = tokens[order], own[order].astype(np.int64), level[order]
        counts = np.where(may, shared, 0)
        items = binaries(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :item_bytes], counts, may)
        order = np.argsort(own << 8 | level, kind="stable")  # by class, frequency, fingerprint
        tokens, own = tokens[order], own[order]
        place = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + np.maximum(n - shared, 0)[own]
        most = bounds(n[own], place, percent)
        ok = most >= -(-percent * n[own] // 100)
        posted = np.bincount(own[ok], minlength=len(n))
        node = (block << 16) + np.arange(len(n))
        return pa.RecordBatch.from_arrays(
            [pa.array(node, pa.int64()), pa.array(head["hi"], pa.int64()), pa.array(head["lo"], pa.int64()), pa.array(n.astype(np.int32)),
             items, lists(tokens[ok].view(np.int64), posted, pa.int64()), lists(np.minimum(most[ok], 2**31 - 1).astype(np.int32), posted, pa.int32())],
            [c.split()[0] for c in _NODES.split(", ")],
        )

    def run(batches):
        now, head, held = None, None, []
        for batch in batches:
            for block, width, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("block", "width", "a", "b", "c")), strict=True):
                if block != now:
                    if head is not None:
                        yield out(now, head, held)
                    now, head, held = block, None, []
                if width:
                    held.append((width, a, b, c))
                else:
                    head = np.frombuffer(a, _HEAD)
        if head is not None:
            yield out(now, head, held)

    return lean(run)


def _opened(percent: int, item_bytes: int):
    """Rows sorted by group and split, members first: each query's links to members of larger components."""

    def run(batches):
        group, held, flat = None, [], None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("group", "split", "asks", "node", "n", "size", "label")]
            sets = (x for _, some in byte_rows(batch, "items") for x in some)
            for g, split, asks, node, n, size, label, items in zip(*columns, sets, strict=True):
                if (g, split) != group:
                    group, held, flat = (g, split), [], None
                q = widen(item_bytes, items)
                if not asks:
                    held.append((node, n, size, label, q))
                    continue
                if not held:
                    continue
                if flat is None:
                    nodes, sizes, ranks, labels, whole = zip(*held, strict=True)
                    flat, own = np.concatenate(whole), np.fromiter(map(len, whole), np.int64, len(whole))
                    starts, union = np.cumsum(own) - own, np.unique(flat)
                    sizes, ranks, labels = np.array(sizes), np.array(ranks), np.array(labels)
                larger = (ranks > size) | (ranks == size) & (labels > label)
                larger &= (100 * sizes >= percent * n) & (percent * sizes <= 100 * n)
                if not larger.any():
                    continue
                at = np.minimum(np.searchsorted(union, q), len(union) - 1)
                if int((union[at] == q).sum()) < need(n, int(sizes[larger].min()), percent):
                    continue  # the group's union holds too little of the query: it stays closed
                at = np.minimum(np.searchsorted(q, flat), len(q) - 1)
                both = np.add.reduceat((q[at] == flat).astype(np.int64), starts)
                ok = np.flatnonzero(larger & (both >= need(n, sizes, percent)))
                # one link to each component is enough
                out += [(node, nodes[int(i)]) for i in ok[np.unique(labels[ok], return_index=True)[1]]]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lean(run)


def ids_filter(ids: DataFrame, limit: int):
    """A Bloom filter of ids as (log_m, bits), or None beyond ``limit`` bytes; built by shards, merged at the driver."""
    n = ids.count()
    log_m = max(10, int(np.ceil(np.log2(max(1, 16 * n)))))
    if 1 << log_m > 8 * limit:
        return None

    def run(batches):
        f = Bloom(log_m)
        for batch in batches:
            f.add(batch.column(0).fill_null(-1).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([f.pack()], pa.binary())], ["bits"])

    bits = np.zeros((1 << log_m) // 8, np.uint8)
    for row in ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    return log_m, bits.tobytes()


class _Join:
    def __init__(self, nodes: DataFrame, percent: int, item_bytes: int):
        self.nodes, self.percent, self.item_bytes = nodes, percent, item_bytes

    def alike(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def compare(self, members: DataFrame, asks: DataFrame) -> DataFrame:
        """Links (a, b) of the queries with the members of the groups they ask.

        Both are (group, node, size, label).  A group of many queries is compared by several
        tasks, each with the members and at most about ``LOAD`` of the queries.
        """
        load = asks.groupBy("group").agg(F.floor((F.count("*") - 1) / LOAD).alias("more"))
        members = members.join(load, "group").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("more").cast("int"))))
        asks = asks.join(load, "group").withColumn("split", F.pmod(F.xxhash64("node"), F.col("more") + 1).cast("int"))
        roles = members.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True))).drop("more")
        roles = materialize(roles)
        both = roles.join(self.nodes.select("node", "n", "items"), "node")
        parts = parts_for(self.nodes.select("items"), 4 << 20)
        order = both.repartition(parts, "group", "split").sortWithinPartitions("group", "split", "asks")
        links = materialize(order.mapInArrow(_opened(self.percent, self.item_bytes), "a long, b long"))
        release(roles)
        return links

    def active(self, postings: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Postings with component (label, size) of tokens that may still join two components; sizes that no partner admits go."""
        if labels is None:
            out = postings.withColumns({"label": F.col("node"), "size": F.lit(1).cast("long")})
        else:
            sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label").select("node", "label", "size")
            out = postings.join(sized, "node", "left").withColumns({"label": F.coalesce("label", "node"), "size": F.coalesce("size", F.lit(1))})
        spans = out.groupBy("t").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.min("n").alias("_n"), F.max("most").alias("_most"))
        out = out.join(spans.filter("_a < _b"), "t").filter("most >= _n and n <= _most")
        return materialize(out.select("t", "node", "n", "most", "label", "size"))

    def led(self, active: DataFrame, each: int) -> DataFrame:
        """Links of classes with leaders: of each token, the member of the largest component with the fewest rarer tokens."""
        one = F.struct("node", "n", "most", "label", "size")
        best = active.groupBy("t").agg(F.max_by(one, F.struct("size", F.col("most") / F.col("n"), "node")).alias("l"))
        pairs = active.join(best, "t").filter("label <> l.label and n <= l.most and l.n <= most").filter(self.alike(F.col("n"), F.col("l.n")))
        pairs = pairs.groupBy("node", F.col("l.node").alias("group")).agg(F.count("*").alias("times"))
        first = F.row_number().over(W.partitionBy("node").orderBy(F.desc("times"), "group"))
        pairs = materialize(pairs.withColumn("first", first).filter(F.col("first") <= each).select("group", "node"))
        # the leader counts as the larger: every query may link with it
        asks = pairs.withColumns({"size": F.lit(0).cast("long"), "label": F.col("node")})
        leaders = pairs.select("group").distinct().select("group", F.col("group").alias("node"), F.lit(1).cast("long").alias("size"), F.col("group").alias("label"))
        links = self.compare(leaders, asks)
        release(pairs)
        return links

    def probed(self, active: DataFrame) -> DataFrame:
        """Links that the matrix of tokens and groups finds."""
        top = active.groupBy("node").agg(F.first("label").alias("label"), F.first("size").alias("size"), F.min_by("t", "most").alias("top"))
        home = F.when(F.col("size") > 1, F.col("label")).otherwise(F.col("top"))
        top = top.withColumn("home", F.xxhash64(home, F.col("size") > 1))
        full = top.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        group = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("chunks")))
        placed = materialize(top.join(full, "home").select("node", "label", "size", group.alias("group")))
        rank = F.struct("size", "label")
        rows = active.join(placed.select("node", "group"), "node").withColumn("rank", rank)
        matrix = rows.groupBy("t", "group").agg(F.max("rank").alias("top"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("most").alias("bound"))
        fits = (F.col("rank") < F.col("top")) & (F.col("n") <= F.col("bound")) & (F.col("lo") <= F.col("most"))
        fits = fits & (100 * F.col("hi") >= self.percent * F.col("n")) & (100 * F.col("n") >= self.percent * F.col("lo"))
        hits = active.withColumn("rank", rank).join(matrix, "t").filter(fits).select("group", "node", "size", "label").distinct()
        hits = materialize(hits)
        members = placed.join(hits.select("group").distinct(), "group", "left_semi").select("group", "node", "size", "label")
        links = self.compare(members, hits)
        release(placed, hits)
        return links

    def links(self) -> list[DataFrame]:
        posted = self.nodes.select("node", "n", F.explode(F.arrays_zip("t", "most")).alias("p"))
        postings = materialize(posted.select("node", "n", "p.t", "p.most"))
        found: list[DataFrame] = []
        labels = None
        for turn in range(ROUNDS + 1):
            active = self.active(postings, labels)
            if labels is not None:
                release(labels)
            if active.isEmpty():
                release(active)
                break
            if turn < ROUNDS:
                found.append(self.led(active, 1 + turn))
                every = found[0] if len(found) == 1 else found[0].union(found[1])
                labels = components(every)
            else:
                found.append(self.probed(active))
            release(active)
        release(postings)
        return found


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    filter_bytes: int = 64 << 20,
    block_tokens: int = 2_000_000,
    shard_tokens: int = 1 << 20,
) -> DataFrame:
    """Group documents linked by shingle Jaccard similarity of ``percent`` hundredths (1 to 100) or more.

    Words are runs without ASCII white space, A-Z lower-cased.  Returns a row per document:
    the id, n_shingles, component_id (the smallest id reachable by links, itself included)
    and class_id (equal for texts of the same words, null for those without a word).

    Null and empty texts, and texts without a word, have an empty set and link with nothing.
    Rows with equal ids are documents of their own, linked only if their sets are.  A null
    id has no part in component_id, which is null if no member has an id.  Ids that are no
    whole numbers are cast to long and must allow it.  An empty table gives no row.  Extra
    columns are ignored.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark = docs.sparkSession
    frame, (doc, text), _ = isolate(docs, id_col, text_col)
    texts = frame.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    keys = materialize(texts.mapInArrow(_keys, "doc long, hi long, lo long, words long"))
    classes = materialize(keys.filter("words > 0").groupBy("hi", "lo").agg(F.min("doc").alias("doc"), F.first("words").alias("words")))
    total = classes.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    log_shards = max(3, int(np.ceil(np.log2(max(1, total / shard_tokens)))))
    bits = min(64, max(48, int(np.ceil(np.log2(max(1, total)))) + 20))
    item_bytes = -(-bits // 8)

    # one document of each class speaks for it; a false positive of the filter is a class of its own that links with its twin
    held = ids_filter(classes.select("doc"), filter_bytes)
    if held is None:  # too many for a filter: the ids meet the texts by a join
        texts = texts.join(classes.select(F.col("doc").alias("_d")).distinct(), F.col("doc").eqNullSafe(F.col("_d")), "left_semi")
        held = (6, b"\xff" * 8)
    wanted = spark.sparkContext.broadcast(held)
    asked = texts.mapInArrow(_requests(width, bits, log_shards, wanted, block_tokens), "shard long, block long, width int, a binary, b binary")
    dealt = asked.repartition(max(8, 1 << log_shards >> 1), "shard").sortWithinPartitions("shard", "block")
    replies = materialize(dealt.mapInArrow(_counted(bits, log_shards), "block long, width int, a binary, b binary, c binary"))
    order = replies.repartition(parts_for(replies, 8 << 20), "block").sortWithinPartitions("block", "width")
    nodes = materialize(order.mapInArrow(_placed(percent, item_bytes), _NODES))
    release(replies)
    wanted.destroy()

    found = _Join(nodes, percent, item_bytes).links()
    linked = None
    if found:
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        linked = components(every)
        named = nodes.select("node", "hi", "lo").join(linked, "node").join(classes.select("hi", "lo", "doc"), ["hi", "lo"])
        least = named.groupBy("label").agg(F.min("doc").alias("least"))
        named = named.join(least, "label").groupBy("hi", "lo").agg(F.min("least").alias("least"))
    sizes = nodes.groupBy("hi", "lo").agg(F.first("n").alias("n"))
    info = classes.select("hi", "lo", "doc").join(sizes, ["hi", "lo"])
    info = info.join(named, ["hi", "lo"], "left") if linked is not None else info.withColumn("least", F.lit(None).cast("long"))
    info = materialize(info.select("hi", "lo", "n", F.coalesce("least", "doc").alias("component")))
    release(nodes, classes, *found, *([linked] if linked is not None else []))
    out = keys.select("doc", "hi", "lo").join(info, ["hi", "lo"], "left")
    return out.select(
        F.col("doc").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"), F.col("hi").alias("class_id"),
    )

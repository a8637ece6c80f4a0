"""Line dedup with two Bloom filters, one for hashes seen once and one for hashes seen twice.

1. Every task hashes its long lines and sends each filter shard a sorted block of bare
   fingerprints (no text, no ids; at most two equal ones per block, all a "twice" filter
   can use).  A shard folds its blocks into the *once* filter; what the once filter already
   holds goes to the *twice* filter.  Shards are as many as the input needs, so a shard's
   filters have a fixed size.
2. The twice filters, folded down to the few repeated keys, are broadcast when their
   measured size is within ``broadcast_bytes``; beyond that, line keys travel to the shards
   to be tested there.  Either way only suspected repeats go on.
3. Suspects alone are shuffled by their 128-bit key for the exact count of documents and
   the choice of the document that keeps the line.
4. The verdicts return to the documents that lose lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm.common import SPACE, byte_rows, input_bytes, isolate, lean, materialize, n_points, restore

_STRIP = SPACE.encode()
_BITS_PER_KEY, _PROBES = 16, 4


def line_keys(text: bytes, min_chars: int) -> Iterator[tuple[bytes, bytes | None]]:
    """Each line with its key's 128-bit hash, or None if the key is too short."""
    for line in text.split(b"\n"):
        key = line.strip(_STRIP)
        if len(key) < min_chars or n_points(key) < min_chars:
            yield line, None
        else:
            yield line, xxhash.xxh3_128_digest(key.lower())  # bytes.lower is A-Z only


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Bloom:
    """A Bloom filter of 2**log_m cells; positions are taken modulo its size, so it can be halved.

    One that was read back keeps its cells as bits and is only asked.
    """

    def __init__(self, log_m: int, cells: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.log_m, self.bits = log_m, bits
        self.cells = np.zeros(1 << log_m, bool) if cells is None and bits is None else cells

    def _at(self, h: np.ndarray) -> np.ndarray:
        a = _mix(h)
        b = _mix(a) | np.uint64(1)
        step = np.arange(_PROBES, dtype=np.uint64)[:, None]
        return ((a + step * b) & np.uint64((1 << self.log_m) - 1)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        self.cells[self._at(h)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self._at(h)
        if self.bits is not None:
            return ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
        return self.cells[at].all(axis=0)

    def folded(self) -> Bloom:
        """Halved while a twentieth of its cells at most are set: no key is lost."""
        log_m, cells = self.log_m, self.cells
        while log_m > 6 and cells.mean() < 0.05:
            log_m -= 1
            cells = cells[: 1 << log_m] | cells[1 << log_m :]
        return Bloom(log_m, cells)

    def pack(self) -> bytes:
        return np.packbits(self.cells).tobytes()

    @staticmethod
    def unpack(log_m: int, data: bytes) -> Bloom:
        return Bloom(log_m, bits=np.frombuffer(data, np.uint8))


def fold(blocks: list[np.ndarray]) -> Bloom:
    """The twice filter of a shard's fingerprint blocks."""
    n = sum(map(len, blocks))
    log_m = max(6, int(np.ceil(np.log2(max(1, n * _BITS_PER_KEY)))))
    once, twice = Bloom(log_m), Bloom(log_m)
    for block in blocks:
        h, count = np.unique(block, return_counts=True)
        seen = once.has(h) | (count > 1)
        twice.add(h[seen])
        once.add(h[~seen])
    return twice.folded()


def _blocks(min_chars: int, log_shards: int, limit: int = 1 << 20):
    def flush(held: list[int]) -> pa.RecordBatch:
        h, count = np.unique(np.array(held, np.uint64), return_counts=True)
        h = np.repeat(h, np.minimum(count, 2))
        shard = (h >> np.uint64(64 - log_shards)).astype(np.int64) if log_shards else np.zeros(len(h), np.int64)
        ids, starts = np.unique(shard, return_index=True)
        parts = np.split(h, starts[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["shard", "block"]
        )

    def run(batches):
        held: list[int] = []
        for batch in batches:
            for _, rows in byte_rows(batch, 0):
                for text in rows:
                    held += {int.from_bytes(k[8:], "big") for _, k in line_keys(text, min_chars) if k}
                if len(held) >= limit:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return lean(run)


@lean
def _shards(batches):
    """Streams blocks sorted by shard; holds one shard at a time."""
    now, held = None, []

    def out():
        f = fold(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int64()), pa.array([f.log_m], pa.int64()), pa.array([f.pack()], pa.binary())],
            ["shard", "log_m", "bits"],
        )

    for batch in batches:
        for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != now:
                if held:
                    yield out()
                now, held = shard, []
            held.append(np.frombuffer(block, np.uint64))
    if held:
        yield out()


_KEYS = "hi long, lo long, doc long"


def _suspects(min_chars: int, log_shards: int, filters):
    """Distinct line keys of each document; with filters, those that the twice filter holds."""

    def run(batches):
        held = {s: Bloom.unpack(*f) for s, f in filters.value.items()} if filters is not None else None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, rows in byte_rows(batch, 1):
                keys, docs = [], []
                for i, text in enumerate(rows):
                    own = {k for _, k in line_keys(text, min_chars) if k}
                    keys += own
                    docs += [ids[at + i]] * len(own)
                if not keys:
                    continue
                both = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
                keep = np.ones(len(keys), bool)
                if held is not None:
                    keep[:] = False
                    lo = both[:, 1]
                    shard = (lo >> np.uint64(64 - log_shards)).astype(np.int64) if log_shards else np.zeros(len(lo), np.int64)
                    for s in np.unique(shard):
                        if int(s) in held:
                            mine = shard == s
                            keep[mine] = held[int(s)].has(lo[mine])
                both = both[keep].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(docs, pa.int64()).filter(pa.array(keep))],
                    ["hi", "lo", "doc"],
                )

    return lean(run)


@lean
def _tested(batches):
    """Beyond the broadcast bound: keys of a shard stream past its filter, which sorts first."""
    filters: dict[int, Bloom] = {}
    for batch in batches:
        shard, bits = batch.column("shard").to_numpy(), batch.column("bits")
        for i in np.flatnonzero(~bits.is_null().to_numpy(zero_copy_only=False)):
            filters[int(shard[i])] = Bloom.unpack(batch.column("log_m")[int(i)].as_py(), bits[int(i)].as_py())
        last = int(shard[-1]) if len(shard) else -1
        keys = batch.filter(bits.is_null())
        if keys.num_rows:
            shard, lo = keys.column("shard").to_numpy(), keys.column("lo").to_numpy().view(np.uint64)
            keep = np.zeros(len(lo), bool)
            for s in np.unique(shard):
                if int(s) in filters:
                    keep[shard == s] = filters[int(s)].has(lo[shard == s])
            yield keys.select(["hi", "lo", "doc"]).filter(pa.array(keep))
        filters = {s: f for s, f in filters.items() if s == last}


def _rewrite(min_chars: int, text_at: int, width: int):
    def run(batches):
        for batch in batches:
            drops = batch.column(width).to_pylist()
            texts, n_lines, n_dropped = [], [], []
            for at, rows in byte_rows(batch, text_at):
                for i, text in enumerate(rows):
                    drop = drops[at + i]
                    if not drop:
                        n_lines.append(text.count(b"\n") + 1)
                        n_dropped.append(0)
                        texts.append(text.decode())
                        continue
                    gone = {(d["hi"] & (2**64 - 1)).to_bytes(8, "big") + (d["lo"] & (2**64 - 1)).to_bytes(8, "big") for d in drop}
                    lines = list(line_keys(text, min_chars))
                    kept = [line for line, key in lines if key not in gone]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept).decode())
            arrays = [batch.column(i) for i in range(width)]
            arrays[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [*batch.schema.names[:width], "_lines", "_dropped"],
            )

    return lean(run)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
    broadcast_bytes: int = 64 << 20,
    shard_bytes: int = 32 << 20,
) -> DataFrame:
    r"""Drop lines that at least ``min_docs`` documents hold, except in the largest id.

    Returns all columns with ``text_col`` rewritten, and n_lines and n_dropped (long), which
    replace input columns so named.  Lines end at ``\n``; a key is the line without ASCII
    white space at its ends, A-Z lower-cased; keys under ``min_chars`` code points never go.

    Null or empty text is one empty line and comes back as ''.  Rows with equal ids count as
    one document and lose the same lines.  A null id counts for no document and never is the
    largest, so its rows lose every dropped line.  A line repeated in the largest document
    stays each time.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    frame, (doc, text), pairs = isolate(docs, id_col, text_col)
    log_shards = max(0, int(np.ceil(np.log2(max(1, input_bytes(frame.select(text)) / shard_bytes)))))
    n_shards = 1 << log_shards
    blocks = frame.select(text).mapInArrow(_blocks(min_chars, log_shards), "shard long, block binary")
    filters = materialize(
        blocks.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(_shards, "shard long, log_m long, bits binary")
    )
    size = filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    keyed = frame.select(F.col(doc).cast("long").alias("doc"), F.col(text))
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r["shard"]: (r["log_m"], bytes(r["bits"])) for r in filters.collect()})
        suspects = keyed.mapInArrow(_suspects(min_chars, log_shards, held), _KEYS)
    else:
        every = keyed.mapInArrow(_suspects(min_chars, log_shards, None), _KEYS)
        shard = F.shiftrightunsigned("lo", 64 - log_shards) if log_shards else F.lit(0).cast("long")
        every = every.withColumn("shard", shard)
        both = filters.unionByName(every, allowMissingColumns=True)
        order = both.repartition(n_shards, "shard").sortWithinPartitions("shard", F.col("bits").isNull())
        suspects = order.mapInArrow(_tested, _KEYS)
    suspects = materialize(suspects)
    verdicts = materialize(
        suspects.groupBy("hi", "lo")
        .agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keep"))
        .filter(F.col("n") >= min_docs)
        .select("hi", "lo", "keep")
    )
    lost = (
        suspects.join(verdicts, ["hi", "lo"])
        .filter(~F.col("doc").eqNullSafe(F.col("keep")))
        .groupBy("doc")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("_gone"))
        .withColumnRenamed("doc", "_doc")
    )
    joined = frame.join(lost, F.col(doc).cast("long").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    names = [c for c, _ in pairs]
    kinds = ", ".join(f"{f.name} {'string' if f.name == text else f.dataType.simpleString()}" for f in frame.schema)
    out = joined.select(*names, "_gone").mapInArrow(
        _rewrite(min_chars, names.index(text), len(names)), f"{kinds}, _lines long, _dropped long"
    )
    return restore(out, pairs, {"n_lines": "_lines", "n_dropped": "_dropped"})

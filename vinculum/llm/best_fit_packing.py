"""Best-fit packing of documents into sequences by bin completion.

Only lengths decide a packing, and there are at most ``capacity`` of them, so the packing is
planned on a histogram of lengths (at most ``capacity`` rows, whatever the corpus) and the
plan, a list of fillings with multiplicities, is dealt back to the documents by their rank
within their length.

The plan is found by branch and bound: best-fit decreasing gives the incumbent; each node
takes the largest length left, goes through the fillings of the room beside it (any number of
documents that leave no room for another, least waste first, each made when its turn comes),
applies one as often as the counts allow, and is cut when the waste so far already rules out
fewer sequences than the incumbent.  Each node completes its state by best fit, which may
improve the incumbent; the search ends at the lower bound or after ``max_nodes`` nodes.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.llm.common import byte_rows, isolate, lean, materialize, parts_for

#: A filling: ((length, uses), ...), largest first; with it, how many sequences are filled so.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by total length, and (Martello-Toth) by lengths that exclude each other."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for k in [0, *sorted(n for n in counts if 2 * n <= capacity)]:
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        half = [(n, c) for n, c in counts.items() if capacity - k >= n and 2 * n > capacity]
        rest = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        room = sum((capacity - n) * c for n, c in half)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, equal lengths and equal fillings at a time."""
    rooms: list[int] = []  # rooms left, sorted
    bins: dict[int, dict[tuple, int]] = {}  # room left -> filling -> sequences

    def put(room: int, filling: tuple, n: int) -> None:
        if room not in bins:
            bins[room] = {}
            rooms.insert(bisect_left(rooms, room), room)
        bins[room][filling] = bins[room].get(filling, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, n = bins[room].popitem()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, filling, n = capacity, (), left
            use = min(room // length, left)
            times = min(n, left // use)
            if n > times and (filling or at < len(rooms)):
                if filling:
                    put(room, filling, n - times)
            put(room - use * length, (*filling, (length, use)), times)
            left -= use * times
    return [(f, n) for held in bins.values() for f, n in held.items()]


def fillings(counts: dict[int, int], room: int, slack: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """All fillings of ``room``, ((length, uses), ...), that leave no room for another document and waste ``slack`` at most.

    Least waste first, and small lengths first, as they wait beside the largest; ``reach`` holds, as bits, the sums that the
    lengths before each one can make, so that no branch is entered in vain.
    """
    lengths = sorted((n for n in counts if n <= room), reverse=True)
    reach = [1]
    for n in lengths:
        sums, some, rest = reach[-1], 1, min(counts[n], room // n)
        while rest:
            some = min(some, rest)
            sums |= sums << some * n
            rest -= some
            some *= 2
        reach.append(sums & (1 << room + 1) - 1)

    def exactly(most: int, total: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if not total:
            yield ()
        for at in range(most - 1, -1, -1):
            n = lengths[at]
            if n > total:
                break
            for uses in range(min(counts[n], total // n), 0, -1):
                if reach[at] >> total - uses * n & 1:
                    for rest in exactly(at, total - uses * n):
                        yield ((n, uses), *rest)

    for gap in range(min(room, slack) + 1):
        if reach[-1] >> room - gap & 1:
            small = [n for n in lengths if n <= gap]
            for filling in exactly(len(lengths), room - gap):
                used = dict(filling)
                if all(used.get(n, 0) >= counts[n] for n in small):
                    yield filling


def plan_packing(counts: dict[int, int], capacity: int, max_nodes: int = 400) -> Plan:
    """Fillings and their multiplicities; see the module's text."""
    counts = {n: c for n, c in counts.items() if c}
    full = [(((capacity, 1),), counts.pop(capacity))] if counts.get(capacity) else []
    if not counts:
        return full
    total, least = sum(n * c for n, c in counts.items()), lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    best = sum(n for _, n in incumbent)
    stack: list[tuple[dict[int, int], Plan, int, int, int]] = [(counts, [], 0, 0, 0)]  # left, done, sequences, waste, fillings tried
    nodes = 0
    while stack and best > least and nodes < max_nodes:
        left, done, used, waste, tried = stack.pop()
        if waste > (best - 1) * capacity - total:
            continue
        nodes += 1
        if not tried:
            rest = best_fit(left, capacity)
            if used + sum(n for _, n in rest) < best:
                incumbent, best = done + rest, used + sum(n for _, n in rest)
        if not left:
            continue
        top = max(left)
        beside = dict(left)
        beside[top] -= 1
        f = next(islice(fillings(beside, capacity - top, (best - 1) * capacity - total - waste), tried, None), None)
        if f is None:
            continue
        stack.append((left, done, used, waste, tried + 1))
        uses = dict(f)
        uses[top] = uses.get(top, 0) + 1
        times = min(left[x] // u for x, u in uses.items())
        after = {n: c - times * uses.get(n, 0) for n, c in left.items() if c > times * uses.get(n, 0)}
        spilt = waste + times * (capacity - sum(x * u for x, u in uses.items()))
        filling = tuple(sorted(uses.items(), reverse=True))
        stack.append((after, [*done, (filling, times)], used + times, spilt, 0))
    return full + incumbent


#: ASCII marks that the tokenizer keeps apart from a letter or digit before them (no apostrophe: contractions).
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """Token ids of chunks without white space; a chunk is its core and the marks behind it.

    Two generations of at most ``limit`` chunks: what is not asked for again is forgotten.
    New words, chunks of letters alone, are encoded many at a time: each is one word to the
    tokenizer, and a word's last token is one of those that end words.
    """

    def __init__(self, tokenizer, limit: int = 550_000):
        super().__init__()
        self.encode, self.limit, self.old = tokenizer.encode, limit, {}
        self.marks = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for k, i in vocabulary.items() if k.endswith("</w>")]] = True

    def _encoded(self, chunks: list[bytes]) -> list[bytes]:
        out = {}
        words = [c for c in chunks if c.decode().isalpha()]
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            ids = np.array(self.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            last = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(last) == len(some) and last[-1] == len(ids):  # else one of them is more than a word, once in small letters
                out.update((c, ids[a:b].tobytes()) for c, a, b in zip(some, [0, *last], last, strict=False))
        return [out.get(c) or array("I", self.encode(c.decode(), add_special_tokens=False).ids).tobytes() for c in chunks]

    def _parts(self, chunk: bytes) -> tuple[bytes, ...]:
        core = chunk.rstrip(_MARKS)
        # bytes up to 127 that are left at the end are letters, digits, apostrophes or controls
        if not core or core == chunk or not (core[-1:].isalnum() or core[-1] > 127 and core.decode()[-1].isalpha()):
            return (chunk,)
        return core, chunk[len(core) :]

    def learn(self, chunks: set[bytes]) -> None:
        """Holds the ids of all ``chunks``."""
        parts = {}
        for chunk in chunks:
            if chunk in self:
                continue
            if (found := self.old.get(chunk)) is not None:
                self[chunk] = found
            else:
                parts[chunk] = self._parts(chunk)
        new = list({p for some in parts.values() for p in some if p not in self})
        for part, ids in zip(new, self._encoded(new), strict=True):
            self[part] = ids
        for chunk, some in parts.items():
            if len(some) > 1:
                self[chunk] = self[some[0]] + self[some[1]]

    def whole(self, text: bytes) -> bytes:
        """Ids of a text that may hold added tokens such as <|endoftext|>, which have ids of their own."""
        return array("I", self.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def marked(self, text: bytes) -> bool:
        low = text.lower()
        return any(m in low for m in self.marks)

    def rest(self, most: int = 150_000) -> None:
        """Between tasks: the chunks that came first, which are the commonest, stay."""
        if len(self) > most:
            held = dict(islice(self.items(), most))
            self.clear()
            self.update(held)
        self.old = {}

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


#: A full stop or comma that does not stand behind a letter or digit (the two-byte ones of Latin-1 included).
_ODD_MARK = re.compile(rb"[.,](?=[ \n])(?<![a-z0-9][.,])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,])")


def _chunks(text: bytes) -> list[bytes]:
    """White-space-free chunks whose ids, one after the other, are the text's.

    The tokenizer lower-cases, so A-Z may be lowered first, unless a combining mark (U+0300
    to U+036F) could compose with the small letter alone.  It keeps marks apart from letters,
    so stops and commas behind a word may stand alone, which makes chunks repeat more.
    """
    if b"\xcc" in text or b"\xcd" in text:
        return text.split()
    text = text.lower()
    if not _ODD_MARK.search(text):
        text = text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" . ").replace(b",\n", b" , ")
    return text.split()


def token_bytes(texts: list[bytes], words: _Words) -> list[bytes]:
    """Ids of each text.  The tokenizer drops white space and never joins across it, so chunks are encoded once.

    Texts that hold an added token, in any case, are encoded whole.
    """
    words.trim()
    cut = [None if words.marked(t) else _chunks(t) for t in texts]
    words.learn(set().union(*(c for c in cut if c is not None)))
    get = words.__getitem__
    return [words.whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


def _words_of(path: str) -> _Words:
    """The worker's tokenizer and words, which serve its later tasks too."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    held = sys.modules.setdefault("_vinculum_words", types.ModuleType("_vinculum_words")).__dict__
    if path not in held:
        held[path] = _Words(Tokenizer.from_file(path))
    return held[path]


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches):
        words, end = _words_of(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            for at, texts in byte_rows(batch, 1, 64):
                which, piece, start, length, crc, data = [], [], [], [], [], []
                for i, held in enumerate(token_bytes(texts, words)):
                    held += end
                    for k, cut in enumerate(range(0, len(held), 4 * capacity)):
                        part = held[cut : cut + 4 * capacity]
                        which.append(at + i)
                        piece.append(k)
                        start.append(cut // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        data.append(part)
                columns = [ids.take(pa.array(which)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if with_ids:
                    columns.append(pa.array(data, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc", "piece", "start", "length", "crc", "ids"][: len(columns)])
        words.rest()

    return lean(run)


def _slots(plan: Plan) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, uses in a sequence, place of the first)."""
    next_rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for filling, times in plan:
        place = 0
        for length, uses in filling:
            rank = next_rank.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, uses, place))
            next_rank[length] = rank + uses * times
            place += uses * length
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _seat(slots):
    def run(batches):
        by_length = slots.value
        for batch in batches:
            names = batch.schema.names
            length, rank = batch.column(names.index("length")).to_numpy(), batch.column(names.index("rank")).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                table = by_length[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                within = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + within // row[:, 2]
                offset[mine] = row[:, 3] + within % row[:, 2] * n
            keep = [i for i, x in enumerate(names) if x != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)],
                [*(names[i] for i in keep), "sequence_id", "offset"],
            )

    return lean(run)


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    max_nodes: int = 400,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the search finds.

    Returns a row per piece: the id column, piece, start, length, ids_crc32, sequence_id and
    offset, with ``with_ids`` also ids (little-endian unsigned 32-bit).  A sequence is its
    pieces in the order of their offsets.

    Null and empty texts are the end id alone.  Only documents longer than ``capacity`` are
    cut; whole pieces fill a sequence each.  Rows with equal or null ids are documents of
    their own.  Ties of length are seated by id, then by chance of equal rows.  An empty
    table gives no row.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    frame, (doc, text), _ = isolate(docs, id_col, text_col)
    kind = frame.schema[doc].dataType.simpleString()
    schema = f"doc {kind}, piece int, start long, length long, crc long" + ", ids binary" * with_ids
    pieces = materialize(frame.select(doc, text).mapInArrow(_pieces(tokenizer_path, end_id, capacity, with_ids), schema))

    buckets = parts_for(pieces, 1 << 20, 64)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece"), F.lit(buckets)))
    sizes = materialize(pieces.groupBy("bucket", "length").agg(F.count("*").alias("n")))
    plan = plan_packing(
        {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, max_nodes
    )
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    first = sizes.select("bucket", "length", F.coalesce(before, F.lit(0)).alias("first"))
    own = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc", "piece", "crc")) - 1
    ranked = pieces.withColumn("own", own).join(first, ["bucket", "length"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("own")).select(*[c.split()[0] for c in schema.split(", ")], "rank")
    slots = spark.sparkContext.broadcast(_slots(plan))
    out = ranked.mapInArrow(_seat(slots), f"{schema}, sequence_id long, offset long")
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return out.toDF(*names)

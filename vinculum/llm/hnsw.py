"""A hierarchical navigable small-world graph over one shard, as flat neighbour arrays.

Larger inner product is nearer.  Vectors get one more component so that all have equal
length (queries get 0 there): the order of inner products stays, and becomes a metric's.
All steps work on many points at once: a batch of inserts or queries walks in lockstep.
"""

from __future__ import annotations

import numpy as np


def level_of(n: int, m: int, seed: int) -> np.ndarray:
    u = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(1 - u) / np.log(m)).astype(np.int64)


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, spread: int = 4):
    """Best ``ef`` found nodes of each query, nearest first (ids, inner products); id len(x) is none.

    ``links`` has a row of neighbours per node, padded with -1; ``start`` a row of entry nodes
    per query.  Each round opens the ``spread`` nearest unopened nodes of each query.
    """
    b, n = len(q), len(x)
    ids = np.full((b, ef), n, np.int64)
    near = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)
    seen = np.zeros((b, n), bool)
    row = np.repeat(np.arange(b), start.shape[1])
    node = start.ravel()
    while len(row):
        ok = node >= 0
        key = np.unique(row[ok] * n + node[ok])
        row, node = key // n, key % n
        new = ~seen[row, node]
        row, node = row[new], node[new]
        if not len(row):
            if done.all():
                break
        else:
            seen[row, node] = True
            sim = np.einsum("ij,ij->i", q[row], x[node])
            first = np.searchsorted(row, np.arange(b))
            place = np.arange(len(row)) - first[row]
            wide = int(place.max()) + 1
            more = np.full((b, wide), n, np.int64)
            more_near = np.full((b, wide), -np.inf, np.float32)
            more[row, place], more_near[row, place] = node, sim
            all_near = np.concatenate((near, more_near), 1)
            order = np.argsort(-all_near, 1, kind="stable")[:, :ef]
            ids = np.take_along_axis(np.concatenate((ids, more), 1), order, 1)
            near = np.take_along_axis(all_near, order, 1)
            done = np.take_along_axis(np.concatenate((done, more >= n), 1), order, 1)
        todo = ~done
        todo &= np.cumsum(todo, 1) <= spread
        row, at = np.nonzero(todo)
        done[row, at] = True
        opened = links[ids[row, at]]
        row, node = np.repeat(row, opened.shape[1]), opened.ravel()
    return ids, near


def choose(x: np.ndarray, cand: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """The neighbour heuristic for many nodes: ``cand`` (nearest first, len(x) is none) -> at most m each, -1 padded.

    A candidate is kept if it is nearer to the node than to every neighbour kept before;
    room left is filled with the nearest of the others.
    """
    b, c = cand.shape
    n = len(x)
    kept = np.full((b, m), -1, np.int64)
    count = np.zeros(b, np.int64)
    vectors = np.zeros((b, m, x.shape[1]), np.float32)
    passed = np.zeros((b, c), bool)
    rows = np.arange(b)
    for j in range(c):
        live = (cand[:, j] < n) & (count < m)
        if not live.any():
            continue
        v = x[np.where(live, cand[:, j], 0)]
        most = int(count.max())
        close = np.einsum("bmd,bd->bm", vectors[:, :most], v) if most else np.zeros((b, 0), np.float32)
        close[np.arange(most)[None, :] >= count[:, None]] = -np.inf
        ok = live & (close < near[:, j : j + 1]).all(1)
        r = rows[ok]
        kept[r, count[r]] = cand[r, j]
        vectors[r, count[r]] = v[r]
        count[r] += 1
        passed[:, j] = ok
    for j in range(c):
        r = rows[(cand[:, j] < n) & (count < m) & ~passed[:, j]]
        kept[r, count[r]] = cand[r, j]
        count[r] += 1
    return kept


class Hnsw:
    """Layers from the top: (nodes, links).  Layer 0 holds all nodes; links name shard rows."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    @staticmethod
    def extended(v: np.ndarray) -> np.ndarray:
        """float32, scaled to a largest norm of 1, with the component that makes norms equal."""
        v = v.astype(np.float64)
        top = np.abs(v).max(initial=0.0)
        v = v / top if top > 0 else v
        square = (v * v).sum(1)
        most = square.max(initial=0.0)
        scale = np.sqrt(most) if most > 0 else 1.0
        return np.concatenate((v / scale, np.sqrt(np.maximum(0, 1 - square / max(most, 1e-300)))[:, None]), 1).astype(np.float32)

    @staticmethod
    def build(v: np.ndarray, m: int = 16, ef: int = 96, seed: int = 7, batch: int = 256) -> Hnsw:
        x = Hnsw.extended(v)
        level = level_of(len(x), m, seed)
        order = np.argsort(-level, kind="stable")  # nodes of upper layers come first in every layer
        layers: list[np.ndarray] = []  # from the top
        entry = int(order[0])
        for at in range(int(level.max()), -1, -1):
            nodes = order[: int((level >= at).sum())]
            width = 2 * m if at == 0 else m
            links = np.full((len(x), width), -1, np.int64)
            degree = np.zeros(len(x), np.int64)
            inside = 0
            while inside < len(nodes):
                new = nodes[inside : inside + (batch if inside >= batch else max(1, batch - inside))]
                mates = x[new] @ x[new].T
                np.fill_diagonal(mates, -np.inf)
                if inside:
                    start = Hnsw._descend(x, layers, x[new], entry)
                    cand, near = walk(x, links, x[new], start, ef)
                    cand = np.concatenate((cand, np.broadcast_to(new, mates.shape)), 1)
                    near = np.concatenate((near, mates), 1)
                else:
                    cand, near = np.broadcast_to(new, mates.shape), mates
                take = np.argsort(-near, 1, kind="stable")[:, :ef]
                cand, near = np.take_along_axis(cand, take, 1), np.take_along_axis(near, take, 1)
                cand = np.where(np.isneginf(near), len(x), cand)
                kept = choose(x, cand, near, m)
                links[new, :m] = kept
                degree[new] = (kept >= 0).sum(1)
                Hnsw._link_back(x, links, degree, new, kept, width)
                inside += len(new)
            layers.append(links)
        # upper layers are kept as rows of their own nodes only
        return Hnsw(x, layers, entry)

    @staticmethod
    def _link_back(x, links, degree, new, kept, width) -> None:
        src, dst = np.repeat(new, kept.shape[1]), kept.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        old = (links[dst] == src[:, None]).any(1)  # linked already, as mates can be
        src, dst = src[~old], dst[~old]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst) + degree[dst]
        fits = place < width
        links[dst[fits], place[fits]] = src[fits]
        over = np.unique(dst[~fits])
        touched, add = np.unique(dst, return_counts=True)
        degree[touched] = np.minimum(width, degree[touched] + add)
        if len(over):
            rest_src, rest_dst = src[~fits], dst[~fits]
            slot = np.searchsorted(over, rest_dst)
            more = np.full((len(over), int(np.bincount(slot).max())), len(x), np.int64)
            more[slot, np.arange(len(rest_dst)) - np.searchsorted(rest_dst, rest_dst)] = rest_src
            cand = np.concatenate((links[over], more), 1)
            cand[cand < 0] = len(x)
            for at in range(0, len(over), 512):
                part = slice(at, at + 512)
                c = cand[part]
                near = np.einsum("bcd,bd->bc", x[np.minimum(c, len(x) - 1)], x[over[part]])
                near[c >= len(x)] = -np.inf
                by = np.argsort(-near, 1, kind="stable")
                links[over[part]] = choose(x, np.take_along_axis(c, by, 1), np.take_along_axis(near, by, 1), width)

    @staticmethod
    def _descend(x, layers, q, entry) -> np.ndarray:
        start = np.full((len(q), 1), entry, np.int64)
        for links in layers:
            start = walk(x, links, q, start, 4, 1)[0][:, :1]
        return start

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows found for each query (float64 vectors), nearest first; len(x) is none."""
        norm = np.sqrt((q * q).sum(1, keepdims=True))
        q = np.concatenate((q / np.where(norm > 0, norm, 1), np.zeros((len(q), 1))), 1).astype(np.float32)
        start = self._descend(self.x, self.layers[:-1], q, self.entry)
        return walk(self.x, self.layers[-1], q, start, ef)

    def pack(self) -> tuple[list[bytes], list[bytes], int]:
        """Flat int32 arrays of each layer, from the top: its nodes, and their neighbours in rows."""
        nodes = [np.flatnonzero((links >= 0).any(1) | (i == len(self.layers) - 1)) for i, links in enumerate(self.layers)]
        return (
            [k.astype("<i4").tobytes() for k in nodes],
            [links[k].astype("<i4").tobytes() for k, links in zip(nodes, self.layers, strict=True)],
            self.entry,
        )

    @staticmethod
    def unpack(v: np.ndarray, nodes: list[bytes], links: list[bytes], entry: int) -> Hnsw:
        layers = []
        for k, flat in zip(nodes, links, strict=True):
            at = np.frombuffer(k, "<i4")
            rows = np.frombuffer(flat, "<i4").astype(np.int64)
            width = len(rows) // len(at) if len(at) else 1
            table = np.full((len(v), max(width, 1)), -1, np.int64)
            if len(at):
                table[at] = rows.reshape(len(at), -1)
            layers.append(table)
        return Hnsw(Hnsw.extended(v), layers, entry)

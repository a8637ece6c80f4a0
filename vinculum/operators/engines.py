"""Positions of one component: arrays of link ends in, an (n, 2) array of centres out.

Nodes are numbered 0..n-1 in the order of their ids; all engines are deterministic.
"""

from __future__ import annotations

import numpy as np


def _near(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Undirected neighbours without loops and repeats: node i's are ``flat[start[i]:start[i + 1]]``."""
    keep = a != b
    both = np.unique(np.concatenate([a[keep] * n + b[keep], b[keep] * n + a[keep]])) if keep.any() else np.zeros(0, np.int64)
    return np.searchsorted(both // n, np.arange(n + 1)), both % n


def hops(n: int, start: np.ndarray, flat: np.ndarray, roots: list[int]) -> np.ndarray:
    """Undirected distance from the nearest root; -1 where there is no way."""
    out = np.full(n, -1, np.int64)
    out[roots] = 0
    front, depth = np.array(roots, np.int64), 0
    while len(front):
        depth += 1
        found = np.unique(np.concatenate([flat[start[i] : start[i + 1]] for i in front]))
        front = found[out[found] < 0]
        out[front] = depth
    return out


def ring(n: int, spacing: float = 220.0) -> np.ndarray:
    """Evenly around a circle whose rim leaves ``spacing`` for each node."""
    angle = 2 * np.pi * np.arange(n) / max(n, 1)
    return n * spacing / (2 * np.pi) * np.stack([np.cos(angle), np.sin(angle)], 1)


def radial(n: int, a: np.ndarray, b: np.ndarray, step: float = 220.0) -> np.ndarray:
    """Rings of equal distance around the node of most neighbours, each in the order of its inner neighbours' angles."""
    start, flat = _near(n, a, b)
    depth = hops(n, start, flat, [int(np.argmax(np.diff(start)))])
    depth[depth < 0] = depth.max() + 1
    angle, out = np.zeros(n), np.zeros((n, 2))
    for d in range(1, depth.max() + 1):
        mine = np.flatnonzero(depth == d)
        inner = [[j for j in flat[start[i] : start[i + 1]] if depth[j] == d - 1] for i in mine]
        want = np.array([np.arctan2(np.sin(angle[j]).sum(), np.cos(angle[j]).sum()) % (2 * np.pi) if j else 7.0 for j in inner])
        mine = mine[np.argsort(want, kind="stable")]
        angle[mine] = 2 * np.pi * np.arange(len(mine)) / len(mine)
        radius = max(step * d, len(mine) * step / (2 * np.pi))
        out[mine] = radius * np.stack([np.cos(angle[mine]), np.sin(angle[mine])], 1)
    return out


def ranks(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The layer of each node: one below its lowest predecessor, links back into the open path of a depth-first walk aside."""
    after: list[list[int]] = [[] for _ in range(n)]
    ways_in = np.bincount(b[a != b], minlength=n)
    for x, y in sorted(set(zip(a.tolist(), b.tolist(), strict=True))):
        if x != y:
            after[x].append(y)
    state, order, back = np.zeros(n, np.int8), [], set()
    for root in sorted(range(n), key=lambda i: (ways_in[i], i)):
        path = [(root, 0)] if not state[root] else []
        state[root] = state[root] or 1
        while path:
            at, k = path.pop()
            if k == len(after[at]):
                state[at] = 2
                order.append(at)
                continue
            path.append((at, k + 1))
            to = after[at][k]
            if state[to] == 1:
                back.add((at, to))
            elif not state[to]:
                state[to] = 1
                path.append((to, 0))
    out = np.zeros(n, np.int64)
    for x in reversed(order):
        for y in after[x]:
            if (x, y) not in back:
                out[y] = max(out[y], out[x] + 1)
    return out


def layered(n: int, a: np.ndarray, b: np.ndarray, across: float = 260.0, along: float = 90.0, sweeps: int = 8) -> np.ndarray:
    """Layers from left to right; within a layer by the mean place of the neighbours, swept forth and back."""
    layer = ranks(n, a, b)
    start, flat = _near(n, a, b)
    rows = [np.flatnonzero(layer == d) for d in range(layer.max() + 1)]
    place = np.zeros(n)
    for row in rows:
        place[row] = np.arange(len(row)) - (len(row) - 1) / 2
    for sweep in range(sweeps):
        forth = sweep % 2 == 0
        for d in range(1, len(rows)) if forth else range(len(rows) - 2, -1, -1):
            row = rows[d]
            want = place[row].copy()
            for k, i in enumerate(row):
                near = flat[start[i] : start[i + 1]]
                near = near[layer[near] < d] if forth else near[layer[near] > d]
                if len(near):
                    want[k] = place[near].mean()
            rows[d] = row = row[np.argsort(want, kind="stable")]
            place[row] = np.arange(len(row)) - (len(row) - 1) / 2
    return np.stack([layer * across, place * along], 1)


def tree(n: int, a: np.ndarray, b: np.ndarray, across: float = 260.0, along: float = 90.0) -> np.ndarray:
    """A parent a level up for each node (the least), leaves on lines of their own, parents amid their children."""
    start, flat = _near(n, a, b)
    ways_in, ways_out = np.bincount(b[a != b], minlength=n), np.bincount(a[a != b], minlength=n)
    roots = np.flatnonzero(ways_in == 0).tolist() or [int(np.argmax(ways_out))]
    depth = hops(n, start, flat, roots[:1])
    children: list[list[int]] = [[] for _ in range(n)]
    tops = []
    for i in range(n):
        up = [j for j in flat[start[i] : start[i + 1]] if depth[j] == depth[i] - 1] if depth[i] > 0 else []
        (children[up[0]] if up else tops).append(i)
    y, line, walk = np.zeros(n), 0, [(i, False) for i in reversed(tops)]
    while walk:
        i, seen = walk.pop()
        if not children[i]:
            y[i], line = line, line + 1
        elif seen:
            y[i] = (y[children[i][0]] + y[children[i][-1]]) / 2
        else:
            walk += [(i, True), *((c, False) for c in reversed(children[i]))]
    return np.stack([np.maximum(depth, 0) * across, y * along], 1)


def force(n: int, a: np.ndarray, b: np.ndarray, length: float = 200.0, rounds: int = 120, at: np.ndarray | None = None) -> np.ndarray:
    """Springs along links, repulsion between all nodes in blocks of rows, cooling; starts on a ring."""
    at = ring(n, length) if at is None else at.copy()
    heat = length * max(1.0, n**0.5) / 4
    for k in range(rounds):
        push = np.zeros_like(at)
        for lo in range(0, n, 512):
            d = at[lo : lo + 512, None] - at[None]
            push[lo : lo + 512] = (d * (length**2 / np.maximum((d**2).sum(2), 1.0))[..., None]).sum(1)
        d = at[a] - at[b]
        pull = d * (np.hypot(d[:, 0], d[:, 1]) / length)[:, None]
        np.subtract.at(push, a, pull)
        np.add.at(push, b, pull)
        size = np.maximum(np.hypot(push[:, 0], push[:, 1]), 1e-9)
        at += push * (np.minimum(size, heat * (1 - k / rounds)) / size)[:, None]
    return at - at.mean(0)


def pivot_mds(n: int, a: np.ndarray, b: np.ndarray, length: float = 200.0, pivots: int = 50) -> np.ndarray:
    """Distances to far-apart pivots, centred twice, projected on their two main axes."""
    if n <= 2:
        return np.stack([np.arange(n) * length, np.zeros(n)], 1)
    start, flat = _near(n, a, b)
    columns, nearest, at = [], np.full(n, np.iinfo(np.int64).max), 0
    for _ in range(min(pivots, n)):
        d = hops(n, start, flat, [at])
        d[d < 0] = d.max() + 1
        columns.append(d)
        nearest = np.minimum(nearest, d)
        at = int(np.argmax(nearest))
    c = np.stack(columns, 1).astype(float) ** 2
    c = -0.5 * (c - c.mean(0) - c.mean(1, keepdims=True) + c.mean())
    values, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, np.argsort(-values, kind="stable")[:2]]
    axes = axes * np.where(axes[np.argmax(np.abs(axes), 0), np.arange(axes.shape[1])] < 0, -1, 1)
    out = c @ axes
    out = out if out.shape[1] == 2 else np.stack([out[:, 0], np.zeros(n)], 1)
    d = out[a] - out[b]
    mean = np.hypot(d[:, 0], d[:, 1]).mean() if len(a) else 0.0
    return out * (length / mean) if mean > 0 else out


def stress(n: int, a: np.ndarray, b: np.ndarray, length: float = 200.0, exact: int = 400, rounds: int = 40) -> np.ndarray:
    """Drawn distances like distances in hops: pivots, and for at most ``exact`` nodes majorisation from there."""
    at = pivot_mds(n, a, b, length)
    if n <= 2 or n > exact:
        return at
    start, flat = _near(n, a, b)
    d = np.stack([hops(n, start, flat, [i]) for i in range(n)]).astype(float)
    d[d < 0] = d.max() + 1
    np.fill_diagonal(d, 1.0)
    w = d**-2
    np.fill_diagonal(w, 0.0)
    at = at + 1e-3 * ring(n, 1.0)  # parts nodes that the pivots put on one place
    for _ in range(rounds):
        step = at[:, None] - at[None]
        far = np.maximum(np.hypot(step[..., 0], step[..., 1]), 1e-9)
        at = ((w[..., None] * (at[None] + step * (d * length / far)[..., None])).sum(1)) / w.sum(1)[:, None]
    return at - at.mean(0)


def cores(n: int, start: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The core number of each node."""
    left, out, k = np.diff(start).copy(), np.zeros(n, np.int64), 0
    alive = np.ones(n, bool)
    while alive.any():
        k = max(k, int(left[alive].min()))
        while len(gone := np.flatnonzero(alive & (left <= k))):
            out[gone], alive[gone] = k, False
            left -= np.bincount(np.concatenate([flat[start[i] : start[i + 1]] for i in gone]), minlength=n)
    return out


def backbone(n: int, a: np.ndarray, b: np.ndarray, length: float = 200.0) -> np.ndarray:
    """Nodes of at least the median core by force, the others around the mean of their placed neighbours, core by core."""
    start, flat = _near(n, a, b)
    core = cores(n, start, flat)
    inner = core >= max(2, int(np.median(core)))
    if inner.sum() < 3 or inner.all():
        return force(n, a, b, length)
    number = np.cumsum(inner) - 1
    both = inner[a] & inner[b]
    out, done = np.zeros((n, 2)), inner.copy()
    out[inner] = force(int(inner.sum()), number[a[both]], number[b[both]], length)
    turn = 0
    while not done.all():
        wave = [i for i in np.flatnonzero(~done) if done[flat[start[i] : start[i + 1]]].any()] or np.flatnonzero(~done).tolist()
        for i in wave:
            near = flat[start[i] : start[i + 1]]
            near = near[done[near]]
            middle = out[near].mean(0) if len(near) else np.zeros(2)
            turn += 1
            out[i] = middle + length * np.array([np.cos(2.399963 * turn), np.sin(2.399963 * turn)])
        done[wave] = True
    return out


def apart(at: np.ndarray, width: float, height: float, rounds: int = 200) -> np.ndarray:
    """Boxes of one size pushed apart along their lesser overlap, looked for in a grid of box-sized cells.

    What still overlaps then is dealt over free cells of the grid.
    """
    at = at.astype(float).copy()
    size = np.array([width, height])
    for _ in range(rounds):
        cells: dict[tuple[int, int], list[int]] = {}
        keys = np.floor(at / size).astype(np.int64)
        for i, (x, y) in enumerate(keys.tolist()):
            cells.setdefault((x, y), []).append(i)
        moved = False
        for i, (x, y) in enumerate(keys.tolist()):
            for j in sorted(j for p in (-1, 0, 1) for q in (-1, 0, 1) for j in cells.get((x + p, y + q), ()) if j > i):
                d = at[j] - at[i]
                over = size - np.abs(d)
                if (over > 1e-6).all():
                    axis = int(over[1] < over[0])
                    shift = (over[axis] / 2 + 1e-3) * (1 if d[axis] >= 0 else -1)
                    at[j, axis] += shift
                    at[i, axis] -= shift
                    moved = True
        if not moved:
            return at
    taken: set[tuple[int, int]] = set()
    for i in range(len(at)):
        x, y = np.floor(at[i] / (size + 2e-3)).astype(int).tolist()
        while (x, y) in taken:
            x += 1
        taken.add((x, y))
        at[i] = (size + 2e-3) * (x, y)
    return at


def fiedler(n: int, a: np.ndarray, b: np.ndarray, rounds: int = 128) -> np.ndarray:
    """The order along the Laplacian's second axis, by power iteration from a fixed start; two nodes or fewer keep theirs.

    The axis points so that the first node that is off its middle lies on the near side.
    """
    if n <= 2:
        return np.arange(n)
    start, flat = _near(n, a, b)
    degree = np.diff(start)
    of = np.repeat(np.arange(n), degree)
    shift = 2.0 * degree.max()
    v = np.arange(n) - (n - 1) / 2
    for _ in range(rounds):
        v = (shift - degree) * v + np.bincount(of, v[flat], n)
        v -= v.mean()
        size = np.sqrt((v**2).sum())
        if size < 1e-12:
            return np.arange(n)
        v /= size
    off = np.flatnonzero(np.abs(v) > 1e-9)
    return np.argsort(np.round(-v if len(off) and v[off[0]] > 0 else v, 9), kind="stable")


def positions(engine: str, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Centres by the engine named; grid and circular are expressions on tables (see placement)."""
    if n == 1:
        return np.zeros((1, 2))
    return {"radial": radial, "layered": layered, "tree": tree, "force": force, "stress": stress, "backbone": backbone}[engine](n, a, b)

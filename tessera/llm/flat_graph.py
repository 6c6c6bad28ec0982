"""A robust-pruned flat graph over unit vectors, in memory: building by insertion, greedy and range-expanding search."""

from __future__ import annotations

import numpy as np

#: Edges that pruning leaves a vertex, and that it may gather before it is pruned again.
DEGREE, GATHERED = 24, 48
#: Pruning factor: an edge goes if a kept neighbour is that much nearer to its end.
ALPHA = 1.2
#: Beams of the greedy searches that build and that look up; vertices that edges are chosen from.
BUILD_BEAM, BEAM, POOL = 32, 16, 64
#: Vertices that are inserted together, and of those the nearest that each is also offered.
BATCH, BESIDE = 512, 8
#: Cells of a search's table of seen vertices; vertices expanded at a time; distances between pooled vertices at a time.
CELLS, AT_ONCE, DISTANCES = 1 << 22, 2000, 1 << 22


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def _nearest(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, in any order."""
    if ids.shape[1] <= k:
        return ids, score
    keep = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.take_along_axis(ids, keep, 1), np.take_along_axis(score, keep, 1)


def _rows(r: np.ndarray, v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row, vertex, cosine) triples as the rows there are, and padded vertices and cosines of each."""
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    size = np.diff(np.r_[first, len(r)])
    ids = np.full((len(first), int(size.max())), -1)
    score = np.full(ids.shape, -np.inf, np.float32)
    at = np.repeat(np.arange(len(first)), size), np.arange(len(r)) - np.repeat(first, size)
    ids[at], score[at] = v, s
    return r[first], ids, score


class Search:
    """Searches for many queries at once, which advance together over one graph.

    ``x`` are unit vectors (float32), ``edges`` neighbours in rows filled up with -1, ``q`` the queries.
    """

    def __init__(self, x: np.ndarray, edges: np.ndarray, q: np.ndarray) -> None:
        self.x, self.edges, self.q = x, edges, q
        self.seen = np.zeros((len(q), len(x)), bool)
        self.expanded = np.zeros((len(q), len(x)), bool)
        self.close: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _reach(self, r: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen vertices ``v`` for the queries ``r``: sorted triples with their cosines."""
        ok = v >= 0
        r, v = r[ok], v[ok]
        ok = ~self.seen[r, v]
        key = np.unique(r[ok] * len(self.x) + v[ok])
        r, v = key // len(self.x), key % len(self.x)
        self.seen[r, v] = True
        return r, v, np.einsum("ij,ij->i", self.q[r], self.x[v])

    def _neighbours(self, r: np.ndarray, v: np.ndarray):
        near = self.edges[v]
        return self._reach(np.repeat(r, near.shape[1]), near.ravel())

    def greedy(self, seeds: np.ndarray, beam: int, keep: float) -> tuple[np.ndarray, np.ndarray]:
        """From ``seeds`` (a row a query, -1 for none): each expands the best of its beam until all are.

        Returns the final beams and cosines. Vertices at ``keep`` or more go to ``close``.
        """
        n = len(self.q)
        ids, score = np.full((n, beam), -1), np.full((n, beam), -np.inf, np.float32)
        new = self._reach(np.repeat(np.arange(n), seeds.shape[1]), seeds.ravel())
        active = np.arange(n)
        while True:
            r, v, s = new
            near = s >= keep
            self.close.append((r[near], v[near], s[near]))
            if len(r):
                rows, more, value = _rows(r, v, s)
                both = np.concatenate([ids[rows], more], axis=1), np.concatenate([score[rows], value], axis=1)
                ids[rows], score[rows] = _nearest(*both, beam)
            done = self.expanded[active[:, None], np.maximum(ids[active], 0)]
            open_ = np.where((ids[active] >= 0) & ~done, score[active], -np.inf)
            best = open_.argmax(axis=1)
            live = open_[np.arange(len(active)), best] > -np.inf
            active, best = active[live], best[live]
            if not len(active):
                return ids, score
            to = ids[active, best]
            self.expanded[active, to] = True
            new = self._neighbours(active, to)

    def widen(self, keep: float) -> tuple[np.ndarray, np.ndarray]:
        """Expand all that lies at ``keep`` or more until nothing new does; all such (query, vertex) pairs."""
        pairs = [(r, v) for r, v, _ in self.close]
        todo = pairs
        while todo:
            r, v = (np.concatenate(c) for c in zip(*todo))
            fresh = ~self.expanded[r, v]
            r, v = r[fresh], v[fresh]
            self.expanded[r, v] = True
            todo = []
            for at in range(0, len(r), AT_ONCE):
                a, b, s = self._neighbours(r[at : at + AT_ONCE], v[at : at + AT_ONCE])
                near = s >= keep
                if near.any():
                    todo.append((a[near], b[near]))
            pairs = pairs + todo
        return tuple(np.concatenate(c) for c in zip(*pairs))


def robust_prune(x: np.ndarray, at: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Up to DEGREE of each row of ``pool`` (-1 for none) for the vertices ``at``.

    The nearest comes first; then the nearest that no chosen one is ALPHA times nearer to.
    """
    none = (pool < 0) | (pool == at[:, None])
    to = x[np.maximum(pool, 0)]
    gap = np.where(none, np.inf, 2 - 2 * np.einsum("id,ijd->ij", x[at], to))
    order = np.argsort(gap, axis=1, kind="stable")
    pool, gap, to = np.take_along_axis(pool, order, 1), np.take_along_axis(gap, order, 1), np.take_along_axis(to, order[:, :, None], 1)
    between = 2 - 2 * np.matmul(to, to.transpose(0, 2, 1))
    alive = np.isfinite(gap)
    out = np.full((len(at), DEGREE), -1)
    row = np.arange(len(at))
    for k in range(min(DEGREE, pool.shape[1])):
        pick = alive.argmax(axis=1)
        some = alive[row, pick]
        if not some.any():
            break
        out[some, k] = pool[row, pick][some]
        alive[row, pick] = False
        alive &= ALPHA**2 * between[row, pick] > gap
    return out


def _add_back(x: np.ndarray, edges: np.ndarray, used: np.ndarray, at: np.ndarray, links: np.ndarray) -> None:
    """The edges back from ``links`` to ``at``; lists that would pass GATHERED are pruned."""
    a, b = np.repeat(at, links.shape[1]), links.ravel()
    ok = b >= 0
    order = np.argsort(b[ok], kind="stable")
    a, b = a[ok][order], b[ok][order]
    if not len(b):
        return
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    size = np.diff(np.r_[first, len(b)])
    full = np.repeat(used[b[first]] + size > GATHERED, size)
    place = used[b] + np.arange(len(b)) - np.repeat(first, size)
    edges[b[~full], place[~full]] = a[~full]
    np.add.at(used, b[~full], 1)
    if full.any():
        a, b = a[full], b[full]
        rows, new, _ = _rows(b, a, np.zeros(len(a), np.float32))
        step = max(1, DISTANCES // (GATHERED + new.shape[1]) ** 2)
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            pool = np.concatenate([edges[some], new[k : k + step]], axis=1)
            kept = robust_prune(x, some, pool)
            edges[some] = -1
            edges[some, :DEGREE] = kept
            used[some] = (kept >= 0).sum(axis=1)


def build(x: np.ndarray) -> np.ndarray:
    """Edges of a graph over unit vectors ``x``, by insertion.

    Vertices come in random order and growing batches. Each is searched greedily from the medoid in the
    graph so far; its edges are pruned from the nearest that the search met and the nearest of its own
    batch, and edges back are added.
    """
    n = len(x)
    edges, used = np.full((n, GATHERED), -1), np.zeros(n, np.int64)
    start = medoid(x) if n else 0
    order = np.random.default_rng(n).permutation(n)
    order = np.r_[start, order[order != start]].astype(np.int64)[:n]
    done = 0
    while done < n:
        batch = order[done : done + max(32, min(done, BATCH, CELLS // n))]
        near = x[batch] @ x[batch].T
        np.fill_diagonal(near, -np.inf)
        pool, _ = _nearest(np.broadcast_to(batch, near.shape), near, BESIDE if done else POOL)
        if done:
            look = Search(x, edges, x[batch])
            look.greedy(np.full((len(batch), 1), start), BUILD_BEAM, -np.inf)
            r, v, s = (np.concatenate(c) for c in zip(*look.close))
            by = np.argsort(r, kind="stable")
            _, met, score = _rows(r[by], v[by], s[by])
            pool = np.concatenate([_nearest(met, score, POOL)[0], pool], axis=1)
        links = robust_prune(x, batch, pool)
        edges[batch, :DEGREE] = links
        used[batch] = (links >= 0).sum(axis=1)
        _add_back(x, edges, used, batch, links)
        done += len(batch)
    return edges


def range_pairs(x: np.ndarray, edges: np.ndarray, q: np.ndarray, seeds: np.ndarray, keep: float):
    """Pairs (query, vertex) at a cosine of ``keep`` or more: a greedy search from the seeds, then expansion over the range.

    Queries are taken in chunks, which bounds the tables of seen vertices. Yields arrays of pairs.
    """
    step = max(1, CELLS // max(len(x), 1))
    for at in range(0, len(q), step):
        look = Search(x, edges, q[at : at + step])
        look.greedy(seeds[at : at + step], BEAM, keep)
        r, v = look.widen(keep)
        yield r + at, v

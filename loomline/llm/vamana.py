"""A robust-pruned directed graph over one shard of vectors, built and searched for many queries at once.

Points are inserted in growing batches. A greedy beam search over the graph so far (and the batch itself)
proposes the neighbours of a point; robust pruning keeps the nearest and drops every candidate that a kept one
is closer to by the relaxation factor; the kept edges are also added backwards, and nodes with too many edges
are pruned again. Searches run for a block of queries in step: each step opens the nearest unopened node of
every query's beam.
"""

from __future__ import annotations

import numpy as np

ENTRIES = 192


def _nearest(ids: np.ndarray, dist: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` nearest of each row, in order."""
    if dist.shape[1] > keep:
        part = np.argpartition(dist, keep - 1, axis=1)[:, :keep]
        ids, dist = np.take_along_axis(ids, part, 1), np.take_along_axis(dist, part, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


class Graph:
    """``x``: unit vectors as float32. The distance is 2 - 2 cos, the squared Euclidean one."""

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 16, alpha: float = 1.2, seed: int = 7) -> None:
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, alpha
        n = len(x)
        self.slots = degree + degree // 2
        self.edges = np.full((n, self.slots), -1, np.int32)
        self.sizes = np.zeros(n, np.int32)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.entries = order[: min(n, ENTRIES)]
        done = 0
        while done < n:
            size = max(64, min(done, 768))
            self.insert(order[done : done + size], order[:done])
            done += size

    def insert(self, batch: np.ndarray, before: np.ndarray) -> None:
        q = self.x[batch]
        # the batch itself: its members are not in the graph yet
        inner = 2 - 2 * (q @ q.T)
        np.fill_diagonal(inner, np.inf)
        keep = min(8, len(batch) - 1)
        ids = np.empty((len(batch), 0), np.int32)
        dist = np.empty((len(batch), 0), np.float32)
        if keep > 0:
            part = np.argpartition(inner, keep - 1, axis=1)[:, :keep]
            ids, dist = batch[part], np.take_along_axis(inner, part, 1)
        if len(before):
            a, b = self.search(q, self.beam)
            ids, dist = np.concatenate([ids, a], 1), np.concatenate([dist, b], 1)
        chosen = self.prune(ids, dist)
        width = chosen.shape[1]
        self.edges[batch, :width] = chosen
        self.sizes[batch] = (chosen >= 0).sum(1)
        source = np.repeat(batch, width)
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        self.add(target, source)

    def add(self, target: np.ndarray, source: np.ndarray) -> None:
        """Add the edges target -> source; where there are too many, prune."""
        new = ~(self.edges[target] == source[:, None]).any(1)
        target, source = target[new], source[new]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        free = self.sizes[target] + rank
        ok = (self.sizes[nodes] + counts <= self.slots).repeat(counts)
        self.edges[target[ok], free[ok]] = source[ok]
        fits = self.sizes[nodes] + counts <= self.slots
        self.sizes[nodes[fits]] += counts[fits].astype(np.int32)
        over = np.flatnonzero(~fits)
        for a in range(0, len(over), 2048):
            some = over[a : a + 2048]
            width = int(counts[some].max())
            ids = np.full((len(some), self.slots + width), -1, np.int32)
            ids[:, : self.slots] = self.edges[nodes[some]]
            row = np.repeat(np.arange(len(some)), counts[some])
            at = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in some])
            ids[row, self.slots + rank[at]] = source[at]
            dist = 2 - 2 * np.einsum("qkd,qd->qk", self.x[ids], self.x[nodes[some]])
            dist[ids < 0] = np.inf
            ids, dist = _nearest(ids, dist, min(ids.shape[1], 3 * self.degree))
            chosen = self.prune(ids, dist)
            self.edges[nodes[some]] = -1
            self.edges[nodes[some], : chosen.shape[1]] = chosen
            self.sizes[nodes[some]] = (chosen >= 0).sum(1)

    def prune(self, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Robust pruning of each row's candidates; at most ``degree`` ids per row, -1 behind them."""
        ids, dist = _nearest(ids, dist, ids.shape[1])
        n, width = ids.shape
        v = self.x[ids]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = (ids >= 0) & np.isfinite(dist)
        out = np.full((n, min(self.degree, width)), -1, np.int32)
        size = np.zeros(n, np.int64)
        for j in range(width):
            rows = np.flatnonzero(alive[:, j] & (size < out.shape[1]))
            if not len(rows):
                continue
            out[rows, size[rows]] = ids[rows, j]
            size[rows] += 1
            alive[rows] &= self.alpha * between[rows, j] > dist[rows]
        return out

    def search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam of every query: ids and distances, nearest first. ``own``: a node per query to start from too, or -1."""
        ids = np.empty((len(q), beam), np.int32)
        dist = np.empty((len(q), beam), np.float32)
        step = max(1, min(2048, 64_000_000 // max(1, len(self.x))))
        for a in range(0, len(q), step):
            ids[a : a + step], dist[a : a + step] = self._search(q[a : a + step], beam, None if own is None else own[a : a + step])
        return ids, dist

    def _search(self, q: np.ndarray, beam: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        m = len(q)
        seen = np.zeros((m, len(self.x) + 1), bool)
        seen[:, -1] = True  # where -1 points to
        entries = self.entries[self.sizes[self.entries] > 0]
        d = 2 - 2 * (q @ self.x[entries].T)
        ids, dist = _nearest(np.broadcast_to(entries, d.shape), d, min(beam, 6, len(entries)))
        if own is not None:
            started = (ids == own[:, None]).any(1) | (own < 0)
            ids = np.concatenate([np.where(started, -1, own)[:, None].astype(np.int32), ids], 1)
            dist = np.concatenate([np.where(started, np.inf, 0)[:, None].astype(np.float32), dist], 1)
            ids, dist = _nearest(ids, dist, min(beam, ids.shape[1]))
        if ids.shape[1] < beam:
            ids = np.concatenate([ids, np.full((m, beam - ids.shape[1]), -1, np.int32)], 1)
            dist = np.concatenate([dist, np.full((m, beam - dist.shape[1]), np.inf, np.float32)], 1)
        opened = ids < 0
        row = np.arange(m)
        seen[row[:, None], ids] = True
        live = row
        out_ids, out_dist = ids.copy(), dist.copy()
        while len(live):
            first = (~opened).argmax(1)
            more = ~opened[np.arange(len(live)), first]
            if not more.all():
                out_ids[live[~more]], out_dist[live[~more]] = ids[~more], dist[~more]
                live, ids, dist, opened, first = live[more], ids[more], dist[more], opened[more], first[more]
                if not len(live):
                    break
            at = np.arange(len(live))
            node = ids[at, first]
            opened[at, first] = True
            near = self.edges[node]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            # only what is fresh is measured
            r, c = np.nonzero(fresh)
            flat = near[r, c]
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = 2 - 2 * np.einsum("kd,kd->k", self.x[flat], q[live[r]])
            near = np.where(fresh, near, -1)
            ids, dist, opened = np.concatenate([ids, near], 1), np.concatenate([dist, d], 1), np.concatenate([opened, ~fresh], 1)
            part = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            dist = np.take_along_axis(dist, part, 1)
            order = np.argsort(dist, axis=1)
            part = np.take_along_axis(part, order, 1)
            dist = np.take_along_axis(dist, order, 1)
            ids, opened = np.take_along_axis(ids, part, 1), np.take_along_axis(opened, part, 1) | ~np.isfinite(dist)
        return out_ids, out_dist


def neighbours(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, degree: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For every query its ``k`` most similar rows of ``x`` but ``own`` (-1: none) and their cosine; -1 where there are fewer."""
    if not len(x):
        return np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf, np.float32)
    ids, dist = Graph(x, degree, beam).search(q, max(beam, k + 1), own)
    dist = np.where((ids == own[:, None]) | (ids < 0), np.inf, dist)
    ids, dist = _nearest(ids, dist, min(k, ids.shape[1]))
    ids = np.where(np.isfinite(dist), ids, -1)
    return ids.astype(np.int64), np.where(ids >= 0, 1 - dist / 2, -np.inf)

"""A hierarchical navigable small-world graph in flat neighbour arrays, built and searched in batches.

Vectors must have length 1; similarity is the dot product. Every layer is one integer array with a
row of neighbours for each node (-1 where there is none). Points are inserted in batches that grow
with the graph: a batch searches the graph as it stands, meets its own members exactly, selects
diverse neighbours, and is linked back.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a node on upper layers (twice as many on the lowest), and the width of the searches.
LINKS, BUILD_WIDTH, WIDTH = 10, 32, 24
#: Points inserted or searched at once, and nodes expanded at once for each of them.
BATCH, EXPAND = 512, 4


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), the ``width`` best found for each query, best first; -1 where fewer.
    ``entries`` has a row of start nodes for each query (-1 for none)."""
    n, m = len(queries), len(x)
    nodes = np.full((n, width), -1, dtype=np.int32)
    sims = np.full((n, width), -np.inf, dtype=np.float32)
    done = np.zeros((n, width), dtype=bool)
    seen = np.zeros(n * m, dtype=bool)
    stamp = np.empty(n * m, dtype=np.int32)
    active = np.arange(n)
    fresh = entries
    while len(active):
        rows, cols = np.nonzero(fresh >= 0)
        found = fresh[rows, cols]
        flat = active[rows] * m + found
        new = ~seen[flat]
        rows, found, flat = rows[new], found[new], flat[new]
        order = np.arange(len(flat), dtype=np.int32)
        stamp[flat] = order
        once = stamp[flat] == order
        rows, found, flat = rows[once], found[once], flat[once]
        seen[flat] = True
        got = np.einsum("ij,ij->i", queries[active[rows]], x[found])
        # the new ones of each query side by side with what it holds, and the best of both
        counts = np.bincount(rows, minlength=len(active))
        most = int(counts.max()) if len(counts) else 0
        if most:
            place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            all_nodes = np.full((len(active), width + most), -1, dtype=np.int32)
            all_sims = np.full((len(active), width + most), -np.inf, dtype=np.float32)
            all_done = np.zeros((len(active), width + most), dtype=bool)
            all_nodes[:, :width], all_sims[:, :width], all_done[:, :width] = nodes[active], sims[active], done[active]
            all_nodes[rows, width + place] = found
            all_sims[rows, width + place] = got
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            nodes[active] = np.take_along_axis(all_nodes, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
        open_sims = np.where(done[active] | (nodes[active] < 0), -np.inf, sims[active])
        take = min(EXPAND, width)
        pick = np.argpartition(-open_sims, take - 1, axis=1)[:, :take]
        good = np.take_along_axis(open_sims, pick, 1) > -np.inf
        left = good.any(axis=1)
        active, pick, good = active[left], pick[left], good[left]
        if not len(active):
            break
        chosen = np.where(good, np.take_along_axis(nodes[active], pick, 1), -1)
        marks = done[active]
        np.put_along_axis(marks, pick, np.take_along_axis(marks, pick, 1) | good, 1)
        done[active] = marks
        fresh = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def select(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (best first, -1 for none) the ``most`` neighbours: first those that are nearer
    to the point than to any chosen one, then the nearest of the rest."""
    n, width = nodes.shape
    if width <= most:
        out = np.full((n, most), -1, dtype=np.int32)
        out[:, :width] = nodes
        return out
    v = x[np.maximum(nodes, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((n, width), dtype=bool)
    nearest = np.full((n, width), -np.inf, dtype=np.float32)  # of each candidate to the chosen
    count = np.zeros(n, dtype=np.int32)
    for j in range(width):
        ok = (nodes[:, j] >= 0) & (sims[:, j] > nearest[:, j]) & (count < most)
        kept[:, j] = ok
        count += ok
        nearest = np.where(ok[:, None], np.maximum(nearest, between[:, j]), nearest)
    rank = np.where(kept, 0, 1) * (width + 1) + np.arange(width)
    rank = np.where(nodes >= 0, rank, 4 * width)
    order = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(nodes, order, 1)


class Graph:
    """The graph over the rows of ``x``."""

    def __init__(self, x: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 0) -> None:
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.width = width
        m = len(x)
        draws = np.random.default_rng(seed).random(m)
        levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(links)).astype(int), 8)
        if m:
            levels[0] = levels.max()  # the first point is the entry
        self.levels = levels
        self.layers = [np.full((m, links * (1 if k else 2)), -1, dtype=np.int32) for k in range(int(levels.max(initial=0)) + 1)]
        at = 0
        while at < m:
            size = min(BATCH, max(32, at), m - at)
            self._insert(np.arange(at, at + size))
            at += size

    def _descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """Start nodes for layer ``down_to``: greedy from the entry through the layers above."""
        start = np.zeros((len(queries), 1), dtype=np.int32)
        for k in range(len(self.layers) - 1, down_to, -1):
            start = search(self.x, self.layers[k], queries, start, 2)[0]
        return start

    def _insert(self, batch: np.ndarray) -> None:
        for k, links in enumerate(self.layers):
            own = batch[self.levels[batch] >= k]
            if not len(own):
                break
            most = links.shape[1]
            vectors = self.x[own]
            within = vectors @ vectors.T
            np.fill_diagonal(within, -np.inf)
            near = min(len(own) - 1, most)
            nodes, sims = np.empty((len(own), 0), dtype=np.int32), np.empty((len(own), 0), dtype=np.float32)
            if near > 0:
                best = np.argpartition(-within, near - 1, axis=1)[:, :near]
                nodes, sims = own[best].astype(np.int32), np.take_along_axis(within, best, 1)
            if batch[0] > 0:
                more, more_sims = search(self.x, links, vectors, self._descend(vectors, k), self.width)
                nodes, sims = np.concatenate([nodes, more], 1), np.concatenate([sims, more_sims], 1)
            if not nodes.shape[1]:
                continue
            order = np.argsort(-sims, axis=1, kind="stable")[:, : self.width]
            nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
            links[own] = chosen = self._padded(select(self.x, nodes, sims, most // 2 if k == 0 else most), most)
            self._link_back(links, own, chosen)

    @staticmethod
    def _padded(nodes: np.ndarray, most: int) -> np.ndarray:
        out = np.full((len(nodes), most), -1, dtype=np.int32)
        out[:, : nodes.shape[1]] = nodes[:, :most]
        return out

    def _link_back(self, links: np.ndarray, own: np.ndarray, chosen: np.ndarray) -> None:
        """Add the reverse of new links; a node with too many keeps diverse ones."""
        rows, cols = np.nonzero(chosen >= 0)
        to, frm = chosen[rows, cols], own[rows].astype(np.int32)
        order = np.lexsort((-np.einsum("ij,ij->i", self.x[to], self.x[frm]), to))  # the nearest first
        to, frm = to[order], frm[order]
        targets, starts, counts = np.unique(to, return_index=True, return_counts=True)
        most = links.shape[1]
        extra = np.full((len(targets), int(counts.max(initial=0))), -1, dtype=np.int32)
        extra[np.repeat(np.arange(len(targets)), counts), np.arange(len(to)) - np.repeat(starts, counts)] = frm
        extra = extra[:, : 2 * most]  # those farther away would not be selected
        both = np.concatenate([links[targets], extra], axis=1)
        # a link that is there already, once
        both = np.where((both[:, :, None] == both[:, None, :]).argmax(axis=2) == np.arange(both.shape[1]), both, -1)
        fits = (both >= 0).sum(axis=1) <= most
        if fits.any():
            few = both[fits]
            links[targets[fits]] = np.take_along_axis(few, np.argsort(few < 0, axis=1, kind="stable"), 1)[:, :most]
        for at in range(0, int((~fits).sum()), BATCH):
            who = np.nonzero(~fits)[0][at : at + BATCH]
            many = both[who]
            sims = np.where(many >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(many, 0)], self.x[targets[who]]), -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")
            links[targets[who]] = self._padded(select(self.x, np.take_along_axis(many, order, 1), np.take_along_axis(sims, order, 1), most), most)

    def neighbours(self, most: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the ``most`` nearest other nodes of every node."""
        out_nodes = np.full((len(self.x), most), -1, dtype=np.int32)
        out_sims = np.full((len(self.x), most), -np.inf, dtype=np.float32)
        for at in range(0, len(self.x), BATCH):
            own = np.arange(at, min(at + BATCH, len(self.x)), dtype=np.int32)
            nodes, sims = search(self.x, self.layers[0], self.x[own], own[:, None], max(width, most + 1))
            sims = np.where(nodes == own[:, None], -np.inf, sims)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
            out_nodes[own], out_sims[own] = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(out_sims > -np.inf, out_nodes, -1), out_sims

    def nearest(self, queries: np.ndarray, most: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the ``most`` nearest nodes of outside vectors."""
        parts = []
        for at in range(0, len(queries), BATCH):
            q = np.ascontiguousarray(queries[at : at + BATCH], dtype=np.float32)
            nodes, sims = search(self.x, self.layers[0], q, self._descend(q, 0), max(width, most))
            parts.append((nodes[:, :most], sims[:, :most]))
        if not parts:
            return np.empty((0, most), dtype=np.int32), np.empty((0, most), dtype=np.float32)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

"""Hierarchical navigable small-world graph over unit vectors, with batches of queries in step.

All queries of a batch take each step of their beam search together, as array operations.
"""

from __future__ import annotations

import numpy as np

M, M0 = 12, 24  # neighbours on upper layers and on the lowest
BUILD_BEAM = 32
UPPER_BEAM = 6
WIDE = 4  # beam members expanded in one step
VISITED_CELLS = 64_000_000
SCAN_CELLS = 2000  # a member of a beam costs about as much as so many nodes of a scan


def _merged(ids, sims, done, new_ids, new_sims, beam):
    """The best `beam` of the old members and the new ones; -1 marks a free place."""
    ids = np.concatenate([ids, new_ids], axis=1)
    sims = np.concatenate([sims, new_sims], axis=1)
    done = np.concatenate([done, new_ids < 0], axis=1)
    if ids.shape[1] > beam:
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        ids, sims, done = (np.take_along_axis(x, best, axis=1) for x in (ids, sims, done))
    return ids, sims, done


def diverse(sims_to: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """For each row the neighbours to keep of its candidates, best first: one is kept while it is
    nearer to the row's vector than to any kept before it; free places go to the best of the rest."""
    order = np.argsort(-sims_to, axis=1, kind="stable")
    sims_to, ids = np.take_along_axis(sims_to, order, axis=1), np.take_along_axis(ids, order, axis=1)
    rows, width = ids.shape
    among = np.empty((rows, width, width), np.float32)
    step = max(1, 4_000_000 // (width * vectors.shape[1]))
    for lo in range(0, rows, step):
        x = vectors.take(ids[lo : lo + step], axis=0, mode="wrap")
        among[lo : lo + step] = x @ x.transpose(0, 2, 1)
    kept, nearest = np.zeros((rows, width), bool), np.full((rows, width), -2, np.float32)  # to any that is kept
    count = np.zeros(rows, np.int64)
    for c in range(width):
        kept[:, c] = now = (nearest[:, c] < sims_to[:, c]) & (ids[:, c] >= 0) & (count < most)
        count += now
        at = np.flatnonzero(now)
        nearest[at] = np.maximum(nearest[at], among[at, c])
    rank = np.where(kept, 0, 1) * width + np.arange(width)
    rank[ids < 0] = 10 * width
    best = np.argsort(rank, axis=1, kind="stable")[:, :most]
    chosen = np.take_along_axis(ids, best, axis=1)
    if chosen.shape[1] < most:
        chosen = np.pad(chosen, ((0, 0), (0, most - chosen.shape[1])), constant_values=-1)
    return chosen.astype(np.int32)


class Graph:
    """layers[l] has the neighbours of each node on layer l, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.levels, self.layers = vectors, levels, layers
        self.entry = int(levels.argmax()) if len(levels) else -1
        self.found = self.exact = 0  # by audits of the beam of now

    @property
    def batch(self) -> int:
        return int(np.clip(VISITED_CELLS // max(1, len(self.vectors)), 16, 256))

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int) -> Graph:
        n = len(vectors)
        levels = np.minimum(8, (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(np.int64))
        order = np.argsort(-levels, kind="stable")  # from the top layer down, so that every upper layer is whole first
        graph = cls(vectors, levels, [np.full((n, M0 if layer == 0 else M), -1, np.int32) for layer in range(int(levels.max(initial=0)) + 1)])
        for layer in range(len(graph.layers) - 1, -1, -1):
            nodes = order[levels[order] >= layer]
            done = 0
            while done < len(nodes):
                size = max(1, min(256, done // 4))
                graph._insert(nodes[done : done + size], nodes[:done], layer)
                done += size
        return graph

    def _insert(self, new: np.ndarray, present: np.ndarray, layer: int) -> None:
        if not len(present):
            return
        table, x = self.layers[layer], self.vectors[new]
        if len(present) <= 2 * BUILD_BEAM:
            ids = np.broadcast_to(present, (len(new), len(present))).copy()
            sims = x @ self.vectors[present].T
        else:
            start = self.descend(x, layer)
            # A node's own upper links may lead to nodes not yet on this layer's table.
            inside = np.zeros(len(self.vectors), bool)
            inside[present] = True
            start = np.where((start >= 0) & inside[start], start, present[0])
            ids, sims = self.beam(x, start, layer, BUILD_BEAM)
        ids = np.concatenate([ids, np.broadcast_to(new, (len(new), len(new)))], axis=1)  # those that come together see each other
        together = x @ x.T
        np.fill_diagonal(together, -3)
        sims = np.concatenate([sims, together], axis=1)
        if ids.shape[1] > 2 * BUILD_BEAM:
            best = np.argpartition(-sims, 2 * BUILD_BEAM - 1, axis=1)[:, : 2 * BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
        ids = np.where(sims > -2, ids, -1)
        table[new] = diverse(sims, ids, self.vectors, table.shape[1])
        self._link_back(new, table)

    def _link_back(self, new: np.ndarray, table: np.ndarray) -> None:
        width = table.shape[1]
        to, by = table[new].ravel(), np.repeat(new, width)
        to, by = to[to >= 0], by[to >= 0]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, int(count.max(initial=0)), width):  # at most `width` new neighbours of a node at a time
            some = count > lo
            at = first[some][:, None] + lo + np.arange(width)
            extra = np.where(np.arange(width) + lo < count[some][:, None], by[np.minimum(at, len(by) - 1)], -1)
            of = targets[some]
            ids = np.concatenate([table[of], extra], axis=1)
            ids = np.sort(ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            ids[ids == of[:, None]] = -1
            for a in range(0, len(of), 4096):
                part, own = ids[a : a + 4096], of[a : a + 4096]
                sims = np.einsum("bd,bmd->bm", self.vectors[own], self.vectors[part])
                table[own] = diverse(np.where(part >= 0, sims, -3), part, self.vectors, width)

    def descend(self, x: np.ndarray, layer: int) -> np.ndarray:
        """For each query the nodes at which its search on `layer` starts."""
        start = np.full((len(x), 1), self.entry)
        for upper in range(len(self.layers) - 1, layer, -1):
            start, _ = self.beam(x, start, upper, UPPER_BEAM)
        return start

    def beam(self, x: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the nodes nearest to each query that the search finds, in no order; -1 where there is none."""
        table, n = self.layers[layer], len(x)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -3, np.float32)
        done = np.ones((n, beam), bool)
        seen = np.zeros(n * len(self.vectors), bool)
        live, new = np.arange(n), start.astype(np.int64)
        while len(live):
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            place = new + (live * len(self.vectors))[:, None]
            fresh = np.flatnonzero((new >= 0).ravel() & ~seen.take(place, mode="clip").ravel())
            seen[place.ravel()[fresh]] = True
            node = new.ravel()[fresh]
            new = np.full_like(new, -1)
            new.ravel()[fresh] = node
            found = np.full(new.shape, -3, np.float32)
            found.ravel()[fresh] = np.einsum("nd,nd->n", x.take(live.take(fresh // new.shape[1]), axis=0), self.vectors.take(node, axis=0))
            ids[live], sims[live], done[live] = _merged(ids[live], sims[live], done[live], new, found, beam)
            score = np.where(done[live], -9, sims[live])
            wide = min(max(WIDE, beam // 8), beam)
            pick = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            valid = np.take_along_axis(score, pick, axis=1) > -9
            busy = valid.any(axis=1)
            live, pick, valid = live[busy], pick[busy], valid[busy]
            if not len(live):
                break
            nodes = np.where(valid, ids[live[:, None], pick], 0)
            mark = done[live]
            np.put_along_axis(mark, pick, True, axis=1)
            done[live] = mark
            new = np.where(valid[:, :, None], table.take(nodes, axis=0), -1).reshape(len(live), -1).astype(np.int64)
        return ids, sims

    def in_range(self, x: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all that the search finds with a similarity of `least` or more.

        A beam full of such nodes may hide more: it is widened until it isn't, or until the
        scan of all nodes is as cheap.
        """
        rows, nodes = [], []
        todo, widened = np.arange(len(x)), False
        while len(todo):
            if widened and SCAN_CELLS * beam >= len(self.vectors):
                a, b = self._scanned(x[todo], least)
                rows.append(todo[a]), nodes.append(b)
                break
            ids, sims = self.beam(x[todo], self.descend(x[todo], 0), 0, beam)
            near = sims >= least
            full = near.all(axis=1)
            a, c = np.nonzero(near & ~full[:, None])
            rows.append(todo[a]), nodes.append(ids[a, c])
            todo, beam, widened = todo[full], beam * 4, True
        return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _scanned(self, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        found = [np.nonzero(x[a : a + 64] @ self.vectors.T >= least) for a in range(0, len(x), 64)]
        return np.concatenate([a + 64 * k for k, (a, _) in enumerate(found)]), np.concatenate([b for _, b in found])

    def audited(self, x: np.ndarray, least: float, beam: int, recall: float, audits: int) -> tuple[np.ndarray, np.ndarray, int]:
        """in_range(), with a beam doubled until it finds the share `recall` of what a scan finds for audited
        queries: some of all, and some of those that found anything, of all calls with this beam. Also the beam
        that passed. Where a wider one would cost as much as a scan, the queries of a call that fails are scanned,
        and the beam stays: a few links that no beam finds don't widen it for all queries to come."""
        while True:
            rows, nodes = self.in_range(x, least, beam)
            hit = np.unique(rows)
            some = np.unique(np.concatenate([np.arange(0, len(x), max(1, len(x) // audits)), hit[:: max(1, len(hit) // audits)]]))
            self.exact += len(self._scanned(x[some], least)[0])
            self.found += int(np.isin(rows, some).sum())
            if self.found >= recall * self.exact:
                return rows, nodes, beam
            if SCAN_CELLS * beam >= len(self.vectors):
                return *self._scanned(x, least), beam
            beam *= 2
            self.found = self.exact = 0

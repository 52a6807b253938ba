"""Alignment scores of many pairs at once, and bounds that tell most pairs apart without their table.

Pairs whose words have the same numbers of segments are scored in step: a cell of the
table is an array over all of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np

from glossa.sources.phonology import FEATURES, Phonology

WEIGHTS = np.array([float(w) for w, _ in FEATURES.values()])
SPANS = np.array([float(s) for _, s in FEATURES.values()])
#: Distinct segments up to which a batch's similarities are one table.
TABLE = 1000
STEP_PAIRS = 20_000


class Segments(dict):
    """A number for each segment, and its features; those without any are only like themselves."""

    def __init__(self, phonology: Phonology):
        super().__init__()
        self.phonology = phonology
        self.rows: list[list[float]] = []

    def __missing__(self, segment: str) -> int:
        f = self.phonology.features(segment)
        self.rows.append([np.nan] * len(WEIGHTS) if f is None else [float(f[n]) for n in FEATURES])
        self[segment] = found = len(self.rows) - 1
        return found

    def similarity(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the segments numbered x with those numbered y."""
        rows = np.array(self.rows).reshape(-1, len(WEIGHTS))
        total = np.zeros(np.broadcast_shapes(x.shape, y.shape))
        for k in range(len(WEIGHTS)):
            total += np.minimum(1.0, np.abs(rows[x, k] - rows[y, k]) / SPANS[k]) * WEIGHTS[k]
        found = np.clip(1 - total / WEIGHTS.sum(), 0.0, 1.0)
        return np.where(x == y, 1.0, np.nan_to_num(found, nan=0.0))


def table_scores(sim, n: int, m: int, size: int, phonology: Phonology) -> np.ndarray:
    """The greatest scores of `size` pairs of n and m segments; sim(i, j) has the similarities of the i-th and the j-th, from 0."""
    gap, expansion = phonology.gap_penalty, phonology.expansion_penalty
    top: list = []
    above = [np.full(size, j * gap) for j in range(m + 1)]
    last: list = []
    for i in range(1, n + 1):
        here = [np.full(size, i * gap)]
        sims = [sim(i - 1, j) for j in range(m)]
        for j in range(1, m + 1):
            s = sims[j - 1]
            best = np.maximum(above[j - 1] + (2 * s - 1), np.maximum(above[j], here[j - 1]) + gap)
            if j > 1:
                best = np.maximum(best, above[j - 2] + (sims[j - 2] + s - 1 + expansion))
            if i > 1:
                best = np.maximum(best, top[j - 1] + (last[j - 1] + s - 1 + expansion))
            here.append(best)
        top, above, last = above, here, sims
    return above[m]


def raw_scores(a: Iterable[Sequence[str]], b: Iterable[Sequence[str]], phonology: Phonology, segments: Segments, most: int = TABLE) -> np.ndarray:
    """The greatest alignment score of each pair of token lists; similarities are one table for up to `most` distinct segments."""
    shapes: dict[tuple[int, int], list[int]] = defaultdict(list)
    x, y = ([[segments[t] for t in word] for word in words] for words in (a, b))
    for k, (p, q) in enumerate(zip(x, y)):
        shapes[len(p), len(q)].append(k)
    used = np.unique(np.array([t for words in (x, y) for word in words for t in word], np.int64))
    table = segments.similarity(used[:, None], used[None, :]) if len(used) <= most else None
    out = np.zeros(len(x))
    for (n, m), rows in shapes.items():
        for lo in range(0, len(rows), STEP_PAIRS):
            part = rows[lo : lo + STEP_PAIRS]
            p, q = (np.array([words[k] for k in part], np.int64).reshape(len(part), -1) for words in (x, y))
            if table is not None:
                p, q = np.searchsorted(used, p), np.searchsorted(used, q)
                sim = lambda i, j, p=p, q=q: table[p[:, i], q[:, j]]
            else:
                sim = lambda i, j, p=p, q=q: segments.similarity(p[:, i], q[:, j])
            out[part] = table_scores(sim, n, m, len(part), phonology)
    return out


def shifts(n: int, m: int, least: float, phonology: Phonology) -> tuple[int, int] | None:
    """How far the m segments of a longer word may be ahead of a shorter one's n, and behind, at a similarity of `least`; None: no such pair.

    A pair that reaches it loses at most 2 (1 - least) m against m perfect matches. A move by
    which the longer word gets ahead loses 1 less the gap or expansion penalty, one by which
    the shorter does loses that penalty, and in the end the longer is ahead by m - n.
    """
    back, ahead = (min(k - phonology.gap_penalty, k - phonology.expansion_penalty) for k in (0.0, 1.0))
    if back <= 0:  # gaps that cost nothing bound nothing
        return m, n
    lost, over = 2 * (1 - least) * m + 1e-9, m - n
    if over * ahead > lost:
        return None
    return max(d for d in range(m + 1) if d * ahead + max(0, d - over) * back <= lost or d == over), max(k for k in range(n + 1) if k * back + (k + over) * ahead <= lost or k == 0)


def upper_bounds(shorter: np.ndarray, longer: np.ndarray, table: np.ndarray, least: float, phonology: Phonology) -> np.ndarray | None:
    """A bound of the score of every pair of rows of `shorter` and `longer`, numbers of segments; None: no pair reaches `least`.

    Each segment of the longer word counts for no more than its most similar segment
    within the shifts allows: as a match, a gap, or its part of an expansion.
    """
    (size, n), m = shorter.shape, longer.shape[1]
    reach = shifts(n, m, least, phonology)
    if reach is None:
        return None
    gap, expansion = phonology.gap_penalty, phonology.expansion_penalty
    sims = table[shorter].astype(np.float32)  # row, place, segment
    total = np.full((size, len(longer)), max(0.0, gap) * n, np.float32)
    for j in range(m):
        near = sims[:, max(0, j - reach[0]) : max(0, min(n, j + reach[1] + 1))]
        best = near.max(axis=1) if near.shape[1] else np.full((size, table.shape[1]), -1, np.float32)
        credit = np.maximum(np.maximum(2 * best - 1 + max(0.0, expansion), gap), best - 0.5 + expansion / 2)
        total += credit[:, longer[:, j]]
    return total

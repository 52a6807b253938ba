"""Words of a table within an edit distance of a vocabulary's: a trie of the vocabulary walked once for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and letters of a vocabulary up to which it is one trie; a larger one is walked in slices.
TRIE_WORDS, TRIE_LETTERS = 200_000, 4_000_000
_FOUND = "a string, b string, distance double"


class Trie:
    """Distinct words as flat arrays, one level after the other: a node's letter, its parent, where its children begin, and its word."""

    def __init__(self, words: list[str]):
        words = sorted(set(words))
        self.words = words
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        size = np.array([len(c) for c in codes], np.int64)
        self.letters: list[np.ndarray] = []
        self.parents: list[np.ndarray] = []
        self.ends: list[np.ndarray] = [np.flatnonzero(size == 0)[:1] if len(words) else np.empty(0, np.int64)]
        self.ended: list[np.ndarray] = [np.zeros(len(self.ends[0]), np.int64)]
        alive, node = np.flatnonzero(size > 0), np.zeros(int((size > 0).sum()), np.int64)
        depth = 0
        while len(alive):
            letter = np.array([codes[i][depth] for i in alive], np.int64)
            # In order of the words, those of one node and letter follow each other.
            new = np.ones(len(alive), bool)
            new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
            self.letters.append(letter[new])
            self.parents.append(node[new])
            node = np.cumsum(new) - 1
            depth += 1
            over = size[alive] == depth
            self.ends.append(alive[over])
            self.ended.append(node[over])
            alive, node = alive[~over], node[~over]

    def within(self, word: str, most: float) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words whose distance from `word` is at most `most`, and their distances.

        The distance is graphic_distance(). A level's nodes have their rows of the table
        side by side; a node goes on only if its row or its parent's has a value within reach.
        """
        y = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        m = len(y)
        rows = np.arange(m + 1, dtype=np.float64)[None, :]
        last = np.full(1, -1, np.int64)  # the letter of the node, none for the root
        place = np.zeros(1, np.int64)  # of a level's nodes that go on
        found, distances = [], []
        for level in range(len(self.ends)):
            if level:
                parents, letters = self.parents[level - 1], self.letters[level - 1]
                of = np.full(int(parents.max()) + 1 if len(parents) else 1, -1, np.int64)
                of[place[place < len(of)]] = np.flatnonzero(place < len(of))
                kept = np.flatnonzero(of[parents] >= 0)
                if not len(kept):
                    break
                above, before, here = rows[of[parents[kept]]], last[of[parents[kept]]], letters[kept]
                now = np.empty_like(above)
                now[:, 0] = above[:, 0] + 1
                for j in range(1, m + 1):
                    near = (before == y[j - 1]) if j == 1 else (before == y[j - 1]) | (here == y[j - 2])
                    cost = np.where(here == y[j - 1], 0.0, np.where(near, 0.5, 1.0))
                    now[:, j] = np.minimum(np.minimum(above[:, j], now[:, j - 1]) + 1, above[:, j - 1] + cost)
                on = now.min(axis=1) <= most
                rows, last, place = now[on], here[on], kept[on]
            if len(self.ends[level]):
                at = np.searchsorted(place, self.ended[level])
                met = np.flatnonzero(at < len(place))
                met = met[place[at[met]] == self.ended[level][met]]
                distance = rows[at[met], m]
                near = distance <= most
                found.append(self.ends[level][met[near]])
                distances.append(distance[near])
        return (np.concatenate(found), np.concatenate(distances)) if found else (np.empty(0, np.int64), np.empty(0))


def _looked_up(vocabulary: list[str], most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(vocabulary)
        for batch in batches:
            a, b, distance = [], [], []
            for word in batch.column(0).to_pylist():
                found, distances = trie.within(word, most)
                a += [word] * len(found)
                b += [trie.words[i] for i in found]
                distance += distances.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(distance, pa.float64())], names=_names(_FOUND))

    return run


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def words_within(words: DataFrame, vocabulary: DataFrame, most: float, trie_words: int = TRIE_WORDS) -> DataFrame:
    """a, b, distance: the words (column word) and the vocabulary's whose graphic distance is at most `most`.

    Both are taken once each; nulls are left out. The vocabulary is the side that travels:
    counted first, it goes to the tasks as one list, or as several slices by a hash of the
    word if it has over `trie_words` words or TRIE_LETTERS letters, each walked in turn.
    """
    a, b = (df.select("word").where("word is not null").distinct() for df in (words, vocabulary))
    size = b.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("letters")).first()
    slices = max(1, -(-size.n // trie_words), -(-size.letters // TRIE_LETTERS))
    found = None
    for k in range(slices):
        part = b if slices == 1 else b.where(F.pmod(F.xxhash64("word"), F.lit(slices)) == k)
        made = a.mapInArrow(_looked_up([r.word for r in part.collect()], most), _FOUND)
        found = made if found is None else found.unionByName(made)
    return found


def banded_distances(a: list[str], b: list[str], most: float) -> np.ndarray:
    """graphic_distance() of each pair if it is at most `most`, else nan.

    All pairs are walked in step, in a band of the table about its diagonal that is as wide
    as insertions and deletions reach; it ends when no pair has a value within reach.
    """
    k = int(most)
    n, m = (np.array([len(t) for t in side], np.int64) for side in (a, b))
    out = np.full(len(a), np.nan)
    alive = np.flatnonzero(np.abs(n - m) <= k)
    if not len(alive):
        return out
    width, longest = 2 * k + 1, int(max(n[alive].max(), m[alive].max()))

    def codes(texts: list[str]) -> np.ndarray:
        found = np.full((len(alive), longest + 2 * k + 3), -1, np.int64)  # letter i at i + k + 1
        for row, i in enumerate(alive):
            found[row, k + 2 : k + 2 + len(texts[i])] = np.frombuffer(texts[i].encode("utf-32-le"), np.uint32)
        return found

    x, y = codes(a), codes(b)
    n, m = n[alive], m[alive]
    offsets = np.arange(-k, k + 1)
    above = np.where(offsets < 0, np.inf, offsets.astype(np.float64)) * np.ones((len(alive), 1))
    above[offsets > m[:, None]] = np.inf
    for i in range(longest + 1):
        if i:
            here = np.full_like(above, np.inf)
            letter, before = x[:, i + k + 1], x[:, i + k]
            for o in range(width):
                j = i + o - k
                if j < 0 or j > longest:
                    continue
                if j == 0:
                    here[:, o] = i
                    continue
                same, there = y[:, j + k + 1], y[:, j + k]
                near = (letter == there) if j > 1 else np.zeros(len(letter), bool)
                near = near | (before == same) if i > 1 else near
                best = above[:, o] + np.where(letter == same, 0.0, np.where(near, 0.5, 1.0))
                if o + 1 < width:
                    best = np.minimum(best, above[:, o + 1] + 1)
                if o:
                    best = np.minimum(best, here[:, o - 1] + 1)
                here[:, o] = np.where(j <= m, best, np.inf)
            above = here
        done = n == i
        if done.any():
            value = above[done, (m[done] - i) + k]
            out[alive[done]] = np.where(value <= most, value, np.nan)
        on = ~done & (above.min(axis=1) <= most)
        if not on.all():
            alive, n, m, x, y, above = alive[on], n[on], m[on], x[on], y[on], above[on]
            if not len(alive):
                break
    return out


def distance_within(pairs: DataFrame, most: float, a: str = "a", b: str = "b") -> DataFrame:
    """The columns of pairs with distance: the graphic distance if it is at most `most`, else null; null for null texts.

    Work grows with the texts' length and with `most`, not with the square of the length.
    """

    def run(x, y):
        import pandas as pd

        known = [i for i, (p, q) in enumerate(zip(x, y)) if p is not None and q is not None]
        found = pd.Series([None] * len(x), dtype="float64")
        got = banded_distances([x.iloc[i] for i in known], [y.iloc[i] for i in known], most)
        found.iloc[known] = got
        return found

    measured = F.pandas_udf(run, "double")(a, b)
    return pairs.withColumn("distance", F.nanvl(measured, F.lit(None).cast("double")))

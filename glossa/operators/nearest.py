"""The nearest vectors of every row by cosine, without a table of all pairs.

Rows are dealt into parts, and each two parts meet in a task, which multiplies their
blocks as matrices and keeps the best k of each row as it goes: bounded rows, which one
aggregate for each row merges.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 16
PART_BYTES = 64 << 20
BLOCK_ROWS = 1024
DIGITS = 9
_TOP = "id long, other long, cosine double"


class _Best:
    """The best k others of each row of a block, by cosine to DIGITS decimals and then by id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.row, self.other, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def add(self, cosine: np.ndarray, others: np.ndarray) -> None:
        """cosine: of each row with each of the others, -inf where they aren't to be compared."""
        least = self.least
        if cosine.shape[1] > self.k:
            least = np.maximum(least, np.partition(cosine, -self.k, axis=1)[:, -self.k]) if np.isinf(least).any() else least
        # What is below the kth by more than rounding can't be among the best.
        row, at = np.nonzero((cosine >= (least - 10.0**-DIGITS)[:, None]) & (cosine > -np.inf))
        if not len(row):
            return
        row, other = np.concatenate([self.row, row]), np.concatenate([self.other, others[at]])
        value = np.concatenate([self.value, np.round(cosine[row[len(self.row) :], at], DIGITS)])
        order = np.lexsort((other, -value, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[place < self.k]
        full = order[place == self.k - 1]
        self.row, self.other, self.value = (np.concatenate([self.row[:0], c]) for c in (row[place < self.k], other[kept], value[kept]))
        self.least[row[place == self.k - 1]] = value[full]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.other), pa.array(self.value)], names=["id", "other", "cosine"])


def _units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that take part, which have one length, and their unit vectors; zero vectors stay zero."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    at = np.flatnonzero(np.isfinite(x).all(axis=1))  # nulls have become NaN
    x = x[at]
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return at, x / np.where(size > 0, size, 1)


def _top(k: int, block_rows: int):
    """(pair, part, dim, id, vector) to _TOP: the best k for each row of either part, of those of the other, or within the pair's one part."""

    def found_in(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at, units = _units(table.column("vector").combine_chunks())
        ids, part = table.column("id").to_numpy()[at], table.column("part").to_numpy()[at]
        sides = []
        for s in np.unique(part):
            rows = np.flatnonzero(part == s)
            sides.append([(ids[r], units[r], _Best(ids[r], k)) for r in (rows[i : i + block_rows] for i in range(0, len(rows), block_rows))])
        if not sides or len(sides) == 1 and table.column("both")[0].as_py():
            return
        for i, (a, x, best) in enumerate(sides[0]):
            for j, (b, y, back) in enumerate(sides[-1][i:] if len(sides) == 1 else sides[1]):
                cosine = x @ y.T
                if len(sides) == 1:  # equal ids are in one part
                    cosine[a[:, None] == b] = -np.inf
                best.add(cosine, b)
                if back is not best:
                    back.add(cosine.T, a)
        for side in sides:
            yield from (best.rows() for _, _, best in side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[pa.RecordBatch]] = defaultdict(list)
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            for key in np.unique(keys, axis=0):
                held[tuple(key)].append(batch.filter(pa.array((keys == key).all(axis=1))))
        for key in list(held):
            yield from found_in(pa.Table.from_batches(held.pop(key)))

    return run


def nearest_vectors(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, rank, other, cosine: for each row its k nearest others by cosine, to DIGITS decimals; ties by smaller id, ranked from 1.

    A zero vector has cosine 0 with all. Rows with a null id, a null or empty vector, or a
    null or non-finite component take no part; vectors of different lengths aren't
    compared; rows that repeat an id aren't each other's neighbours. A row is copied for
    each of the PARTS parts, of which there are more only where one would pass PART_BYTES;
    a task holds two.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and size(vector) > 0")
    n, numbers = rows.agg(F.count("*"), F.sum(F.size("vector").cast("long"))).first()
    parts = max(1, min(PARTS, -(-n // block_rows)), -(-8 * (numbers or 0) // PART_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.size("vector").alias("dim"), "id", "vector").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    p, q = F.least("part", "other"), F.greatest("part", "other")
    each = dealt.select((q * (q + 1) / 2 + p).cast("int").alias("pair"), "dim", (p < q).alias("both"), "part", "id", "vector")
    tops = each.repartitionById(parts * (parts + 1) // 2, "pair").mapInArrow(_top(k, block_rows), _TOP)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other"))), 1, k)  # k for each part
    merged = tops.groupBy("id").agg(best.alias("best")).select("id", F.posexplode("best").alias("rank", "x"))
    return merged.select("id", (F.col("rank") + 1).alias("rank"), F.col("x.other").alias("other"), (-F.col("x.far")).alias("cosine"))

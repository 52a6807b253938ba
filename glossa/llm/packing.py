"""Vector bin packing of documents into training sequences.

Each partition packs what it reads, in the order in which it reads it, so that nothing
is shuffled and a lost task gives the same sequences again. A document's whole runs of
`max_tokens` are sequences of their own; the rest goes to a pool of bounded size. A bin
takes, again and again, the piece of the pool with the largest dot product of its
demand and the bin's room, both as fractions of the limits on tokens, segments and
loss-bearing tokens. When no piece fits and there is room, one is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import bounded_batches
from glossa.llm.tokens import VOCABULARY, Encoder

END_ID = 1
POOL = 1024


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


class Pool:
    """Pieces (row, start, length, loss): the loss-bearing tokens of a piece are its last ones."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.full = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
        self.rows = np.zeros((2 * POOL, 4), np.int64)
        self.n = 0

    def add(self, row: int, start: int, length: int, loss: int) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = row, start, length, loss
        self.n += 1

    def take(self, i: int) -> tuple[int, int, int, int]:
        found = tuple(int(x) for x in self.rows[i])
        self.n -= 1
        self.rows[i] = self.rows[self.n]
        return found

    def fill(self) -> list[tuple[int, int, int]]:
        """Fills one sequence: its pieces (row, start, length)."""
        room, pieces = self.full.copy(), []
        demand = np.ones((self.n, 3))
        demand[:, 0], demand[:, 2] = self.rows[: self.n, 2], self.rows[: self.n, 3]
        while self.n and room[0] >= 1 and room[1] >= 1:
            score = (demand / self.full) @ (room / self.full)
            score[(demand > room).any(axis=1)] = -1
            best = int(score.argmax())
            if score[best] >= 0:
                row, start, length, loss = self.take(best)
                demand[best] = demand[-1]
                demand = demand[:-1]
            else:  # nothing fits: the piece that is cut deepest keeps its tail in the pool
                best = int(demand[:, 0].argmax())
                row, start, length, loss = self.take(best)
                demand[best] = demand[-1]
                demand = demand[:-1]
                free = length - loss  # tokens before the loss-bearing ones
                head = int(min(room[0], length - 1, free + room[2]))
                if head < 1:
                    self.add(row, start, length, loss)
                    break
                self.add(row, start + head, length - head, min(loss, length - head))
                demand = np.concatenate([demand, [[length - head, 1, min(loss, length - head)]]])
                length, loss = head, max(0, head - free)
            room -= (length, 1, loss)
            pieces.append((row, start, length))
        return pieces


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """An unfilled sequence as sequences whose lengths are powers of two, so that none is padded."""
    left = sum(p[2] for p in pieces)
    queue = list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            row, start, length = queue.pop()
            cut = min(size, length)
            if cut < length:
                queue.append((row, start + cut, length - cut))
            out.append((row, start, cut))
            size -= cut
        yield out


def _packer(limits: Limits, end_id: int, vocabulary: str, with_loss: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pool = Encoder(vocabulary), Pool(limits)
        docs: dict[int, list] = {}  # row: [doc_id, ids, tokens not yet out]
        next_id = TaskContext.get().partitionId() << 40
        out: list[list] = [[] for _ in schema]
        held = 0
        row = 0

        def put(pieces) -> None:
            nonlocal next_id, held
            offset = 0
            for r, start, length in pieces:
                doc = docs[r]
                ids = doc[1][start : start + length]
                for column, x in zip(out, (doc[0], start, length, zlib.crc32(ids.astype("<u4").tobytes()), len(doc[1]), next_id, offset, ids)):
                    column.append(x)
                offset += length
                held += length
                doc[2] -= length
                if not doc[2]:
                    del docs[r]
            next_id += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            arrays = [pa.array(c, f.type) for c, f in zip(out[:-1], schema)]
            sizes = np.cumsum([0] + [len(x) for x in out[-1]])
            values = np.concatenate(out[-1]).astype(np.int32) if out[-1] else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))
            for column in out:
                column.clear()
            held = 0
            return pa.RecordBatch.from_arrays([*arrays, ids], schema=schema)

        def fill() -> None:
            pieces = pool.fill()
            if sum(p[2] for p in pieces) < limits.tokens:  # closed by another limit, or the last
                for part in _powers(pieces):
                    put(part)
            else:
                put(pieces)

        for batch in batches:
            losses = batch.column(2).to_pylist() if with_loss else None
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                ids = np.append(encoder.encode(text.as_py()), np.uint32(end_id))
                n = len(ids)
                loss = n if losses is None else max(0, min(n, losses[k] if losses[k] is not None else n))
                docs[row] = [doc_id, ids, n]
                start = 0
                while n - start >= limits.tokens and limits.loss_tokens >= limits.tokens:
                    put([(row, start, limits.tokens)])
                    start += limits.tokens
                while n - start > limits.tokens:
                    pool.add(row, start, limits.tokens, max(0, limits.tokens - max(0, n - start - loss)))
                    start += limits.tokens
                if start < n:
                    pool.add(row, start, n - start, min(loss, n - start))
                row += 1
                while pool.n >= 2 * POOL:
                    fill()
                if held >= 500_000:
                    yield flush()
        while pool.n:
            fill()
            if held >= 500_000:
                yield flush()
        yield flush()

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    limits: Limits = Limits(),
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids: one row per piece.

    Each document is its ids and then `end_id`; null and empty texts have that id alone.
    Each id lies in exactly one piece. loss_col names the count of a document's last
    tokens that bear loss; null, or no such column: all of them. Rows that repeat an id
    are packed each on its own; a null id stays null. Extra columns are ignored, and an
    empty table gives no pieces. A sequence that isn't full, as it ends a partition or a
    limit other than tokens has closed it, is cut into such whose lengths are powers of two.
    """
    bounded_batches(docs.sparkSession)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if loss_col:
        columns.append(F.col(loss_col).cast("long").alias("loss"))
    return docs.select(*columns).mapInArrow(
        _packer(limits, end_id, vocabulary, loss_col is not None),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>",
    )


def op5_vector_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")

"""Buckets of equal band keys, found over packed arrays instead of a row for each key.

Each task sorts a chunk of its keys. Nodes that meet in a chunk are members there, with
the smallest as their hub; only one node of a key and chunk goes on, so a key that a
third of all rows have is a row for each chunk and no more. What goes on is dealt by key
range and sorted again in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import Scratch
from glossa.llm.words import MULTIPLIER, mix

BAND = np.uint64(63)  # the bits of a key that name its band
LONG_TEXT = 20_000
CHUNK_KEYS = 1 << 20
PART_BYTES = 32 << 20
RANGES_A_PART = 4
FEW, MOST_PAIRS = 64, 1 << 16
_OUT_ROWS = 100_000


def _met(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """The distinct keys in order, the smallest node of each, and (keys, nodes, hubs) of all keys with two nodes at least."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    hubs, last = (f.reduceat(nodes, first) if len(first) else nodes for f in (np.minimum, np.maximum))
    size = np.diff(np.append(first, len(keys)))
    open_ = np.repeat(hubs < last, size)
    return keys[first], hubs, (keys[open_], nodes[open_], np.repeat(hubs, size)[open_])


def _packed(parts: int):
    """(node, bands) to (part, keys, nodes, hubs): hubs is null where members of a range of keys are still to be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = chunks = 0

        def out() -> pa.RecordBatch:
            nonlocal chunks
            keys, nodes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            keys, nodes, members = _met(keys, nodes)
            at = np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            rows = [(p, keys[a:b].tobytes(), nodes[a:b].tobytes(), None) for p, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if a < b]
            for lo in range(0, len(members[0]), _OUT_ROWS):
                chunks += 1
                rows.append(((chunks * 0x9E3779B1 + len(keys)) % parts, *(x[lo : lo + _OUT_ROWS].tobytes() for x in members)))
            types = pa.int32(), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "keys", "nodes", "hubs"])

        for batch in batches:
            bands = batch.column(1)
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(bands.to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            band = np.arange(keys.shape[1], dtype=np.uint64)
            keys = (mix(keys + (band + np.uint64(1)) * MULTIPLIER) & ~BAND | band).ravel()
            held.append((keys, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(band))))
            n += len(keys)
            if n >= CHUNK_KEYS:
                yield out()
                n = 0
        if n:
            yield out()

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of _packed() to (key, node, hub)."""

    def rows(keys, nodes, hubs) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(keys), _OUT_ROWS):
            part = [pa.array(x[lo : lo + _OUT_ROWS].view(np.int64)) for x in (keys, nodes, hubs)]
            yield pa.RecordBatch.from_arrays(part, names=["key", "node", "hub"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for keys, nodes, hubs in zip(*(batch.column(c) for c in ("keys", "nodes", "hubs"))):
            pair = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(nodes.as_buffer(), np.int64)
            if hubs.is_valid:
                yield from rows(*pair, np.frombuffer(hubs.as_buffer(), np.int64))
            else:
                held.append(tuple(x.copy() for x in pair))
    if held:
        keys, nodes = (np.concatenate(x) for x in zip(*held))
        held.clear()
        yield from rows(*_met(keys, nodes)[2])


def members(banded: DataFrame, bands: int, scratch: Scratch) -> DataFrame:
    """key, node, hub: the nodes of every key, a band's value, that two different nodes have.

    banded: node (long), bands (binary: a 64-bit value for each of `bands` bands), saved. hub is the smallest
    node of the key among some of its nodes; the links of nodes and hubs of a key connect
    all of its nodes, with a smallest one to which every other leads. A hub of some may
    come twice, as a node of the others too. Nodes of `banded` may repeat.
    """
    spark = banded.sparkSession
    n = banded.count() * bands
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-16 * n // PART_BYTES))
    dealt = banded.select("node", "bands").mapInArrow(_packed(RANGES_A_PART * parts), "part int, keys binary, nodes binary, hubs binary")
    return scratch.save(dealt.repartition(parts, "part").mapInArrow(_unpacked, "key long, node long, hub long"))


class Sets(dict):
    """Sets of texts, as sorted arrays of 64-bit hashes; a memo, emptied when it holds much."""

    def __init__(self, make: Callable[[str], np.ndarray]):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, text: str) -> np.ndarray:
        if self.held > 1_000_000:
            self.clear()
            self.held = 0
        found = self.make(text)
        self.held += len(text) + 50
        self[text] = found
        return found


def reaches(x: np.ndarray, y: np.ndarray, threshold: Fraction) -> bool:
    """Whether the Jaccard similarity of two sets, as sorted arrays, is at least the threshold."""
    num, den = threshold.numerator, threshold.denominator
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    both = int((both[1:] == both[:-1]).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: every two places of each group, groups of these sizes lying one after the other."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(ends))
    after = ends - at - 1
    i = np.repeat(at, after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def _joined(maker: Callable[[], Callable[[str], np.ndarray]], threshold: Fraction, bands: int, hashes: int, bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(maker())

        def joined(table: pa.Table) -> pa.RecordBatch:
            """The links of some whole buckets."""
            keys, nodes, comps = (table.column(c).to_numpy() for c in range(3))
            packed = table.column(3).to_pylist()
            sigs = np.frombuffer(b"".join(packed), f"u{len(packed[0]) // hashes}").reshape(len(packed), hashes)
            own = np.frombuffer(b"".join(o or s for o, s in zip(table.column(4).to_pylist(), packed)), np.uint64).reshape(len(packed), bands)
            texts = table.column(5).combine_chunks()
            links, up = [], {}

            def root(c: int) -> int:
                while (d := up.get(c, c)) != c:
                    up[c] = c = up.get(d, d)
                return c

            def compare(i: np.ndarray, j: np.ndarray) -> None:
                apart = comps[i] != comps[j]
                i, j = i[apart], j[apart]
                first = (own[i] == own[j]).argmax(axis=1) == (keys[i] & int(BAND))
                i, j = i[first], j[first]
                agreed, done = np.zeros(len(i), np.int64), 0
                for n, least in bounds:
                    agreed += (sigs[i, done:n] == sigs[j, done:n]).sum(axis=1)
                    left = agreed >= least
                    i, j, agreed, done = i[left], j[left], agreed[left], n
                order = np.lexsort((-agreed, keys[i]))
                for x, y in zip(i[order].tolist(), j[order].tolist()):
                    c, d = root(int(comps[x])), root(int(comps[y]))
                    if c == d:
                        continue
                    s, t = texts[x], texts[y]
                    sure = s.is_valid and t.is_valid
                    if not sure or reaches(sets[s.as_py()], sets[t.as_py()], threshold):
                        m, n = int(nodes[x]), int(nodes[y])
                        links.append((min(m, n), max(m, n), sure))
                        if sure:
                            up[c] = d

            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(start, len(keys)))
            few = np.flatnonzero(np.repeat(size <= FEW, size))
            i, j = _pairs(size[size <= FEW])
            for lo in range(0, len(i), MOST_PAIRS):
                compare(few[i[lo : lo + MOST_PAIRS]], few[j[lo : lo + MOST_PAIRS]])
            for a, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist()):
                # Any two of different components have one that isn't in the largest: only these are compared with the rest.
                here = comps[a : a + n]
                kinds, sizes = np.unique(here, return_counts=True)
                left = np.ones(n, bool)
                for k in np.flatnonzero(here != kinds[sizes.argmax()]).tolist():
                    left[k] = False
                    others = np.flatnonzero(left) + a
                    compare(np.full(len(others), a + k), others)
            columns = zip(*links) if links else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "sure"])

        held: list[pa.RecordBatch] = []  # the last bucket so far
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            last = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
            if held and (last or held[0].column(0)[-1].as_py() != keys[0]):
                yield joined(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield joined(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield joined(pa.Table.from_batches(held))

    return run


def joined_in_buckets(rows: DataFrame, maker: Callable[[], Callable[[str], np.ndarray]], threshold: Fraction, bands: int, hashes: int, bounds: list[tuple[int, int]], scratch: Scratch) -> DataFrame:
    """Pairs (a, b, sure), a < b, that join components of one bucket of (key, node, comp, sig, bands, text); sizes of buckets must be bounded.

    bands are the values that members() got; null: sig is these bytes. Two nodes are
    compared in the bucket of the first band whose value they share, batch by batch of
    `hashes` signature parts: fewer than m agreements in the first n, for any (n, m) of
    `bounds`, drop the pair. Earlier links of the bucket needn't be found again. What is
    left is verified exactly, by the sets that maker()(text) gives, so that it is sure.
    Long texts don't travel with every key: pairs of these are given as they are, not sure.
    """
    text = F.when(F.length("text") <= LONG_TEXT, F.col("text")).alias("text")
    dealt = rows.select("key", "node", "comp", "sig", "bands", text).repartition("key").sortWithinPartitions("key")
    return scratch.save(dealt.mapInArrow(_joined(maker, threshold, bands, hashes, bounds), "a long, b long, sure boolean"))

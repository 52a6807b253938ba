"""Near-duplicate vectors: a navigable small-world graph per shard, every shard queried.

Equal vectors fall into one class. Classes are dealt to shards by a hash; each shard's
graph is built by one task and stored. Then every class queries every shard: a task holds
one shard's graph and streams queries past it, of which it keeps a batch at a time. As
queries take no memory, there are only so many slices of them as keep all cores busy, or
a lost task cheap; a graph is shipped once for each slice. Beams widen until audits
against a scan of the shard pass. Links found are verified by cosine in double precision;
each task gives counts and a spanning forest of its links, not its pairs, and the forests
are united by distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.hnsw import Graph
from glossa.llm.shared import Scratch, components

COSINE = 0.9
SHARDS = 8
SHARD_ROWS = 200_000
SLICE_ROWS = 2_000_000
BEAM = 16
AUDIT_RECALL, AUDITS = 0.995, 16
SLACK = 1e-4


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, dim, vec): the vector in double precision, its largest component scaled to 1; null vec if it links with nothing."""
    for batch in batches:
        sizes = batch.column(1).value_lengths().fill_null(0).to_numpy()
        flat = batch.column(1).flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # null: NaN
        start, dims, vecs = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int32), [None] * len(sizes)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == dim)
            x = flat[start[rows][:, None] + np.arange(dim)]
            fit = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, rows = x[fit], rows[fit]
            dims[rows] = dim
            for row, v in zip(rows.tolist(), x / np.abs(x).max(axis=1, keepdims=True) + 0.0):  # -0.0 and 0.0 alike
                vecs[row] = v.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(vecs, pa.binary())], names=["id", "dim", "vec"])


def _unit(vecs: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_GRAPH = "dim int, shard int, place int, rep long, copies long, vec binary, level int, links binary"


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one shard after the other to those of its graph: links has a node's neighbours, layer by layer."""
    held, key = [], None

    def built() -> Iterator[pa.RecordBatch]:
        dim, shard = key
        graph = Graph.build(_unit([r[4] for r in held], dim).astype(np.float32), seed=shard)
        for lo in range(0, len(held), 2048):
            at = range(lo, min(len(held), lo + 2048))
            links = [b"".join(layer[i].tobytes() for layer in graph.layers[: graph.levels[i] + 1]) for i in at]
            columns = [[dim] * len(at), [shard] * len(at), list(at), [held[i][2] for i in at], [held[i][3] for i in at], [held[i][4] for i in at], graph.levels[lo : lo + len(at)].tolist(), links]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _GRAPH.split(", ")])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key and held:
                yield from built()
                held = []
            key = row[:2]
            held.append(row)
    if held:
        yield from built()


def _loaded(rows: list[tuple], dim: int) -> Graph:
    """The graph of rows (place, rep, copies, vec, level, links)."""
    from glossa.llm.hnsw import M, M0

    levels = np.array([r[4] for r in rows], np.int64)
    layers = [np.full((len(rows), M0 if layer == 0 else M), -1, np.int32) for layer in range(int(levels.max()) + 1)]
    for i, r in enumerate(rows):
        links, at = np.frombuffer(r[5], np.int32), 0
        for layer in layers[: r[4] + 1]:
            layer[i] = links[at : at + layer.shape[1]]
            at += layer.shape[1]
    return Graph(_unit([r[3] for r in rows], dim).astype(np.float32), levels, layers)


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers of which repartition(n, number) puts each into a partition of its own, so that no task gets two of them."""
    at, size = {}, 8 * n
    while len(at) < n:
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        at = {r.p: r.i for r in spark.range(size, numPartitions=1).groupBy(place.alias("p")).agg(F.min("id").cast("int").alias("i")).collect()}
        size *= 4
    return [at[p] for p in range(n)]


class Forest(dict):
    """Union-find over the ids that one task has linked."""

    def root(self, x: int) -> int:
        top = x
        while (up := self.setdefault(top, top)) != top:
            top = up
        while x != top:
            self[x], x = top, self[x]
        return top

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def _searched(cosine: float):
    """Rows of one task after the other, the graph's first, to (a, b, n): n linked rows of a in the shard, or a link a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, graph, rows, forest, beam = None, None, [], Forest(), BEAM
        units = reps = copies = None
        pending: list[tuple[int, bytes]] = []

        def out(a, b, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        def search(dim: int) -> pa.RecordBatch:
            nonlocal graph, units, reps, copies, beam
            if graph is None:
                graph = _loaded(rows, dim)
                units = _unit([r[3] for r in rows], dim)
                reps, copies = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
                rows.clear()
                beam = BEAM
            x = _unit([v for _, v in pending], dim)
            own = np.array([i for i, _ in pending], np.int64)
            q, node, beam = graph.audited(x.astype(np.float32), cosine - SLACK, beam, AUDIT_RECALL, AUDITS)
            sure = np.concatenate([np.empty(0, bool), *(np.einsum("nd,nd->n", x[q[i : i + 8192]], units[node[i : i + 8192]]) >= cosine for i in range(0, len(q), 8192))])
            q, node = q[sure], node[sure]
            other = reps[node] != own[q]
            q, node = q[other], node[other]
            n = np.bincount(q, copies[node], len(own)).astype(np.int64)
            for a, b in zip(own[q].tolist(), reps[node].tolist()):
                forest.unite(a, b)
            pending.clear()
            some = np.flatnonzero(n)
            return out(own[some], [None] * len(some), n[some])

        def links() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(forest) if (r := forest.root(x)) != x]
            forest.clear()
            return out([x for x, _ in pairs], [r for _, r in pairs], [0] * len(pairs))

        dim = 0
        for batch in batches:
            for t, d, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, d) != task:
                    if pending:
                        yield search(dim)
                    yield links()
                    task, graph, dim = (t, d), None, d
                    rows.clear()
                if kind == 0:
                    rows.append(tuple(row))
                elif rows or graph is not None:  # a shard without vectors of this dimension has nothing to find
                    pending.append((row[1], row[3]))
                    if len(pending) >= (graph.batch if graph is not None else 64):
                        yield search(dim)
        if pending:
            yield search(dim)
        yield links()

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Vectors of a cosine of at least `cosine` are linked; n_links counts the other rows
    linked directly, component_id is the smallest id reachable by links. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and so do
    vectors of different lengths and rows with a null id (kept, component_id null). Rows
    that repeat an id are vectors of their own that share its component. Extra columns
    are ignored; no rows give no rows. The number of shards is `shards`, or as many as
    keep them at about `shard_rows` vectors.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.save(vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(_prepared, "id long, dim int, vec binary"))
    usable = rows.where("vec is not null and id is not null")
    # Numbers of their own, as two classes may have the same smallest id.
    classes = scratch.save(usable.groupBy("dim", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    n = classes.count()
    spark = vectors.sparkSession
    shards = max(shards, -(-n // shard_rows))
    slices = max(-(-2 * spark.sparkContext.defaultParallelism // shards), -(-n // slice_rows))
    shard = F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")
    keys = F.array(*map(F.lit, partition_keys(spark, shards)))
    dealt = classes.select("dim", shard.alias("shard"), "rep", "copies", "vec", F.get(keys, shard).alias("part")).repartition(shards, "part").drop("part").sortWithinPartitions("dim", "shard", "vec")
    graphs = scratch.save(dealt.mapInArrow(_graphs, _GRAPH))

    task = F.col("shard") * slices + F.col("slice")
    of_graph = graphs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(task.alias("task"), "dim", F.lit(0).alias("kind"), "place", "rep", "copies", "vec", "level", "links")
    asked = classes.withColumn("slice", F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(slices)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asked = asked.select(task.alias("task"), "dim", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("place"), "rep", F.lit(None).cast("long").alias("copies"), "vec", F.lit(None).cast("int").alias("level"), F.lit(None).cast("binary").alias("links"))
    keys = F.array(*map(F.lit, partition_keys(spark, shards * slices)))
    both = of_graph.unionByName(asked).withColumn("part", F.get(keys, F.col("task"))).repartition(shards * slices, "part").drop("part").sortWithinPartitions("task", "dim", "kind", "place", "rep")
    found = scratch.save(both.mapInArrow(_searched(cosine), "a long, b long, n long"))

    links = found.where("b is not null").select("a", "b")
    # Rows that share an id share a component, but aren't linked by that.
    key = F.xxhash64("vec")
    several = scratch.save(usable.groupBy("id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x < y").select("id"))
    if not several.isEmpty():
        of_id = scratch.save(usable.join(several, "id").select("id", "dim", "vec").join(classes, ["dim", "vec"]).select("id", "rep").distinct())
        links = links.unionByName(of_id.join(of_id.groupBy("id").agg(F.min("rep").alias("b")), "id").select(F.col("rep").alias("a"), "b").where("a <> b"))
    linked = components(links, scratch)
    # Rows of one class are linked with each other.
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    by_class = classes.join(counts, "rep", "left").join(linked, classes["rep"] == linked["node"], "left")
    by_class = by_class.select("vec", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    tops = by_class.where("component is not null").groupBy("component").agg(F.min("least").alias("top"))
    by_class = by_class.join(tops, "component", "left").select("vec", "n_links", F.coalesce("top", "least").alias("comp"))
    return rows.join(by_class, (rows["vec"] == by_class["vec"]) & rows["id"].isNotNull(), "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id"),
        F.coalesce(F.coalesce("comp", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op10_hnsw_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

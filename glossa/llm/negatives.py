"""Hard negatives by exact search in K-means inverted lists with stored centroid radii.

Vectors are rows of whole numbers; a score is their inner product. Centroids are fitted on
a bounded sample, every row goes into the list of its nearest centroid, and a cluster
keeps the largest distance of its rows from the centroid, its radius. For an anchor a and
any row x of a cluster with centroid c and radius r, a.x lies within a.c -+ |a| r (Cauchy
and Schwarz). Anchors visit clusters by upper bound, a few in the first round and four times
as many in each later one, skip those whose bounds lie outside their window, and stop
when the bound falls strictly below their kth score. The result is exact, whatever the
sample or the clusters: they only decide how much is skipped.

Anchors travel in blocks of one cluster and rows in lists of bounded size, a large
cluster's in many, so that a visit is a join of a block with a list and a product of two
matrices; no row is paired with another outside of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import Scratch

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
LIST_ROWS, BLOCK_ROWS = 1024, 256
MOST_CLUSTERS, CENTROID_BYTES = 4096, 16 << 20
SAMPLE_ROWS, SAMPLE_BYTES, STEPS = 20_000, 32 << 20, 8
LENGTHS = 8
FIRST_VISITS, MORE_VISITS = 2, 4
NONE = -(1 << 62)
MOST = 1 << 56
_KEEP = 200_000

_ROWS = "dim int, id long, label long, anchor boolean, vec binary"
_LISTS = "dim int, cluster int, n int, radius double, ids binary, labels binary, vecs binary"
_STATE = "dim int, block long, ids binary, labels binary, vecs binary, top binary, pos binary"
_VISITS = "dim int, cluster int, block long, who binary, ids binary, labels binary, vecs binary, floors binary, mosts binary"


def _batch(columns: list[list], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _scaled(scale: int):
    """(id, label, anchor, vector) to rows of whole numbers; those that can't take part go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for id_, label, anchor, vector in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if id_ is None or label is None or not vector or None in vector:
                    continue
                x = np.array(vector, np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(scale * x), -1e300, 1e300) + 0.0
                for column, value in zip(out, (len(x), id_, label, bool(anchor), x.tobytes())):
                    column.append(value)
            yield _batch(out, _ROWS)

    return run


def _matrix(vecs: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(vecs, np.float64).reshape(-1, dim)


def _norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, keepdims=True)  # squares of large components would overflow
    return (np.sqrt(np.square(x / np.where(most > 0, most, 1)).sum(axis=1, keepdims=True)) * most)[:, 0]


def fitted(sample: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """At most k centroids by Lloyd's steps, from the sample's first rows on."""
    centroids = np.unique(sample[:k], axis=0)
    for _ in range(steps):
        near = _nearest(sample, centroids)
        order = np.argsort(near, kind="stable")
        sizes = np.bincount(near, minlength=len(centroids))
        some = np.flatnonzero(sizes)
        sums = np.add.reduceat(sample[order], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), axis=0)
        centroids[some] = sums / sizes[some, None]
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Any choice is right; products and squares of huge components may overflow."""
    with np.errstate(all="ignore"):
        return np.nan_to_num(x @ centroids.T - 0.5 * np.square(centroids).sum(axis=1), nan=0.0).argmax(axis=1)


def _placed(centroids: dict[int, np.ndarray]):
    """Rows with their cluster, the distance from its centroid, and a number that deals out a cluster's rows evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = TaskContext.get().partitionId() * 7919
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            vecs = batch.column(4).to_pylist()
            cluster, far = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x, c = _matrix(b"".join(vecs[i] for i in at), dim), centroids.get(dim, np.zeros((1, dim)))
                cluster[at] = near = _nearest(x, c)
                far[at] = _norms(x - c[near])
            columns = [*batch.columns, pa.array(cluster, pa.int32()), pa.array(far), pa.array(np.arange(spread, spread + len(dims)))]
            spread += len(dims)
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "id", "label", "anchor", "vec", "cluster", "far", "spread"])

    return run


def _packed(size: int):
    """Sorted rows (dim, cluster, spread, id, label, vec, far) to lists of at most `size` rows of one cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def out() -> pa.RecordBatch:
            ids, labels, vecs, far = zip(*held)
            held.clear()
            return _batch([[key[0]], [key[1]], [len(ids)], [max(far)], [np.array(ids, np.int64).tobytes()], [np.array(labels, np.int64).tobytes()], [b"".join(vecs)]], _LISTS)

        for batch in batches:
            for dim, cluster, _, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((dim, cluster) != key or len(held) >= size):
                    yield out()
                key = (dim, cluster)
                held.append(tuple(row))
        if held:
            yield out()

    return run


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """Of rows (anchor, window, score, id) the first k of each anchor and window: by score, then smaller id."""
    found = found[np.lexsort((found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    start = np.flatnonzero(new)
    return found[np.arange(len(found)) - np.repeat(start, np.diff(np.append(start, len(found)))) < k]


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held within -+MOST."""
    with np.errstate(over="ignore"):
        most = _norms(a).max() * _norms(x).max()  # bounds every partial sum
    if most < 1 << 23:
        return (a.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 1 << 52:
        return (a @ x.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in m] for m in (a.tolist(), x.tolist())]
    return np.array([[max(-MOST, min(MOST, sum(p * q for p, q in zip(r, s)))) for s in whole[1]] for r in whole[0]], np.int64).reshape(len(a), len(x))


def _bounds(a: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors with the rows of each cluster."""
    with np.errstate(all="ignore"):
        size, about = _norms(a)[:, None], a @ centroids.T
        reach = size * radii
        slack = 1e-9 * (size * (_norms(centroids) + radii)) + 1e-6  # of rounding
        low, high = about - reach - slack, about + reach + slack
    # Scores are held within -+MOST, and so are their bounds.
    return np.minimum(np.nan_to_num(low, nan=-np.inf, neginf=-np.inf, posinf=MOST), MOST), np.maximum(np.nan_to_num(high, nan=np.inf, neginf=-MOST, posinf=np.inf), -MOST)


class Search:
    """One search of all anchors: for positives, or in the windows that their scores set."""

    def __init__(self, positives: int, negatives: int, low: int, high: int, windows: bool):
        self.positives, self.low, self.high, self.windows = positives, low, high, windows
        self.k = negatives if windows else positives
        self.n = positives if windows else 1

    def floors(self, top: np.ndarray, pos: np.ndarray, anchors: int) -> tuple[np.ndarray, np.ndarray]:
        """The least score that still counts in each anchor's windows, and the largest; least > largest: nothing does."""
        least, most = np.full((anchors, self.n), NONE), np.full((anchors, self.n), -NONE)
        if self.windows:
            most[:] = NONE
            least[:] = -NONE
            for anchor, j, score, _ in pos.tolist():
                if self.low * score <= self.high * score:
                    least[anchor, j], most[anchor, j] = -(-self.low * score // 100), self.high * score // 100
        # Ties with the kth score count, as a smaller id may come.
        full = _kth(top, self.k)
        least[full[:, 0], full[:, 1]] = np.maximum(least[full[:, 0], full[:, 1]], full[:, 2])
        return least, most

    def found(self, ids, labels, a, floors, mosts, other_ids, other_labels, x) -> np.ndarray:
        score = scores(a, x)
        apart = labels[:, None] != other_labels
        fits = apart if self.windows else ~apart
        fits &= ids[:, None] != other_ids
        out = []
        for j in range(self.n):
            at, row = np.nonzero(fits & (score >= floors[:, j, None]) & (score <= mosts[:, j, None]))
            out.append(_best(np.stack([at, np.full(len(at), j), score[at, row], other_ids[row]], axis=1), self.k))
        return np.concatenate(out)


def _kth(top: np.ndarray, k: int) -> np.ndarray:
    """Of sorted rows (anchor, window, score, id) the kth of each anchor and window that has k."""
    if len(top) < k:
        return top[:0]
    same = np.zeros(len(top), bool)
    same[k - 1 :] = (top[k - 1 :, :2] == top[: len(top) - k + 1, :2]).all(axis=1)
    return top[same]


def _table(held: bytes | None) -> np.ndarray:
    return np.frombuffer(held or b"", np.int64).reshape(-1, 4)


def _visits(search: Search, centroids: dict[int, np.ndarray], radii: dict[int, np.ndarray], seen: int, width: int):
    """Blocks to their visits of this round: each anchor's next `width` clusters by upper bound, of those that it still needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, ids, labels, vecs, top, pos in zip(*(c.to_pylist() for c in batch.columns)):
                a = _matrix(vecs, dim)
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                low, high = _bounds(a, centroids.get(dim, np.zeros((1, dim))), radii[dim])
                least, most = search.floors(_table(top), _table(pos), len(a))
                turn = np.argsort(np.argsort(-high, axis=1, kind="stable"), axis=1, kind="stable")
                inside = (high[:, :, None] >= least[:, None, :]) & (low[:, :, None] <= most[:, None, :]) & (least <= most)[:, None, :]
                need = inside.any(axis=2) & (turn >= seen) & (turn < seen + width)
                for cluster in np.flatnonzero(need.any(axis=0)).tolist():
                    who = np.flatnonzero(need[:, cluster])
                    held = (ids[who], labels[who], a[who], least[who])
                    yield _batch([[x] for x in (dim, cluster, block, who.tobytes(), *(h.tobytes() for h in held), most[who].tobytes())], _VISITS)

    return run


def _scored(search: Search):
    """A visit and a list to the rows (anchor, window, score, id) found there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, who, ids, labels, vecs, floors, mosts, *other in zip(*(c.to_pylist() for c in batch.columns)):
                who, ids, labels = (np.frombuffer(x, np.int64) for x in (who, ids, labels))
                floors, mosts = (np.frombuffer(x, np.int64).reshape(len(who), -1) for x in (floors, mosts))
                found = search.found(ids, labels, _matrix(vecs, dim), floors, mosts, np.frombuffer(other[0], np.int64), np.frombuffer(other[1], np.int64), _matrix(other[2], dim))
                if len(found):
                    found[:, 0] = who[found[:, 0]]
                    yield _batch([[dim], [block], [found.tobytes()]], "dim int, block long, found binary")

    return run


def _merged(k: int):
    """Sorted rows of a block, its state first, to its state with the best of what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, n = None, [], 0

        def out() -> pa.RecordBatch:
            state[5] = _best(np.concatenate(held), k).tobytes()
            return _batch([[x] for x in state], _STATE)

        for batch in batches:
            for *row, found in zip(*(c.to_pylist() for c in batch.columns)):
                if found is None:
                    if state is not None:
                        yield out()
                    state, held, n = row, [_table(row[5])], 0
                else:
                    held.append(_table(found))
                    n += len(held[-1])
                    if n > _KEEP:
                        held = [_best(np.concatenate(held), k)]
                        n = 0
        if state is not None:
            yield out()

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of the search for positives to those of the search in their windows."""
    for batch in batches:
        for *row, top, _ in zip(*(c.to_pylist() for c in batch.columns)):
            pos = _table(top).copy()
            new = np.flatnonzero(np.diff(pos[:, 0], prepend=-1))
            pos[:, 1] = np.arange(len(pos)) - np.repeat(new, np.diff(np.append(new, len(pos))))
            yield _batch([[x] for x in (*row, b"", pos.tobytes())], _STATE)


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, top, pos in zip(*(c.to_pylist() for c in batch.columns)):
            ids, top, pos = np.frombuffer(ids, np.int64), _table(top), _table(pos)
            of = {(a, j): (score, id_) for a, j, score, id_ in pos.tolist()}
            rank, last, out = 0, None, [[] for _ in range(6)]
            for a, j, score, id_ in top.tolist():
                rank = rank + 1 if (a, j) == last else 1
                last = (a, j)
                for column, value in zip(out, (int(ids[a]), of[a, j][1], rank, id_, of[a, j][0], score)):
                    column.append(value)
            yield _batch(out, _OUT)


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` says which rows are anchors. Components become floor(scale * x). An anchor's
    positives are the first `positives` rows of its label, by score and then by smaller id;
    for each of them the first `negatives` rows of other labels are given that satisfy
    low * positive_score <= 100 * negative_score <= high * positive_score, ranked from 1; if
    there are none, no row. Rows with a null id, label or vector, or with a null or
    non-finite component, and empty vectors take no part, and vectors of different lengths
    aren't compared. Rows that repeat an id are rows of their own, but never each other's
    positives or negatives. Scores beyond 2**56 count as 2**56. Other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    given = vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), anchors.alias("anchor"), F.col(vector_col))
    rows = scratch.save(given.mapInArrow(_scaled(scale), _ROWS))
    # The most frequent lengths are clustered, rows of any other length are one cluster.
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()}
    centroids = {dim: _sampled(rows, dim, n) for dim, n in sizes.items()}
    placed = scratch.save(rows.mapInArrow(_placed(centroids), f"{_ROWS}, cluster int, far double, spread long"))
    placed_in = placed.groupBy("dim", "cluster")
    lists, blocks = (scratch.save(_dealt(chosen, size)) for chosen, size in ((placed, LIST_ROWS), (placed.where("anchor"), BLOCK_ROWS)))
    radii: dict[int, np.ndarray] = {dim: np.zeros(len(c)) for dim, c in centroids.items()}
    for r in placed_in.agg(F.max("far").alias("far")).collect():  # at most MOST_CLUSTERS for each of LENGTHS, and one for any other length
        radii.setdefault(r.dim, np.zeros(1))[r.cluster] = r.far

    state = scratch.save(blocks.select("dim", F.monotonically_increasing_id().alias("block"), "ids", "labels", "vecs", F.lit(b"").alias("top"), F.lit(b"").alias("pos")))
    other = lists.select("dim", "cluster", F.col("ids").alias("other_ids"), F.col("labels").alias("other_labels"), F.col("vecs").alias("other_vecs"))
    clusters = max(map(len, radii.values()), default=0)
    for windows in (False, True):
        search = Search(positives, negatives, low, high, windows)
        if windows:
            state = scratch.save(state.mapInArrow(_windows, _STATE))
        seen, width = 0, FIRST_VISITS
        while seen < clusters:
            visits = scratch.save(state.mapInArrow(_visits(search, centroids, radii, seen, width), _VISITS))
            if not visits.isEmpty():
                met = visits.join(other, ["dim", "cluster"]).select("dim", "block", "who", "ids", "labels", "vecs", "floors", "mosts", "other_ids", "other_labels", "other_vecs")
                found = met.mapInArrow(_scored(search), "dim int, block long, found binary")
                both = state.withColumn("found", F.lit(None).cast("binary")).unionByName(found, allowMissingColumns=True)
                now = scratch.save(both.repartition("block").sortWithinPartitions("block", F.col("found").isNotNull()).mapInArrow(_merged(search.k), _STATE))
                scratch.drop(state)
                state = now
            scratch.drop(visits)
            seen, width = seen + width, MORE_VISITS * width
    return state.select("ids", "top", "pos").mapInArrow(_results, _OUT)


def _sampled(rows: DataFrame, dim: int, n: int) -> np.ndarray:
    """Centroids for the n rows of one length, fitted on at most SAMPLE_ROWS of them, and SAMPLE_BYTES."""
    k = max(1, min(MOST_CLUSTERS, CENTROID_BYTES // (8 * dim), -(-n // LIST_ROWS)))
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id", "vec")).limit(size).select("vec").collect()
    with np.errstate(all="ignore"):
        return np.nan_to_num(fitted(_matrix(b"".join(bytes(r.vec) for r in sample), dim), k), nan=0.0, posinf=1e300, neginf=-1e300)


def _dealt(placed: DataFrame, size: int) -> DataFrame:
    """Lists of about `size` rows: a cluster that has more is dealt out to several."""
    parts = placed.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / size).alias("parts"))  # no larger than the centroids
    dealt = placed.join(F.broadcast(parts), ["dim", "cluster"]).withColumn("part", F.pmod("spread", "parts"))
    dealt = dealt.repartition("dim", "cluster", "part").sortWithinPartitions("dim", "cluster", "part", "far")
    return dealt.select("dim", "cluster", "part", "id", "label", "vec", "far").mapInArrow(_packed(size), _LISTS)


def op11_ivf_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH used AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM used a JOIN used b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

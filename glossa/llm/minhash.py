"""MinHash near-duplicates with sequential Bayesian verification.

1. Documents with equal shingle sets are one node, named by a 64-bit hash of the set:
   two different sets of n fall together with probability n**2 / 2**65.
2. Signatures of BANDS * ROWS min-hashes, of which bytes are kept; nodes that agree in
   all rows of a band are candidates. At similarity 0.75 a pair is missed with
   probability (1 - 0.75**ROWS)**BANDS, about 5e-6.
3. Each bucket first compares its members with its hubs only (stars), never all pairs.
   Buckets whose members are then in one component are done. In the others, members of
   different components are compared: in buckets of up to SMALL in place, else those that
   share one of their rarest shingles early enough for the similarity (prefix
   and position filters, both exact).
4. A candidate pair is compared batch by batch of its signatures and dropped as soon
   as the posterior probability of a similarity at the threshold falls under MISS.
5. Survivors are verified exactly on their full shingle sets.
6. Components of the links by distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.buckets import joined_in_buckets, members
from glossa.llm.shared import Scratch, components, few, merged_components
from glossa.llm.words import MULTIPLIER, WordHashes, mix, shingle_set

WIDTH = 5
BANDS, ROWS = 32, 4
BATCH = 32
MISS = 1e-6
SEED = 20240501
SMALL = 2048
SEEN_SETS = 300_000
SIZE_STEP = 1.05


def least_matches(threshold: float, n_hashes: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(n, m): a pair with fewer than m agreements in its first n signature bytes is dropped.

    Bytes of different min-hashes agree by chance once in 256 times, so a similarity s
    shows as a rate of s + (1 - s) / 256. With a uniform prior on the rate and m
    agreements of n, the posterior is Beta(m + 1, n - m + 1), and P(rate >= t) =
    P(Binomial(n + 1, t) <= m). m is the least count for which that is at least `miss`.
    """
    t, found = threshold + (1 - threshold) / 256, []
    for n in range(batch, n_hashes + 1, batch):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        found.append((n, m))
    return found


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sketches(width: int, bands: int, rows: int):
    """(id, text) to (id, n_shingles, node, sig, bands): node is null without shingles, sig and bands are too where the task has given them lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        k = bands * rows
        odd = (rng.integers(0, 2**31, (k, 1), np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
        flip = rng.integers(0, 2**32, (k, 1), np.uint32)
        memo, seen = WordHashes(), set()
        for batch in batches:
            sizes, nodes, full, at = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), width, memo)
                sizes.append(len(shingles))
                nodes.append(node_of(shingles) if len(shingles) else None)
                if not len(shingles) or nodes[-1] in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(nodes[-1])
                x = (shingles >> np.uint64(32)).astype(np.uint32)
                sig = np.full(k, 0xFFFFFFFF, np.uint32)
                for i in range(0, len(x), 8192):  # bounded memory for very long texts
                    np.minimum(sig, ((x[None, i : i + 8192] ^ flip) * odd).min(axis=1), out=sig)
                at.append(len(sizes) - 1)
                full.append(sig)
            sigs: list = [None] * len(sizes)
            keys: list = [None] * len(sizes)
            if full:
                every = np.array(full)
                wide = every.reshape(-1, bands, rows).astype(np.uint64)
                found = np.zeros(wide.shape[:2], np.uint64)
                for r in range(rows):
                    found = mix(found * MULTIPLIER + wide[:, :, r])
                low = (every >> np.uint32(11)).astype(np.uint8)  # of the least values the upper bits are alike
                for i, sig, key in zip(at, low, found):
                    sigs[i], keys[i] = sig.tobytes(), key.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.binary())],
                names=["id", "n_shingles", "node", "sig", "bands"],
            )

    return run


def passing(threshold: float, n_hashes: int, batch_size: int = BATCH):
    """Arrow batches of (a, b, sig_a, sig_b) to the (a, b) that no batch of hashes rules out."""
    bounds = least_matches(threshold, n_hashes, batch_size, MISS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            alive = np.arange(batch.num_rows)
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, n_hashes) for i in (2, 3))
            agreed, done = np.zeros(batch.num_rows, np.int64), 0
            for n, least in bounds:
                agreed[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
                alive, done = alive[agreed[alive] >= least], n
            kept = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])

    return run


def _sets(width: int):
    """(text) to (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, memo) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _named(width: int):
    """(text) to (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([node_of(shingle_set(t.as_py(), width, memo)) for t in batch.column(0)], pa.int64()), batch.column(0).cast(pa.string())], names=["node", "text"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: Fraction = Fraction(3, 4),
    width: int = WIDTH,
    scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Two documents are linked if 100 * |A & B| >= 100 * threshold * |A | B| on their sets
    of `width`-word shingles; component_id is the smallest id reachable by links. Null
    texts and texts without words have an empty set and are linked with nothing. A row
    with a null id is linked with nothing: component_id null, kept. Rows that repeat an
    id count as one document that has the links of each of them. Columns other than the
    two named are ignored, whatever their names. An empty table gives no rows. scratch:
    where intermediate tables go, if the caller closes it when the result has been read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = scratch.save(texts.mapInArrow(_sketches(width, BANDS, ROWS), "id long, n_shingles long, node long, sig binary, bands binary"))
    rows = scratch.save(sketched.select("id", "n_shingles", "node"))
    named = rows.where("node is not null and id is not null")
    reps = scratch.save(named.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    found_in = members(sketched.where("bands is not null and id is not null").select("node", "bands"), BANDS, scratch)

    def read_of(nodes: DataFrame, run, schema: str, column: str) -> DataFrame:
        """node and what run makes of its text: once for each of some distinct nodes."""
        nodes = scratch.save(nodes)
        first = scratch.save(reps.join(few(nodes), "node", "left_semi").select(F.col("least").alias("id")).distinct())
        read = texts.join(few(first), "id", "left_semi").select("text").mapInArrow(run, schema)
        read = scratch.save(read.join(few(nodes), "node", "left_semi").groupBy("node").agg(F.min(column).alias(column)))
        scratch.drop(nodes, first)
        return read

    def sets_of(nodes: DataFrame) -> DataFrame:
        return read_of(nodes, _sets(width), "node long, shingles array<long>", "shingles")

    def texts_of(nodes: DataFrame) -> DataFrame:
        return read_of(nodes, _named(width), "node long, text string", "text")

    def sigs_of(nodes: DataFrame, *more: str) -> DataFrame:
        """node, sig and more columns: once for each of some distinct nodes."""
        columns = ("sig", *more)
        return sketched.where("sig is not null").select("node", *columns).join(few(scratch.save(nodes)), "node", "left_semi").groupBy("node").agg(*(F.min(c).alias(c) for c in columns))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold: pruned by signatures first."""
        sigs = sigs_of(_ends(pairs))
        both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        likely = scratch.save(both.select("a", "b", "sig_a", "sig_b").mapInArrow(passing(float(threshold), BANDS * ROWS), "a long, b long"))
        sets = sets_of(_ends(likely))
        num, den = threshold.numerator, threshold.denominator
        both = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        both = both.withColumn("both", F.size(F.array_intersect("x", "y")).cast("long"))
        kept = scratch.save(both.where(F.lit(den) * F.col("both") >= F.lit(num) * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"))
        scratch.drop(likely, sets)
        return kept

    # A node is compared with the hubs that it shares most keys with.
    best = scratch.save(nearest(found_in.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("keys"))))
    # Nodes that share an id are one document.
    several = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    by_id = named.join(several, "id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    joined = scratch.save(components(verified(best).unionByName(by_id), scratch))

    # What is left: documents in buckets with members of more than one component.
    placed = found_in.select("key", "node").distinct().join(joined.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("size")).where("c1 < c2").select("key", "size")
    left_over = scratch.save(placed.join(open_keys, "key"))
    scratch.drop(found_in)
    small = left_over.where(F.col("size") <= SMALL)
    nodes = scratch.save(small.select("node").distinct())
    bounds = least_matches(float(threshold), BANDS * ROWS, BATCH, MISS)
    inside = joined_in_buckets(small.join(sigs_of(nodes, "bands"), "node").join(texts_of(nodes), "node"), lambda: partial(shingle_set, width=width, memo=WordHashes()), threshold, BANDS, BANDS * ROWS, bounds, scratch)
    many = scratch.save(left_over.where(F.col("size") > SMALL).select("node", "comp").distinct())
    across = inside.where("not sure").select("a", "b")
    if not many.isEmpty():
        sets = sets_of(many.select("node")).join(many, "node").select(F.col("node").alias("id"), "comp", "shingles")
        across = across.unionByName(pairs_across(sets, threshold, scratch))
    more = inside.where("sure").select("a", "b")
    if not across.isEmpty():  # a pair goes from its smaller node, as a star's does
        more = more.unionByName(verified(scratch.save(across.distinct().join(best, ["a", "b"], "left_anti"))))
    whole = joined if more.isEmpty() else merged_components(joined, more, scratch)

    # The smallest id of each component; a node without links is a component of its own.
    ids = scratch.save(reps.join(whole.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").where("n > 1 or component is not null").select("node", "least", F.coalesce("component", "node").alias("comp")))
    least = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_node = ids.join(scratch.save(least), "comp").select("node", "component_id")
    linked = F.col("id").isNotNull()
    return (
        rows.join(by_node, "node", "left")
        .select(F.col("id").alias("doc_id"), "n_shingles", F.when(linked, F.coalesce("component_id", "id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = Fraction(3, 4), width: int = WIDTH) -> DataFrame:
    """The columns of docs, one row of each component of near-duplicates: that of the smallest id (nulls last), then any one.

    Rows are numbered and written once, so that each is a document of its own, whether its
    id repeats or is null. Texts without words are linked with nothing and stay; columns
    may have any names.
    """
    scratch, searched = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    numbered = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("all")))
    rows = numbered.select("row", F.col("all").getField(text_col).alias("text"))
    groups = near_duplicates(rows, "row", "text", threshold, width, searched).select(F.col("doc_id").alias("row"), "component_id")
    several = scratch.save(groups.where("row <> component_id"))
    grouped = several.unionByName(several.select(F.col("component_id").alias("row"), "component_id").distinct())
    id_ = F.col("all").getField(id_col)
    placed = scratch.save(grouped.join(numbered.select("row", F.struct(id_.isNull(), id_, "row").alias("at")), "row"))
    first = placed.groupBy("component_id").agg(F.min("at").alias("first"))
    gone = scratch.save(placed.join(first, "component_id").where("at <> first").select(F.col("row").alias("gone")))
    scratch.drop(several, placed)
    searched.close()
    left = numbered.join(few(gone), F.col("row") == F.col("gone"), "left_anti")
    return left.select(*(F.col("all").getField(c).alias(c) for c in docs.columns))


def nearest(stars: DataFrame, most: int = 1) -> DataFrame:
    """Of the pairs (a, b, keys) those of each b with most keys in common, `most` at the most. A node has a few pairs for each of its keys."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("keys", "a")), asc=False), 1, most)
    return stars.groupBy("b").agg(best.alias("best")).select(F.explode("best").alias("x"), "b").select("x.a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def pairs_across(sets: DataFrame, threshold: Fraction, scratch: Scratch, unique: bool = False) -> DataFrame:
    """Pairs a < b of sets (id, comp, shingles) in different components that may reach the threshold; exact by prefixes.

    With all sets in one order of shingles, two sets that reach the threshold t share one
    of the first n - ceil(t n) + 1 shingles of each. The order is by document frequency:
    what single copies have for themselves comes first, what a hot passage or a large
    group shares comes last, and so pairs that are alike but not enough rarely meet.
    Shingles in one component only can't join two and merely count as earlier places.
    unique: no id comes twice, so that there are no equal rows to look for.
    """
    tokens = sets.select("id", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    tokens = scratch.save(tokens if unique else tokens.distinct())
    known = scratch.save(tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("df > 1"))
    ranked = tokens.join(known, "token").select("id", "comp", "n", "token", "df", "c1", "c2")
    in_order = Window.partitionBy("id").orderBy("df", "token")
    whole = Window.partitionBy("id")
    num, den = threshold.numerator, threshold.denominator
    length = F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1
    prefix = ranked.withColumn("place", F.row_number().over(in_order) + F.col("n") - F.count("*").over(whole)).where((F.col("place") <= length) & (F.col("c1") < F.col("c2")))
    prefix = scratch.save(prefix.select("token", "id", "comp", "n", "place", _size_class(F.col("n")).alias("size")))
    scratch.drop(tokens)
    # Two sets of n and m with the threshold t share at least t / (1 + t) (n + m) shingles. A set whose first shared
    # shingle comes too late for that with even the smallest set that has the shingle (and isn't too small) has no pair there.
    met = scratch.save(prefix.groupBy("token").agg(F.collect_set("size").alias("sizes")))  # a few hundred sizes at most; saved, so that the join may split a hot token
    t = num / den
    smallest = F.array_min(F.filter("sizes", lambda k: k >= _size_class(F.col("n") * t)))
    other_n = F.greatest(F.floor(F.pow(F.lit(SIZE_STEP), smallest) - 1e-6), F.ceil(F.col("n") * num / den))
    fits = prefix.join(met, "token").where(1 + F.col("n") - F.col("place") >= _overlap(F.col("n"), other_n, threshold)).select("token", "id", "comp", "n", "place")
    fits = scratch.save(fits)
    still = scratch.save(fits.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("token"))
    one = scratch.save(fits.join(still, "token", "left_semi"))
    scratch.drop(prefix, fits, known, met, still)
    other = one.select("token", F.col("id").alias("id2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    room = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    alike = (F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2")) & (room >= _overlap(F.col("n"), F.col("n2"), threshold))
    alike &= F.least("n", "n2") * den >= F.greatest("n", "n2") * num
    return one.join(other, "token").where(alike).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def _size_class(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n.cast("double"), F.lit(1.0))) / float(np.log(SIZE_STEP)) + 1e-9)


def _overlap(n: Column, m: Column, threshold: Fraction) -> Column:
    """Least number of shared shingles of sets of n and m that reach the threshold."""
    return F.ceil((n + m) * threshold.numerator / (threshold.numerator + threshold.denominator) - 1e-6)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

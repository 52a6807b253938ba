"""Line dedup: near-equal lines by MinHash over character shingles.

1. Every line that isn't blank is a node, named by a 64-bit hash of its plain form: two
   different lines of n fall together with probability n**2 / 2**65. A node gets a sketch
   of BANDS * ROWS places, filled by rounds of hashing (each place is a min-hash of the
   line's shingles); nodes that agree in all ROWS of a band are candidates.
2. A bucket compares its members with its hubs only. Buckets that then hold more than one
   component compare members of different components: all of them up to SMALL members, in
   larger buckets those that share a rare shingle (prefix filter).
3. Candidates whose sketches differ too much for the threshold (posterior probability
   under MISS) are pruned, and the rest verified by the exact Jaccard similarity of their
   shingle sets.
4. Components by distributed union-find; the first line of each is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.buckets import Sets, joined_in_buckets, members, reaches
from glossa.llm.minhash import least_matches, nearest, pairs_across
from glossa.llm.shared import Scratch, components, few, merged_components
from glossa.llm.words import mix

WIDTH = 9
BANDS, ROWS = 16, 4
THRESHOLD = Fraction(4, 5)
MISS = 1e-4
SMALL = 4096
SEEN_LINES = 300_000
CHUNK_CHARS = 60_000
CUT_BYTES, ROW_BYTES = 16 << 20, 48  # of line numbers to broadcast, and of each row of them
BASES = {4: 0x9E3779B1, 8: 0x9E3779B97F4A7C15}
MIX = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_EMPTY = np.uint32(0xFFFFFFFF)


def plain(line: str) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return " ".join(line.lower().split())


def windows(code: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash, in the type of code, of every `width` codes in a row, from those of half as many."""
    if width == 1:
        return code.copy()
    kind, base = code.dtype.type, BASES[code.dtype.itemsize]
    half = windows(code, width // 2)
    n, step = len(code) - 2 * (width // 2) + 1, width // 2
    total = half[:n] * kind(pow(base, step, 1 << 8 * code.dtype.itemsize))
    total += half[step : step + n]
    if width % 2:
        total = total[: len(code) - width + 1]
        total *= kind(base)
        total += code[width - 1 :]
    return total


def line_set(line: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a line."""
    code = np.frombuffer(line.ljust(width, "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = np.sort(mix(windows(code, width)))
    return found[np.append(True, found[1:] != found[:-1])]


def shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all character shingles of all lines, one line after the other, and each line's count.

    A line shorter than `width` is one shingle.
    """
    lines = [x if len(x) >= width else x + "\0" * (width - len(x)) for x in lines]
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    total = windows(code, width)
    total ^= total >> np.uint32(16)
    for factor, shift in zip(MIX, (13, 16)):
        total *= factor
        total ^= total >> np.uint32(shift)
    inside = np.ones(len(code), bool)  # windows that don't reach into the next line
    ends = np.cumsum(size)
    for k in range(1, width):
        inside[ends - k] = False
    return total[inside[: len(total)]], size - width + 1


def sketches(hashes: np.ndarray, n: np.ndarray, places: int) -> np.ndarray:
    """For each line `places` min-hashes. Round i spreads the shingles over all places and
    fills those still empty; after `places` rounds, a round for each place fills the rest."""
    found = np.full((len(n), places), _EMPTY, np.uint32)
    lines, counts = np.arange(len(n)), n
    for i in range(2 * places):
        value = hashes * np.uint32((2 * i * 0x632BE5AB + 0xD192ED03) & 0xFFFFFFFF)
        value ^= value >> np.uint32(15)
        value *= MIX[1]
        # A place takes a range of values, in which the least is as random as the rest.
        at = np.repeat(np.arange(len(lines)) * places, counts)
        at += (value >> np.uint32(16)) * np.uint32(places) >> np.uint32(16) if i < places else i - places
        least = np.full(len(lines) * places, _EMPTY, np.uint32)
        np.minimum.at(least, at, value)
        now = found[lines]
        now = np.where(now == _EMPTY, least.reshape(-1, places), now)
        found[lines] = now
        open_ = (now == _EMPTY).any(axis=1)
        if not open_.any():
            break
        if not open_.all():
            hashes = hashes[np.repeat(open_, counts)]
            lines, counts = lines[open_], counts[open_]
    return found


_LINES = "row long, doc_id long, line int, node long, text string, sketch binary"


def _sketched(width: int, bands: int, rows: int):
    """(row, doc_id, text) to _LINES: a row for each line that isn't blank; text and sketch are null where the task has given them lately.

    Of a min-hash 16 bits are kept, so that the ROWS of a band are one 64-bit value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        of, docs, numbers, nodes, texts, fresh = [], [], [], [], [], []

        def out() -> pa.RecordBatch:
            sizes = np.zeros(len(of) + 1, np.int32)
            data = b""
            if fresh:
                data = sketches(*shingles([texts[k] for k in fresh], width), bands * rows).astype(np.uint16).tobytes()
                sizes[np.array(fresh) + 1] = 2 * bands * rows
            valid = np.packbits(sizes[1:] > 0, bitorder="little").tobytes()
            sketch = pa.Array.from_buffers(pa.binary(), len(of), [pa.py_buffer(valid), pa.py_buffer(np.cumsum(sizes, dtype=np.int32)), pa.py_buffer(data)])
            types = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()
            columns = [pa.array(c, t) for c, t in zip((of, docs, numbers, nodes, texts), types)]
            batch = pa.RecordBatch.from_arrays([*columns, sketch], names=[f.split()[0] for f in _LINES.split(", ")])
            for column in (of, docs, numbers, nodes, texts, fresh):
                column.clear()
            return batch

        held = 0
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for number, line in enumerate((text.as_py() or "").split("\n")):
                    line = plain(line)
                    if not line:
                        continue
                    node = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)
                    of.append(row), docs.append(doc_id), numbers.append(number), nodes.append(node)
                    if node in seen:
                        texts.append(None)
                    else:
                        if len(seen) >= SEEN_LINES:
                            seen.clear()
                        seen.add(node)
                        fresh.append(len(texts)), texts.append(line)
                        held += len(line)
                    held += 8
                if held > CHUNK_CHARS:
                    yield out()
                    held = 0
        yield out()

    return run


def _alike(threshold: Fraction, width: int, least: int):
    """(a, b, sketch_a, sketch_b, text_a, text_b) to the (a, b) whose sketches allow it and whose lines reach the threshold on their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(partial(line_set, width=width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            likely = np.flatnonzero((x == y).sum(axis=1) >= least).tolist()
            kept = [k for k in likely if reaches(sets[batch.column(4)[k].as_py()], sets[batch.column(5)[k].as_py()], threshold)]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(kept, pa.int64())) for i in (0, 1)], names=["a", "b"])

    return run


def _line_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [line_set(x.as_py(), width).view(np.int64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["id", "comp", "shingles"])

    return run


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """row, doc_id, line_no, first_doc_id, first_line_no, kept: one row per line that isn't blank.

    Lines end at newlines and count from 0. Two lines are linked if they are equal in
    lower case with white space runs as one space, or if the Jaccard similarity of their
    sets of `width`-character shingles reaches the threshold; a shorter line is one
    shingle. The kept line of a component is its first by doc_id (nulls first), then row,
    then line. row numbers the input's rows, so that repeated and null ids are documents
    of their own. Null and empty texts have no lines; extra columns are ignored; no rows
    give no lines. A pair at the threshold is missed with probability
    (1 - threshold**ROWS)**BANDS, 2e-4, or MISS; the more alike, the less.
    """
    return _grouped(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), threshold, width, Scratch(docs.sparkSession))


def _grouped(numbered: DataFrame, threshold: Fraction, width: int, scratch: Scratch) -> DataFrame:
    """line_groups() of (row, doc_id, text). The table is read once, so its row numbers needn't be the same at every reading."""
    whole = scratch.save(numbered.select("row", "doc_id", "text").mapInArrow(_sketched(width, BANDS, ROWS), _LINES))
    lines = scratch.save(whole.select("row", "doc_id", "line", "node"))
    found_in = members(whole.where("sketch is not null").select("node", F.col("sketch").alias("bands")), BANDS, scratch)
    # Of all nodes that have to be compared, once each.
    met = scratch.save(found_in.select("node").distinct())
    kept = whole.where("text is not null").select("node", "text", "sketch").join(few(met), "node", "left_semi")
    texts = scratch.save(kept.groupBy("node").agg(F.min("text").alias("text"), F.min("sketch").alias("sketch")))
    scratch.drop(whole, met)
    bounds = least_matches(float(threshold), BANDS * ROWS, BANDS * ROWS, MISS)
    least = bounds[-1][1]

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("node").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "sketch_a", "sketch_b", "text_a", "text_b")
        return scratch.save(both.mapInArrow(_alike(threshold, width, least), "a long, b long"))

    # A node is compared with the hubs that it shares most keys with.
    best = scratch.save(nearest(found_in.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("keys"))))
    joined = scratch.save(components(verified(best), scratch))

    placed = found_in.select("key", "node").distinct().join(joined.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("size")).where("c1 < c2").select("key", "size")
    left_over = scratch.save(placed.join(open_keys, "key"))
    scratch.drop(found_in)
    small = left_over.where(F.col("size") <= SMALL).join(texts.withColumnRenamed("sketch", "sig"), "node").withColumn("bands", F.lit(None).cast("binary"))
    inside = joined_in_buckets(small, lambda: partial(line_set, width=width), threshold, BANDS, BANDS * ROWS, bounds, scratch)
    many = left_over.where(F.col("size") > SMALL).select("node", "comp").distinct()
    sets = texts.join(many, "node").select(F.col("node").alias("id"), "comp", "text").mapInArrow(_line_sets(width), "id long, comp long, shingles array<long>")
    across = inside.where("not sure").select("a", "b")
    if not many.isEmpty():
        across = across.unionByName(pairs_across(sets, threshold, scratch, unique=True))
    more = inside.where("sure").select("a", "b")
    if not across.isEmpty():
        more = more.unionByName(verified(across.distinct().join(best, ["a", "b"], "left_anti")))
    if not more.isEmpty():
        joined = merged_components(joined, more, scratch)

    # The first line of each component. A node without links and repeats is its own and takes no further part.
    at = F.struct("doc_id", "row", "line")
    nodes = lines.groupBy("node").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    nodes = scratch.save(nodes.join(joined.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").where("n > 1 or component is not null").select("node", "at", F.coalesce("component", "node").alias("comp")))
    least = scratch.save(nodes.groupBy("comp").agg(F.min("at").alias("first")))
    first = scratch.save(nodes.join(least, "comp").select("node", "first"))
    scratch.drop(texts, best, left_over, nodes, least)
    placed = lines.join(first, "node", "left").select("row", "doc_id", "line", F.coalesce("first", at).alias("first"))
    same = (F.col("row") == F.col("first.row")) & (F.col("line") == F.col("first.line"))
    return placed.select(
        "row", "doc_id", F.col("line").cast("long").alias("line_no"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").cast("long").alias("first_line_no"), same.alias("kept")
    )


def _without(text: pd.Series, cut: pd.Series) -> pd.Series:
    """Each text without the lines whose numbers are in cut; null texts stay."""

    def left(text: str | None, cut) -> str | None:
        if text is None:
            return None
        gone = set(cut)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series(map(left, text, cut), dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True, threshold: Fraction = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The columns of docs, texts without the lines that aren't kept. Blank lines stay.

    A document of which no line is left but blank ones, and which had others, goes as a
    whole unless drop_emptied is false. Null and blank texts stay as they are. Rows are
    numbered and written once, and matched by that number: ids may repeat or be null, and
    columns may have any names.
    """
    scratch, searched = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    # All columns in one, whose name can't clash with theirs.
    numbered = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("all")))
    groups = _grouped(numbered.select("row", F.col("all").getField(id_col).cast("long").alias("doc_id"), F.col("all").getField(text_col).alias("text")), threshold, width, searched)
    cut = groups.groupBy("row").agg(F.collect_list(F.when(~F.col("kept"), F.col("line_no").cast("int"))).alias("cut"), F.count("*").alias("n")).where(F.size("cut") > 0)
    cut = scratch.save(cut)
    searched.close()
    n, n_lines = cut.agg(F.count("*"), F.sum(F.size("cut").cast("long"))).first()
    made = numbered.join(F.broadcast(cut) if ROW_BYTES * n + 4 * (n_lines or 0) <= CUT_BYTES else cut, "row", "left")
    if drop_emptied:
        made = made.where(F.col("n").isNull() | (F.size("cut") < F.col("n")))
    text = F.col("all").getField(text_col)
    shorter = F.pandas_udf(_without, "string")(F.when(F.col("n").isNotNull(), text), F.col("cut"))  # only texts that change travel to Python
    return made.select(*[(F.coalesce(shorter, text) if c == text_col else F.col("all").getField(c)).alias(c) for c in docs.columns])


def op7_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    return line_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")

"""Token counts of documents in flat token files without an index.

The files come as blocks of token ids. Each block is searched at once for the id that
ends documents; what its first document began with in earlier blocks is found by a
prefix scan over the blocks' summaries, in two levels, so that a file with very many
blocks is scanned in groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.shared import Scratch, bounded_batches
from glossa.llm.tokens import VOCABULARY, Encoder

END_OF_TEXT = 50256
BLOCK_TOKENS = 1 << 14  # a reader of saved blocks holds 4096 of them at once
GROUP_BLOCKS = 1024
BLOCKS = "file string, block long, ids binary"


def token_blocks(docs: DataFrame, text_col: str = "text", end_id: int = END_OF_TEXT, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """file, block, ids: the documents of each partition as one flat file of 32-bit ids, each ended by end_id, which no text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, parts, held, block = Encoder(vocabulary, special=False), [], 0, 0
        file = f"part-{TaskContext.get().partitionId():08d}"

        def cut(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, held, block
            ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            stop = len(ids) if all_of_it else len(ids) // block_tokens * block_tokens
            for lo in range(0, stop, block_tokens):
                data = ids[lo : min(stop, lo + block_tokens)].astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "ids"])
                block += 1
            parts, held = [ids[stop:]], len(ids) - stop

        for batch in batches:
            for text in batch.column(0):
                ids = np.append(encoder.encode(text.as_py()), np.uint32(end_id))
                parts.append(ids)
                held += len(ids)
                if held >= block_tokens:
                    yield from cut(False)
        yield from cut(True)

    return docs.select(F.col(text_col)).mapInArrow(run, BLOCKS)


def _pieces(block_bytes: int, itemsize: int):
    """(file, start, size, piece), pieces without the byte 10 between them, to (file, start, size, nth, n, head, data): data of about block_bytes, n of them, the first of which are head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n, nth = None, [], 0, 0

        def out() -> pa.RecordBatch:
            nonlocal held, n, nth
            data = b"\n".join(held) + b"\n"
            row = (*key, nth, len(data), data[:itemsize], data)
            held, n, nth = [], 0, nth + 1
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["file", "start", "size", "nth", "n", "head", "data"])

        for batch in batches:
            for file, start, size, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start, size) != key:
                    if held:
                        yield out()
                    key, nth = (file, start, size), 0
                held.append(piece)
                n += len(piece) + 1
                if n >= block_bytes:
                    yield out()
        if held:
            yield out()

    return run


def read_token_files(spark: SparkSession, path: str, itemsize: int = 4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, ids: flat files, of any size, of little-endian ids in blocks of about block_tokens.

    Spark's text source reads the parts of a file in parallel, with the byte 10 as its
    line end: it keeps all other bytes as they are. Parts begin and end anywhere in an
    id, so a scan over the blocks' sizes finds each block's place in its file, and ids
    over a border are stitched. Bytes after a file's last whole id don't count; empty
    files, and such of a UTF-8 mark alone, have no blocks.
    """
    bounded_batches(spark)
    place = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "start"), ("file_size", "size"))]
    pieces = spark.read.option("lineSep", "\n").text(path).select(*place, F.col("value").cast("binary").alias("piece"))
    raw = Scratch(spark).save(pieces.mapInArrow(_pieces(itemsize * block_tokens, itemsize), "file string, start long, size long, nth int, n long, head binary, data binary"))
    file, none = Window.partitionBy("file"), F.lit(b"")
    order = file.orderBy("start", "nth")
    brief = raw.select("file", "start", "nth", "size", "n", "head")
    # The source takes a leading mark of UTF-8 away, and the last piece has a line end that may not be there.
    marked = F.when(F.sum("n").over(file) <= F.col("size") - 2, 3).otherwise(0)
    brief = brief.withColumns({
        "block": F.row_number().over(order).cast("long") - 1, "mark": marked, "before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "next": F.concat(*[F.coalesce(F.lead("head", k).over(order), none) for k in range(1, itemsize + 1)]),
    })
    first = F.col("block") == 0
    brief = brief.withColumn("at", F.when(first, 0).otherwise(F.col("before") + F.col("mark"))).withColumn("end", F.least(F.col("before") + F.col("mark") + F.col("n"), "size"))
    brief = brief.withColumns({"skip": F.pmod(-F.col("at"), F.lit(itemsize)).cast("int"), "need": F.pmod(-F.col("end"), F.lit(itemsize)).cast("int"), "own": (F.col("end") - F.col("at")).cast("int")})
    data = F.concat(F.when(first & (F.col("mark") > 0), F.lit(b"\xef\xbb\xbf")).otherwise(none), F.col("data"))
    own = F.substring(data, F.col("skip") + 1, F.greatest(F.col("own") - F.col("skip"), F.lit(0)))
    ids = F.when(F.col("own") <= F.col("skip"), none).otherwise(F.concat(own, F.substring("next", F.lit(1), F.col("need"))))
    keys = brief.select("file", "start", "nth", "block", "mark", "skip", "need", "own", "next")
    return raw.select("file", "start", "nth", "data").join(keys, ["file", "start", "nth"]).select("file", "block", ids.alias("ids"))


def _scan(end_id: int, itemsize: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for data in batch.column(2):
                raw = data.as_buffer() if data.is_valid else b""
                ids = np.frombuffer(raw, f"<u{itemsize}", len(raw) // itemsize)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    return run


def document_counts(blocks: DataFrame, end_id: int = END_OF_TEXT, itemsize: int = 4, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """file, ordinal, start, n_tokens, ended: one row per document, in order in its file.

    blocks: file, block (its number, in order but not necessarily without gaps), ids
    (binary, itemsize bytes an id, little-endian; bytes after the last whole id don't
    count). start is the document's first token in the file, n_tokens leaves its end_id
    out, ended is false for tokens after a file's last end_id. Null or empty ids are an
    empty block; a null file or block number is a value like any other, and comes first.
    Rows that repeat a file and block number are one block: that with the most tokens.
    Extra columns are ignored; no blocks, no documents.
    """
    scratch = Scratch(blocks.sparkSession)
    found = blocks.select(F.col("file").cast("string"), F.col("block").cast("long"), F.col("ids").cast("binary")).mapInArrow(_scan(end_id, itemsize), "file string, block long, n long, ends array<long>")
    found = found.groupBy("file", "block").agg(F.max(F.struct("n", "ends")).alias("x")).select("file", "block", "x.n", "x.ends", F.floor(F.coalesce("block", F.lit(0)) / group_blocks).alias("group"))
    found = scratch.save(found)
    brief = found.select("file", "group", "block", "n", F.size("ends").cast("long").alias("e"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    # Within a group of blocks, then over the groups of a file.
    before = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = brief.withColumns({"n0": F.coalesce(F.sum("n").over(before), F.lit(0)), "e0": F.coalesce(F.sum("e").over(before), F.lit(0))})
    inside = inside.withColumn("last_at", F.col("n0") + F.col("last"))
    inside = inside.withColumn("end0", F.max("last_at").over(before))
    groups = inside.groupBy("file", "group").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.max("last_at").alias("last_at"))
    earlier = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({"gn": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "ge": F.coalesce(F.sum("e").over(earlier), F.lit(0))})
    groups = groups.withColumn("gend", F.max(F.col("gn") + F.col("last_at")).over(earlier)).select("file", "group", "gn", "ge", "gend")
    same_block = F.col("f.file").eqNullSafe(F.col("i.file")) & F.col("f.block").eqNullSafe(F.col("i.block"))
    same_group = F.col("f.file").eqNullSafe(F.col("g.file")) & (F.col("f.group") == F.col("g.group"))
    placed = (
        found.alias("f").join(inside.select("file", "block", "n0", "e0", "end0").alias("i"), same_block).join(groups.alias("g"), same_group)
        .select("f.file", "f.ends", (F.col("gn") + F.col("n0")).alias("base"), (F.col("ge") + F.col("e0")).alias("ordinal"), F.coalesce(F.col("gn") + F.col("end0"), "gend", F.lit(-1)).alias("end"))
    )
    ends = F.transform("ends", lambda x: x + F.col("base"))
    docs = F.transform(
        "ends",
        lambda x, i: F.struct(
            (F.col("ordinal") + i).alias("ordinal"),
            (F.when(i == 0, F.col("end")).otherwise(F.get(F.col("ends"), i - 1)) + 1).alias("start"),
            x.alias("stop"),
        ),
    )
    ended = placed.withColumn("ends", ends).select("file", F.explode(docs).alias("d")).select("file", "d.ordinal", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = groups.alias("g").join(inside.groupBy("file", "group").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.max("last_at").alias("last_at")).alias("s"), F.col("g.file").eqNullSafe(F.col("s.file")) & (F.col("g.group") == F.col("s.group")))
    files = whole.groupBy("g.file").agg(F.max(F.col("gn") + F.col("n")).alias("n"), F.max(F.col("ge") + F.col("e")).alias("ordinal"), F.coalesce(F.max(F.col("gn") + F.col("last_at")), F.lit(-1)).alias("last"))
    tails = files.where("last + 1 < n").select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(tails)


def op9_separator_scan(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    # The blocks are searched as they come: a saved table of such wide rows would be read 4096 of them at a time.
    return document_counts(token_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet")))

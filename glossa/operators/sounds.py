"""The pairs of two vocabularies that sound alike, without scoring all pairs.

Words travel in blocks of one length. Blocks meet by the lengths that a pair of the
wanted similarity can have; a task bounds the scores of all pairs of two blocks at once,
a few array operations for each place, and scores exactly what the bound leaves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.alignment import tokenized
from glossa.operators.scoring import TABLE, Segments, raw_scores, shifts, upper_bounds
from glossa.sources.phonology import Phonology

BLOCK_WORDS = 1024
_BLOCK = "n int, words array<string>, tokens array<array<string>>"
_FOUND = "a string, b string, raw double, similarity double"


def _blocks(size: int):
    """(word, tokens) to _BLOCK: words of one number of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))

        def out(n: int) -> pa.RecordBatch:
            words, tokens = held.pop(n)
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([words], pa.list_(pa.string())), pa.array([tokens], pa.list_(pa.list_(pa.string())))], names=["n", "words", "tokens"])

        for batch in batches:
            for word, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(tokens)
                held[n][0].append(word)
                held[n][1].append(tokens)
                if len(held[n][0]) >= size:
                    yield out(n)
        for n in list(held):
            yield out(n)

    return run


def _alike(least: float, phonology: Phonology):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(phonology)
        for batch in batches:
            for words, tokens, other_words, others in zip(*(c.to_pylist() for c in batch.columns)):
                n, m = len(tokens[0]), len(others[0])
                x, y = (np.array([[segments[t] for t in word] for word in side], np.int64).reshape(len(side), -1) for side in (tokens, others))
                used = np.unique(np.concatenate([x.ravel(), y.ravel()]))
                longest = max(n, m)
                if longest and len(used) <= TABLE:
                    p, q = np.searchsorted(used, x), np.searchsorted(used, y)
                    table = segments.similarity(used[:, None], used[None, :])
                    bound = upper_bounds(p, q, table, least, phonology) if n <= m else upper_bounds(q, p, table, least, phonology)
                    if bound is None:
                        continue
                    i, j = np.nonzero((bound if n <= m else bound.T) >= (2 * least - 1) * longest - 1e-4)
                else:
                    i, j = (k.ravel() for k in np.indices((len(x), len(y))))
                raw = raw_scores([tokens[k] for k in i], [others[k] for k in j], phonology, segments)
                similarity = np.clip((raw + longest) / (2 * longest), 0.0, 1.0) if longest else np.ones(len(raw))
                if min(n, m) == 0 < longest:
                    similarity[:] = 0.0
                kept = np.flatnonzero(similarity >= least)
                columns = [pa.array([words[i[k]] for k in kept], pa.string()), pa.array([other_words[j[k]] for k in kept], pa.string()), pa.array(raw[kept]), pa.array(similarity[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "raw", "similarity"])

    return run


def similar_sounding(a: DataFrame, b: DataFrame, least: float, phonology: Phonology = Phonology(), block_words: int = BLOCK_WORDS) -> DataFrame:
    """a, b, raw, similarity: the pairs of distinct words (column word) whose alignment similarity is at least `least`.

    Exact: aligned_scores() of all pairs, filtered. Null words are empty transcriptions;
    two words without segments are alike, and one is like no other.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    spark = a.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    x, y = (tokenized(df, phonology).select("word", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(_blocks(block_words), _BLOCK) for df in (a, b))
    sizes = spark.createDataFrame([], "n int, m int")
    lengths = sorted({r.n for df in (x, y) for r in df.select("n").distinct().collect()})  # word lengths, some dozens
    fits = [(n, m) for n in lengths for m in lengths if shifts(min(n, m), max(n, m), least, phonology) is not None]
    sizes = F.broadcast(spark.createDataFrame(fits, sizes.schema))
    other = y.select(F.col("n").alias("m"), F.col("words").alias("other_words"), F.col("tokens").alias("others"))
    met = x.join(sizes, "n").join(other, "m").select("words", "tokens", "other_words", "others")
    # Blocks are few bytes and much work: they are dealt out anew.
    return met.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_alike(least, phonology), _FOUND)

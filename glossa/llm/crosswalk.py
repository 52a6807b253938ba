"""Alignment of two tokenizers' tokens over the bytes that both stand for, with corpus-wide link counts.

A label for each byte says which tokens end there: none, A's, B's or both. A regular
expression cuts the labels into spans up to each place where both end; how many labels
of A and of B a span has tells the tokens of its group. Each label also ends a stretch of
bytes that lies in one token of A and one of B: their link. A task labels many texts at
once and gives one row for them, with the distinct id pairs of all of them, so that
the corpus-wide counts travel once for each pair and task's row instead of once for each
link. The counts come back in the same way, and each row's documents look theirs up there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.shared import Scratch
from glossa.llm.tokens import Encoder

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
GROUP_BYTES = 3 << 20
GROUP_ROWS = 4000
A_ENDS, B_ENDS = 1, 2
SPAN = re.compile(rb"[^\x03]*\x03")
PAIR_BITS = 32

Tokens = tuple[np.ndarray, np.ndarray]  # ids and the byte places at which they end


class RankTokens:
    """Tokens of byte_bpe_50k: the vocabulary's ranks are the same as the tokenizers file's, special tokens are plain text."""

    def __init__(self, vocabulary: str = A_VOCABULARY):
        self.encoder = Encoder(vocabulary, special=False)
        self.bpe = self.encoder.bpe
        self.sizes = np.array([len(self.bpe.decode_single_token_bytes(i)) for i in range(self.bpe.n_vocab)], np.int64)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        for text in texts:
            ids = self.encoder.encode(" " + text)
            yield ids.astype(np.int64), self.bpe.decode_bytes(ids)


class PieceTokens:
    """Tokens of a sentencepiece model, which adds the leading space itself."""

    def __init__(self, vocabulary: str = B_VOCABULARY):
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        ids = range(self.model.vocab_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in zip(ids, pieces)]
        self.sizes = np.array([len(t) for t in self.bytes], np.int64)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        for text in texts:
            ids = self.model.encode(text)
            yield np.array(ids, np.int64), b"".join(map(self.bytes.__getitem__, ids))


class Written:
    """Decimal ids followed by what comes after them."""

    def __init__(self, n: int):
        ids = list(map(str, range(n)))
        self.table = [f"{i}{after}" for after in (",", "|", ";") for i in ids]
        self.n = n

    def __call__(self, ids: np.ndarray, after: np.ndarray) -> list[str]:
        """after: 0 if a token of its side follows, 1 if the other side does, 2 at the end of a group."""
        return list(map(self.table.__getitem__, (after * self.n + ids).tolist()))


def labelled(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> np.ndarray:
    """The label of each of n bytes: which tokens end with it."""
    labels = np.zeros(n, np.uint8)
    labels[ends_a - 1] |= A_ENDS
    labels[ends_b - 1] |= B_ENDS
    return labels


def spans(labels: bytes) -> np.ndarray:
    """The ends of the spans up to each byte with which both tokens end."""
    return np.cumsum(np.fromiter(map(len, SPAN.findall(labels)), np.int64))


def _aligned(a_vocabulary: str, b_vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = RankTokens(a_vocabulary), PieceTokens(b_vocabulary)
        written = Written(max(len(s.sizes) for s in sides))
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, str]] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal number, size
            group = _group(held, sides, written)
            held.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_pydict({"batch": pa.array([number - 1], pa.int64()), **group}, schema=_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, text or ""))
                size += len(held[-1][1])
                if size >= GROUP_BYTES or len(held) >= GROUP_ROWS:
                    yield out()
        if held:
            yield out()

    return run


_SCHEMA = pa.schema([
    ("batch", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())),
    ("n_links", pa.list_(pa.int64())), ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("of_doc", pa.list_(pa.int64())), ("links", pa.binary()), ("times", pa.binary()),
])
_DDL = "batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, docs array<long>, of_doc array<long>, links binary, times binary"


def _group(held: list[tuple[int | None, str]], sides, written: Written) -> dict[str, list]:
    """The columns of one row of _DDL. of_doc: how many entries of links and times each document has; links: places in pairs."""
    ids: tuple[list, list] = ([], [])
    sizes = np.zeros(len(held), np.int64)
    texts = [t for _, t in held]
    for i, (text, (a, a_bytes), (b, b_bytes)) in enumerate(zip(texts, sides[0](texts), sides[1](texts))):
        whole = b" " + text.encode("utf-8")
        alike = bool(text) and a_bytes == whole and b_bytes == whole
        sizes[i] = len(whole) if alike else 0
        for side, found in zip(ids, (a, b)):
            side.append(found if alike else found[:0])
    counts = [np.array([len(x) for x in side], np.int64) for side in ids]
    ids_a, ids_b = (np.concatenate(side).astype(np.int64) for side in ids)
    # Both tokens end at a text's last byte, so that no span or link crosses from one text to the next.
    ends_a, ends_b = np.cumsum(sides[0].sizes[ids_a]), np.cumsum(sides[1].sizes[ids_b])
    last = np.cumsum(sizes)
    labels = labelled(ends_a, ends_b, int(sizes.sum()))

    at = np.flatnonzero(labels)
    kind = labels[at]
    of_a, of_b = (np.cumsum((kind & bit) > 0) - ((kind & bit) > 0) for bit in (A_ENDS, B_ENDS))
    pair, place = np.unique(ids_a[of_a] << PAIR_BITS | ids_b[of_b], return_inverse=True)
    doc = np.searchsorted(last, at, "right")
    entry, times = np.unique(doc * max(1, len(pair)) + place, return_counts=True)
    own, place = entry // max(1, len(pair)), entry % max(1, len(pair))

    ends = spans(labels.tobytes())
    first_a, first_b = np.searchsorted(ends_a, ends, "right"), np.searchsorted(ends_b, ends, "right")  # tokens up to each span's end
    in_order = np.argsort(np.concatenate([2 * np.searchsorted(ends, ends_a), 2 * np.searchsorted(ends, ends_b) + 1]), kind="stable")
    after = np.zeros(len(ids_a) + len(ids_b), np.int64)
    after[first_a - 1] = 1
    after[len(ids_a) + first_b - 1] = 2
    parts = written(np.concatenate([ids_a, ids_b])[in_order], after[in_order])
    to = np.concatenate([[0], np.cumsum(counts[0] + counts[1])]).tolist()
    digests = [hashlib.sha256("".join(parts[a:b])[:-1].encode()).hexdigest() if a < b else "" for a, b in zip(to, to[1:])]
    n_groups = np.bincount(np.searchsorted(last, ends - 1, "right"), minlength=len(held))
    return {
        "doc_id": [[i for i, _ in held]], "n_a": [counts[0]], "n_b": [counts[1]], "n_groups": [n_groups], "n_links": [np.bincount(doc, minlength=len(held))],
        "groups_sha256": [digests], "pairs": [pair], "docs": [np.bincount(place, minlength=len(pair))], "of_doc": [np.bincount(own, minlength=len(held))],
        "links": [place.astype(np.uint32).tobytes()], "times": [times.astype(np.uint32).tobytes()],
    }


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n_links, of_doc, links, times, counts, best) to n_best and count_sum of each document."""
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for of_doc, links, times, counts, best in zip(*(batch.column(i) for i in range(1, 6))):
            of_doc = of_doc.values.to_numpy(zero_copy_only=False) if of_doc.is_valid else np.empty(0, np.int64)
            places, times = np.frombuffer(links.as_buffer(), np.uint32), np.frombuffer(times.as_buffer(), np.uint32).astype(np.int64)
            counts, best = ((x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int64)) for x in (counts, best))
            ends = np.cumsum(of_doc)
            for found, value in zip(out, (best, counts)):
                total = np.concatenate([[0], np.cumsum(value.astype(np.int64)[places] * times)])
                found.append(total[ends] - total[ends - of_doc])
        yield pa.RecordBatch.from_pydict({"batch": batch.column(0), "n_best": pa.array(out[0], pa.list_(pa.int64())), "count_sum": pa.array(out[1], pa.list_(pa.int64()))})


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the alignment of two tokenizers over whole texts.

    documents, a row for each input row: doc_id, n_a and n_b (tokens), n_groups (stretches
    between byte offsets where tokens of both end), n_links (A-B token occurrences whose byte
    ranges overlap), n_best (links whose count is the highest of their A id), count_sum (of
    the counts over the links), groups_sha256. pairs: a, b, docs (how many documents hold
    the pair linked), best. A is encoded with a leading space, which B adds itself. Texts
    that are null, empty or not the same bytes as their tokens have no tokens: zeros and
    ''. Rows are documents of their own, even if their ids repeat or are null; other
    columns are ignored, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    aligned = scratch.save(rows.mapInArrow(_aligned(a_vocabulary, b_vocabulary), _DDL))
    held = scratch.save(aligned.select("batch", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("batch", "x.pairs", "x.docs"))
    a = F.shiftright("pairs", PAIR_BITS).alias("a")
    counts = scratch.save(held.groupBy("pairs").agg(F.sum("docs").alias("docs")))
    # An A id has at most as many pairs as B has ids.
    counts = scratch.save(counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(a))))
    known = held.select("batch", "pairs").join(counts, "pairs")
    # The pairs of a row are distinct and in order, and so are their counts.
    of_batch = known.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pairs", "docs", "best"))).alias("x"))
    of_batch = of_batch.select("batch", F.col("x.docs").alias("counts"), F.transform("x.best", lambda b: b.cast("long")).alias("best"))
    scored = aligned.select("batch", "of_doc", "links", "times").join(of_batch, "batch", "left").mapInArrow(_scored, "batch long, n_best array<long>, count_sum array<long>")
    every = aligned.drop("pairs", "docs", "of_doc", "links", "times").join(scored, "batch")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    documents = every.select(F.explode(F.arrays_zip(*columns)).alias("x")).select(*(f"x.{c}" for c in columns))
    return documents, counts.select(a, F.col("pairs").bitwiseAND((1 << PAIR_BITS) - 1).alias("b"), "docs", "best")


def op12_token_links(spark, sf_dir: str) -> DataFrame:
    return token_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]

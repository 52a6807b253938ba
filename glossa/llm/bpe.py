"""Byte-level BPE by recursive DuckDB queries inside Spark's partitions, and its decoding.

A task cuts its texts into the pattern's words and keeps a memo of those it has encoded.
New words become rows (word, position, token), at first a token for each byte, which a
recursive query joins with the merge table: each step contracts every word's leftmost
pair of minimum rank, until no word has a pair left. Long words are contracted by a
second query, at all places of the minimum rank up to the first whose contraction makes
a pair of lower rank, which is what one step after the other would give. Decoding joins
ids with the tokens' bytes and aggregates them in order of position. Nothing is shuffled,
and a lost task is run again on its own.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import bounded_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG_WORD = 64  # bytes
GROUP_BYTES = 5 << 20
MEMO_WORDS = 700_000
STEP_ROWS = 500_000
DECODE_ROWS = 1_000_000
DECODE_PART = 1 << 16
MEMORY = "600MB"
PLACE_BITS = 24  # of a position in a word of at most LONG_WORD bytes, with its word's number above

_SHORT_WORDS = """
WITH RECURSIVE step AS (
    SELECT spot, token, false AS done FROM fresh
    UNION ALL
    SELECT spot, token, done FROM (
        WITH pairs AS MATERIALIZED (
            SELECT p.spot, p.token, (m.rank::UBIGINT << 48) | ((p.spot & 16777215)::UBIGINT << 24) | (p.next_spot & 16777215)::UBIGINT AS merge
            FROM (
                SELECT spot, token, lead(spot) OVER in_order AS next_spot, lead(token) OVER in_order AS next_token
                FROM step WHERE NOT done WINDOW in_order AS (ORDER BY spot)
            ) p LEFT JOIN merges m ON (p.spot >> 24) = (p.next_spot >> 24) AND m.pair = ((p.token::UINTEGER << 16) | p.next_token::UINTEGER)
        ), best AS (
            SELECT spot >> 24 AS word, min(merge) AS merge FROM pairs GROUP BY 1
        )
        SELECT spot, CASE WHEN (spot & 16777215) = ((b.merge >> 24) & 16777215) THEN (b.merge >> 48)::INT ELSE token END AS token, b.merge IS NULL AS done
        FROM pairs p JOIN best b ON (p.spot >> 24) = b.word
        WHERE b.merge IS NULL OR (spot & 16777215) <> (b.merge & 16777215)::BIGINT
    )
)
SELECT spot >> 24 AS word, token FROM step WHERE done ORDER BY spot
"""

_LONG_WORDS = """
WITH RECURSIVE step(word, place, token) USING KEY (word, place) AS (
    SELECT word, place, token FROM fresh
    UNION
    (WITH near AS (
        SELECT word, place, token, row_number() OVER in_order AS nth, lead(place) OVER in_order AS next_place,
            lag(token) OVER in_order AS before, lead(token) OVER in_order AS next_token, lead(token, 2) OVER in_order AS after
        FROM recurring.step WHERE token IS NOT NULL WINDOW in_order AS (PARTITION BY word ORDER BY place)
    ), pairs AS MATERIALIZED (
        SELECT n.*, m.rank FROM near n JOIN merges m ON m.pair = ((n.token::UINTEGER << 16) | n.next_token::UINTEGER)
    ), least AS (
        SELECT word, min(rank) AS rank FROM pairs GROUP BY word
    ), hit AS (
        SELECT p.*, nth - row_number() OVER (PARTITION BY p.word ORDER BY nth) AS run FROM pairs p JOIN least USING (word, rank)
    ), taken AS (
        SELECT *, row_number() OVER of_word AS n, coalesce(lag(nth) OVER of_word = nth - 2, false) AS touches
        FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY nth) AS of_run FROM hit) WHERE of_run % 2 = 1
        WINDOW of_word AS (PARTITION BY word ORDER BY nth)
    ), lower AS (
        SELECT t.word, min(t.n) AS n
        FROM taken t
        LEFT JOIN merges l ON l.pair = ((CASE WHEN t.touches THEN t.rank ELSE t.before END::UINTEGER << 16) | t.rank::UINTEGER)
        LEFT JOIN merges r ON r.pair = ((t.rank::UINTEGER << 16) | t.after::UINTEGER)
        WHERE l.rank < t.rank OR r.rank < t.rank GROUP BY t.word
    ), contracted AS MATERIALIZED (
        SELECT t.word, t.place, t.rank, t.next_place FROM taken t LEFT JOIN lower USING (word) WHERE t.n <= coalesce(lower.n, t.n)
    )
    SELECT word, place, rank AS token FROM contracted
    UNION ALL
    SELECT word, next_place, NULL FROM contracted)
)
SELECT word, token FROM step WHERE token IS NOT NULL ORDER BY word, place
"""

_DECODED = """
SELECT part, string_agg(bytes, '' ORDER BY place) AS bytes
FROM coded JOIN tokens USING (id) GROUP BY part ORDER BY part
"""


def _ranges(codes: list[int]) -> str:
    """The inside of a character class of these code points, which are in order."""
    found, start = [], None
    for c, after in zip(codes, [*codes[1:], None]):
        start = c if start is None else start
        if after != c + 1:
            found.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return "".join(found)


class Words:
    """A text's matches of a pattern, with letters and numbers as the tiktoken library knows them.

    The regex module is fast, but knows letters of a later Unicode. Texts with characters on
    which it and unicodedata differ are cut with the classes spelled out by unicodedata,
    with which that library agrees on every code point.
    """

    def __init__(self, pattern: str):
        self.fast = regex.compile(pattern)
        every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
        kinds = [unicodedata.category(c)[0] for c in every]
        own = {k: [ord(c) for c, kind in zip(every, kinds) if kind == k] for k in "LN"}
        spelled = {k: _ranges(codes) for k, codes in own.items()}
        differ = [set(own[k]) ^ set(map(ord, regex.findall(rf"\p{{{k}}}", "".join(every)))) for k in "LN"]
        strange = sorted(set().union(*differ))
        self.first, self.strange = min(strange, default=sys.maxunicode + 1), re.compile(f"[{_ranges(strange)}]" if strange else "(?!)")
        inside, out = False, []
        for part in re.split(r"(\\p\{[LN]\}|\\.|[\[\]])", pattern):
            inside = part == "[" or inside and part != "]"
            if part.startswith("\\p{"):
                part = spelled[part[3]] if inside else f"[{spelled[part[3]]}]"
            out.append(part)
        self.sure = regex.compile("".join(out))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or np.frombuffer(text.encode("utf-32-le"), np.uint32).max() < self.first or not self.strange.search(text):
            return self.fast.findall(text)
        return self.sure.findall(text)


class Coder:
    """Encodes and decodes by the ranks of a tiktoken file: the same ids as that library's encode_ordinary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        if ranks and max(ranks.values()) >= 1 << 16:
            raise ValueError("the merge table packs two ids of 16 bits into one key")
        self.words, self.ranks = Words(pattern), ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        merges = [(ranks[t[:i]] << 16 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs, made = np.array(merges, np.int64).reshape(-1, 2).T
        self._table("merges", pair=pairs.astype(np.uint32), rank=made.astype(np.int32))
        # A byte is a code point below 256, as tokens needn't be UTF-8.
        self._table("tokens", id=np.array(list(ranks.values()), np.int32), bytes=pa.array([t.decode("latin-1") for t in ranks]))
        self._forget()

    def _table(self, name: str, **columns) -> None:
        given = pa.table(columns)
        self.con.register("given", given)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.start, self.size, self.used = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), 0

    def _contracted(self, query: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of all words, in order."""
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        fresh = {"spot": word << PLACE_BITS | place} if query is _SHORT_WORDS else {"word": word, "place": place}
        self.con.register("fresh", pa.table(fresh | {"token": token}))
        found = self.con.execute(query).fetchnumpy()
        self.con.unregister("fresh")
        return found["word"], found["token"]

    def _learn(self, words: list[str]) -> None:
        """Encodes words that the memo doesn't hold."""
        kinds: dict[str, list[tuple[int, bytes]]] = {_SHORT_WORDS: [], _LONG_WORDS: []}
        size, ids = np.ones(len(words), np.int64), {}
        for i, word in enumerate(words):
            held = word.encode("utf-8")
            if held in self.ranks:  # a word that is a token is that token, by whichever merges
                ids[i] = self.ranks[held]
            else:
                kinds[_SHORT_WORDS if len(held) <= LONG_WORD else _LONG_WORDS].append((i, held))
        at, tokens = [np.fromiter(ids.keys(), np.int64, len(ids))], [np.fromiter(ids.values(), np.int32, len(ids))]
        for query, fresh in kinds.items():
            lo = 0
            while lo < len(fresh):
                hi, rows = lo, 0
                while hi < len(fresh) and (rows == 0 or rows + len(fresh[hi][1]) <= STEP_ROWS):
                    rows += len(fresh[hi][1])
                    hi += 1
                word, token = self._contracted(query, [w for _, w in fresh[lo:hi]])
                own = np.array([i for i, _ in fresh[lo:hi]], np.int64)
                size[own] = np.bincount(word, minlength=hi - lo)
                at.append(own[word])
                tokens.append(token.astype(np.int32))
                lo = hi
        order = np.argsort(np.concatenate(at), kind="stable")
        first, n = len(self.memo), self.used
        self.start, self.size = _room(self.start, first, len(words)), _room(self.size, first, len(words))
        self.start[first : first + len(words)] = n + np.cumsum(size) - size
        self.size[first : first + len(words)] = size
        self.ids = _room(self.ids, n, len(order))
        self.ids[n : n + len(order)] = np.concatenate(tokens)[order]
        self.used = n + len(order)
        self.memo.update(zip(words, range(first, first + len(words))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        found = [self.words(t) if t else [] for t in texts]
        counts = np.array([len(w) for w in found], np.int64)
        coded = pa.array([w for words in found for w in words], pa.string()).dictionary_encode()
        del found
        distinct = coded.dictionary.to_pylist()
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        fresh = [w for w in distinct if w not in self.memo]
        if fresh:
            self._learn(fresh)
        memo = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        size = self.size[memo]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[memo] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        text_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        return ids, np.diff(text_ends, prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
        """The bytes of each text of so many ids; None if one of its ids isn't in the vocabulary."""
        ends = np.cumsum(counts)
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(ids)) - np.repeat(ends - counts, counts)
        known = np.zeros(1 << 16, bool)
        known[list(self.ranks.values())] = True
        wrong = np.unique(row[(ids < 0) | (ids >= 1 << 16) | ~known[ids & 0xFFFF]])
        # A part is a bounded stretch of a text, so that no group grows with a text.
        starts = np.flatnonzero(place % DECODE_PART == 0)
        part = np.cumsum(place % DECODE_PART == 0) - 1
        texts: list[list[bytes]] = [[] for _ in counts]
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + DECODE_ROWS, "right")) - 1) if starts[lo] + DECODE_ROWS < len(ids) else len(starts)
            a, b = starts[lo], starts[hi] if hi < len(starts) else len(ids)
            self.con.register("coded", pa.table({"part": part[a:b], "place": place[a:b], "id": ids[a:b]}))
            got = self.con.execute(_DECODED).fetchnumpy()
            self.con.unregister("coded")
            for p, text in zip(got["part"].tolist(), got["bytes"]):
                texts[row[starts[p]]].append(text.encode("latin-1"))
            lo = hi
        wrong = set(wrong.tolist())
        return [None if i in wrong else b"".join(t) for i, t in enumerate(texts)]


def _room(held: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(held):
        return held
    return np.concatenate([held[:used], np.empty(max(used, more), held.dtype)])


_coders: dict[tuple[str, str], Coder] = {}


def coder(vocabulary: str, pattern: str) -> Coder:
    """One for each vocabulary in a worker process: its memo serves one task after the other."""
    if (vocabulary, pattern) not in _coders:
        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        _coders[vocabulary, pattern] = Coder(ranks, pattern)
    return _coders[vocabulary, pattern]


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches gathered until their column has GROUP_BYTES, and larger ones cut into such."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        a_row = max(1, batch.column(column).nbytes // max(1, batch.num_rows))
        step = max(1, GROUP_BYTES // a_row)
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            if size and size + part.num_rows * a_row > GROUP_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += part.num_rows * a_row
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encoded(vocabulary: str, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for group in _groups(batches, 1):
            ids, counts = bpe.encode(group.column(1).to_pylist())
            columns = {"doc_id": group.column(0), "ids": _lists(ids, counts)}
            if decoded:
                columns["decoded"] = pa.array(bpe.decode(ids, counts), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _decoded(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for group in _groups(batches, 1):
            lists = group.column(1)
            counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            null = ~lists.is_valid().to_numpy(zero_copy_only=False)
            found = [None if gone else x for x, gone in zip(bpe.decode(ids, counts), null)]
            yield pa.RecordBatch.from_pydict({"doc_id": group.column(0), "decoded": pa.array(found, pa.binary())})

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids: the ids of each row's whole text, without special tokens.

    Null and empty texts have no ids (an empty list). Rows are encoded each on its own,
    whether their ids repeat or are null; columns other than the two named are ignored,
    and an empty table gives no rows. Texts of any length are encoded whole.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_encoded(vocabulary, pattern, False), "doc_id long, ids array<int>")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, decoded: the bytes that each row's ids stand for, which needn't be UTF-8.

    A null list, and one that holds a null or an id not in the vocabulary, gives null; an
    empty list gives no bytes. Rows are decoded each on its own; other columns are ignored.
    """
    bounded_batches(coded.sparkSession)
    rows = coded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>"))
    return rows.mapInArrow(_decoded(vocabulary, pattern), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids, decoded: encode() and decode() of its ids in the same task; rows as encode() has them."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_encoded(vocabulary, pattern, True), "doc_id long, ids array<int>, decoded binary")


def op13_duckdb_bpe(spark, sf_dir: str) -> DataFrame:
    coded = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

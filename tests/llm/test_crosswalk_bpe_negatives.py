"""Hard negatives, tokenizer alignment and BPE in DuckDB against SQL, the tokenizers' own libraries and brute force."""

import base64
import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossa.llm import bpe, crosswalk, negatives

RANDOM = random.Random(20240607)
POOLS = ("ab c", "aA \n\t'sé", "héàßñ漢字かな", "<|endoftext|>", "\x00\t\n▁ \U0001f600", "<0x41><s>", "\U00033118뷐Ꮰ 1½", "etaoinshrdlu", "= ")


def odd_texts(n: int) -> list[str]:
    found = []
    for _ in range(n):
        pools = RANDOM.sample(POOLS, RANDOM.randint(1, 3))
        found.append("".join(RANDOM.choice(RANDOM.choice(pools)) for _ in range(RANDOM.choice((0, 1, 4, 20, 150)))))
    return found


# Hard negatives


def brute_negatives(rows, anchors, positives=5, n=5, low=80, high=100):
    used = []
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all():
            used.append((i, [int(np.floor(256 * np.float64(x))) for x in v], label))
    out = []
    for a, v, label in used:
        if not anchors(a):
            continue
        scored = [(-max(-(1 << 56), min(1 << 56, sum(p * q for p, q in zip(v, w)))), i, k == label) for i, w, k in used if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted(x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit[:n], 1)]
    return sorted(out)


def mined(df, anchors):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, anchors).collect())


def test_negatives_equal_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(negatives.OP11_SQL)
    names = [c[0] for c in want.description]
    got = negatives.op11_ivf_negatives(spark, sf_dir)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall()) != []


@pytest.mark.parametrize("sizes", [(1024, 256), (7, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(negatives, "LIST_ROWS", sizes[0])
    monkeypatch.setattr(negatives, "BLOCK_ROWS", sizes[1])
    r = np.random.default_rng(4)
    centers = r.normal(size=(6, 5))
    rows = [(i, (centers[i % 6] + 0.2 * r.normal(size=5)).tolist(), int(r.integers(0, 4))) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5, 0.5], i % 3) for i in range(90)]  # ties: a third of the rows is one vector
    rows += [(400, [0.1, 0.2], 1), (410, [0.2, 0.1], 1), (411, [0.2, 0.1], 2), (420, [3e38, 1e30], 1), (421, [2e38, 0.0], 1), (422, [2.5e38, 1.0], 2), (430, [0.0] * 5, 1), (431, [-1.0] * 5, 1)]
    rows += [(None, [1.0] * 5, 1), (440, None, 1), (450, [1.0] * 5, None), (460, [1.0, None, 1.0, 1.0, 1.0], 1), (470, [float("nan")] * 5, 1), (480, [float("inf")] * 5, 1), (490, [], 1)]
    rows += [rows[10], rows[11], rows[11]]  # rows that repeat an id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    used = [(i, v, k) for i, v, k in df.collect()]
    want = brute_negatives(used, lambda i: i % 10 == 0)
    assert mined(df, F.col("vec_id") % 10 == 0) == want and len(want) > 200


def test_negatives_of_other_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mined(empty, F.lit(True)) == []
    one = spark.createDataFrame([(0, [1.0], 1, "x")], "vec_id long, embedding array<double>, label int, top string")
    assert mined(one, F.lit(True)) == []
    two = spark.createDataFrame([(0, [1.0], 1, 5, 6), (1, [1.0], 1, 5, 6), (2, [0.9], 2, 5, 6)], "vec_id long, embedding array<double>, label int, cluster int, anchor int")
    assert mined(two, F.col("vec_id") == 0) == [(0, 1, 1, 2, 65536, 58880)]


# Tokenizer alignment


def brute_links(rows):
    a_file, b_file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_file.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        a_bytes = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}

    def of_b(i: int) -> bytes:
        piece = b_file.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_file.is_byte(i) else piece.replace("▁", " ").encode()

    def placed(ids, made):
        at, out = 0, []
        for i, t in zip(ids, made):
            out.append((at, at + len(t), i))
            at += len(t)
        return out

    per, counts = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            ids = a_file.encode(" " + text, add_special_tokens=False).ids, b_file.encode(text)
            made = [a_bytes[i] for i in ids[0]], [of_b(i) for i in ids[1]]
            if all(b"".join(m) == (" " + text).encode() for m in made):
                a, b = placed(ids[0], made[0]), placed(ids[1], made[1])
        links = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = ["|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts)]
        counts.update(set(links))
        per.append((doc_id, len(a), len(b), groups, links))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(n, most.get(i, 0))
    found = [(d, a, b, len(g), len(x), sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, x in per]
    return found, {(i, j, n, n == most[i]) for (i, j), n in counts.items()}


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(crosswalk, "GROUP_BYTES", 4000)
    rows = list(enumerate(odd_texts(150)))
    rows += [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 2000).select("doc_id", "text").limit(60).collect()]
    rows += [(None, None), (1, None), (1, "a"), (1, "a"), (2, " "), (3, "  a  b "), (4, "<|endoftext|>"), (5, "<s> <unk> <0x0A>"), (6, "▁a"), (7, "x" * 500)]
    docs = spark.createDataFrame([(*r, 9, "y") for r in rows], "doc_id long, text string, n_links int, pairs string").repartition(3)
    documents, pairs = crosswalk.token_links(docs)
    want, want_pairs = brute_links(rows)
    assert in_order(documents.collect()) == in_order(want)
    assert {tuple(r) for r in pairs.collect()} == want_pairs


def test_links_of_an_empty_table(spark):
    documents, pairs = crosswalk.token_links(spark.createDataFrame([], "doc_id long, text string"))
    assert documents.collect() == pairs.collect() == []


def test_labels_and_spans():
    labels = crosswalk.labelled(np.array([1, 3, 6]), np.array([3, 5, 6]), 6).tobytes()
    assert labels == bytes([1, 0, 3, 0, 2, 3]) and crosswalk.spans(labels).tolist() == [3, 6]


# BPE


@pytest.fixture(scope="module")
def library():
    ranks = bpe.coder(bpe.VOCABULARY, public_tokenizers.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(library):
    coder = bpe.coder(bpe.VOCABULARY, public_tokenizers.PATTERN)
    texts = [*odd_texts(600), None, "", "a" * 5000, "=" * 3001, " " * 1000 + "x", "ab" * 2000, "abc" * 999, "漢字" * 500, "".join(RANDOM.choice("etaoins") for _ in range(1500))]
    ids, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [library.encode_ordinary(t or "") for t in texts]
    assert coder.decode(ids, counts) == [(t or "").encode() for t in texts]


def test_words_are_cut_as_the_library_cuts(library):
    cut = bpe.coder(bpe.VOCABULARY, public_tokenizers.PATTERN).words
    for c in [*range(0x3000), *range(0x10D40, 0x10D90), *range(0x323B0, 0x32400), *range(0x1E5D0, 0x1E600)]:
        text = f"a{chr(c)}b 1{chr(c)}2 {chr(c)}? {chr(c)} x"
        assert sum((library.encode_ordinary(w) for w in cut(text)), []) == library.encode_ordinary(text), hex(c)


def test_a_long_words_places_of_one_rank():
    """Ranks in which a contraction makes a pair of lower rank: only the leftmost place may be contracted at once."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 260, b"abca": 257, b"bc": 310, b"ca": 305, b"aa": 301, b"aaa": 299}
    coder = bpe.Coder(ranks)

    def plain(word: bytes) -> list[int]:
        tokens = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ranks), default=None)
            if found is None:
                return [ranks[t] for t in tokens]
            i = found[1]
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]

    for _ in range(40):
        word = "".join(RANDOM.choice("abc") for _ in range(RANDOM.choice((3, 30, 64, 65, 90))))
        assert coder.encode([word])[0].tolist() == (plain(word.encode()) if word.encode() not in ranks else [ranks[word.encode()]])


def test_the_memo_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 20)
    coder = bpe.Coder(bpe.coder(bpe.VOCABULARY, public_tokenizers.PATTERN).ranks)
    for text in odd_texts(12):
        assert coder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_BYTES", 3000)
    rows = [*enumerate(odd_texts(80)), (None, "null id"), (5, None), (5, "again"), (5, "again"), (6, ""), (7, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    got = bpe.round_trip(docs).collect()
    assert in_order((r.doc_id, r.ids, bytes(r.decoded)) for r in got) == in_order((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert in_order(bpe.decode(bpe.encode(docs)).select("doc_id", F.col("decoded").cast("string")).collect()) == in_order((i, t or "") for i, t in rows)
    assert bpe.round_trip(docs.limit(0)).collect() == []


def test_decoding_odd_lists(spark):
    coded = spark.createDataFrame([(1, None), (2, []), (3, [None]), (4, [70_000]), (5, [-1]), (6, [0]), (None, [1])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(coded).collect()}
    assert [got[i] is None for i in (1, 2, 3, 4, 5, 6, None)] == [True, False, True, True, True, False, False] and bytes(got[2]) == b""


def test_op13_digests(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.op13_duckdb_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert in_order(got.collect()) == in_order(want)

"""Operators on documents against brute force, with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import buckets, decontam, lines, minhash, packing, quality, separators
from glossa.llm.shared import Scratch
from glossa.llm.tokens import Encoder
from glossa.llm.words import WordHashes, shingle_set

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(7)
    base = prose(rng, 120)
    docs = [(0, base), (1, base), (2, base.upper()), (3, None), (4, ""), (5, "   "), (6, "one two"), (7, "ONE\ttwo"), (8, "one two three four five")]
    for i in range(9, 40):
        words = base.split()
        for _ in range(rng.randrange(1, 8)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(i, prose(rng, rng.randrange(1, 200))) for i in range(40, 70)]
    return docs


def components_of(items, linked):
    up = {i: i for i in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


def word_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(spark):
    docs = corpus()
    sets = {i: word_set(t) for i, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) > 0]
    want = components_of(sets, linked)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, key string, rep int")
    got = {r.doc_id: r for r in minhash.near_duplicates(table).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """With small buckets treated as large, the prefix filter finds the same links."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    test_near_duplicates(spark)


def test_near_duplicates_loses_no_link(spark):
    """Groups of three texts of 100 words at all similarities about the threshold, most of which meet in open buckets only."""
    rng = random.Random(77)
    docs, want = [], 0
    for g in range(1500):
        base = [f"w{rng.randrange(10**7)}" for _ in range(100)]
        sets = []
        for k in range(3):
            words = list(base)
            for at in rng.sample(range(100), rng.randrange(0, 5) if k else 0):
                words[at] = f"x{rng.randrange(10**7)}"
            docs.append((3 * g + k, " ".join(words)))
            sets.append(word_set(docs[-1][1]))
        up = list(range(3))
        for a, b in ((0, 1), (0, 2), (1, 2)):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = [lo if x == hi else x for x in up]
        docs[-3:] = [(*d, 3 * g + up[k]) for k, d in enumerate(docs[-3:])]
        want += len(set(up)) < 3
    rng.shuffle(docs)
    table = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table).collect()}
    assert got == {d: c for d, _, c in docs} and want > 500


def test_buckets_compare_by_band_values(spark):
    """Signature bytes that agree by chance in an earlier band hide no pair from the bucket of its first common band."""
    bands, hashes = 4, 8
    values = [np.array(v, np.uint64) for v in ([1, 2, 3, 4], [9, 8, 3, 4], [9, 2, 3, 7])]
    sigs = [bytes([5, 5, 1, 1, 2, 2, 3, 3]), bytes([5, 5, 4, 4, 2, 2, 3, 3]), bytes([6, 6, 1, 1, 2, 2, 9, 9])]
    keys = {2: [0, 1, 2], 1: [0, 2], 3: [0, 1], 0: [1, 2]}  # nodes by band
    rows = [((1 << 20) + band, n, n, sigs[n], values[n].tobytes(), "a b c d e f") for band, nodes in keys.items() for n in nodes]
    table = spark.createDataFrame(rows, "key long, node long, comp long, sig binary, bands binary, text string")
    found = buckets.joined_in_buckets(table, lambda: partial(shingle_set, width=5, memo=WordHashes()), Fraction(3, 4), bands, hashes, [(4, 0), (8, 2)], Scratch(spark))
    assert {(r.a, r.b) for r in found.collect()} == {(0, 1), (0, 2), (1, 2)}


def test_one_row_of_each_group_stays(spark):
    a, b, c = "a b c d e f g", "z y x w v u t", "one two three four five six"
    rows = [(3, a, 1), (3, a, 2), (2, a, 3), (5, b, 4), (5, c, 5), (None, b, 6), (None, None, 7), (None, "", 8), (1, None, 9), (1, None, 9)]
    got = minhash.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3))
    assert got.columns == ["doc_id", "text", "row"]
    assert sorted(r.row for r in got.collect()) == [3, 4, 5, 7, 8, 9, 9]
    assert minhash.dedup_documents(spark.createDataFrame([], "doc_id long, text string, gone int")).count() == 0


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "z y x w v u t"), (2, "z y x w v u t")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sum(r.component_id == 1 for r in got) == 3 and all(r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    a, b = "a b c d e f g", "z y x w v u t"
    got = minhash.near_duplicates(spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (7, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 7, True)]


def test_least_matches_bounds_the_posterior():
    for n, m in minhash.least_matches(0.75, 128, 32, 1e-6):
        grid = np.linspace(0, 1, 20001)[1:-1]
        dense = m * np.log(grid) + (n - m) * np.log(1 - grid)
        dense = np.exp(dense - dense.max())
        assert dense[grid >= 0.75].sum() / dense.sum() >= 0.9e-6


def bench_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def expected_contamination(docs, items):
    windows = []
    for item, text in items:
        w = bench_words(text)
        n = min(10, len(w))
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    for i, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for item, win in set(windows):
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [50_000, 0])  # broadcast, and joined by shuffle
def test_contamination(spark, most):
    rng = random.Random(3)
    long_item, short_item = prose(rng, 30), "Drei kurze Wörter"
    items = [(1, long_item), (2, short_item), (3, long_item), (4, None), (5, "--"), (6, "é"), (10, prose(rng, 9)), (11, prose(rng, 10))]
    docs = [(0, None), (1, ""), (2, "!!"), (3, long_item), (4, long_item.upper().replace(" ", " - ")), (5, "x " + " ".join(long_item.split()[5:17]) + " y")]
    docs += [(6, "drei KURZE wörter drei kurze Wörter"), (7, "drei kurze"), (8, items[6][1]), (9, "a " + items[7][1] + " b"), (9, "é é"), (None, short_item)]
    docs += [(20 + i, prose(rng, 50) + " " + " ".join(long_item.split()[i : i + 11]) + " " + prose(rng, i)) for i in range(19)]
    table = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(table, bench, broadcast_windows=most).drop("spans").collect()
    assert Counter(map(tuple, got)) == Counter(expected_contamination(docs, items))


def test_decontaminate_spans_and_documents(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "p q")], "item_id long, text string")
    rows = [(1, "Start. A b, c d e f g h i j? End!"), (2, "clean"), (3, None), (None, "p q x"), (2, "- p q, p q p r P Q."), (4, "p q")]
    docs = spark.createDataFrame([(i, t, 1, "s", 2, "r") for i, t in rows], "doc_id long, text string, _hit int, _spans string, hit int, row string")
    got = decontam.decontaminate(docs, bench)
    assert got.columns == docs.columns and [(r.doc_id, r.text, r._hit) for r in got.sort("text").collect()] == [(3, None, 1), (None, "p q x", 1)]
    got = decontam.decontaminate(docs, bench, cut="spans")
    assert got.columns == docs.columns and all((r._hit, r._spans, r.hit, r.row) == (1, "s", 2, "r") for r in got.collect())
    want = [(1, "Start. End!"), (2, "clean"), (3, None), (None, "x"), (2, "- p r "), (4, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    empty = bench.limit(0)
    assert decontam.contamination(docs, empty).where("n_hit > 0").count() == 0 and decontam.contamination(docs.limit(0), bench).count() == 0
    spans = decontam.contamination(spark.createDataFrame([(1, "p q p q z p q")], "doc_id long, text string"), bench).first().spans
    assert [tuple(s) for s in spans] == [(0, 4), (5, 7)]


def exact_ids(texts):
    """Ids as the contract calls for them: the tokenizers file, no special tokens added, then 1."""
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [(*f.ids, 1) for f in found]


def test_packing_is_exact(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.choice([0, 1, 30, 300, 3000]))) for i in range(60)] + [(60, None), (60, "again"), (None, "no id"), (61, "a <|endoftext|> b"), (62, "<|endoftext|>"), (63, "<|endoftext|><|endoftext|")]
    docs += [(i, "two words") for i in range(100, 4000)]  # very many short ones: the limit on segments closes sequences
    got = packing.pack(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").coalesce(2)).collect()
    want = Counter(zip((i for i, _ in docs), exact_ids([t for _, t in docs])))
    by_sequence = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        size = sum(p.length for p in pieces)
        assert size <= 2048 and size & (size - 1) == 0  # nothing is padded
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    whole = Counter()
    for i, pieces in of.items():
        for p in [[p] for p in pieces] if i == 60 else [sorted(pieces, key=lambda r: r.start)]:
            whole[i, tuple(x for q in p for x in q.ids)] += 1
    assert whole == want


def test_packing_keeps_every_limit(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.randrange(1, 60)), rng.randrange(0, 80)) for i in range(300)]
    limits = packing.Limits(tokens=256, segments=5, loss_tokens=100)
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, loss long"), loss_col="loss", limits=limits).collect()
    loss = {i: n for i, _, n in docs}
    use = Counter(), Counter(), Counter()
    for r in got:
        bearing = max(0, min(r.length, r.start + r.length - max(0, r.doc_tokens - loss[r.doc_id])))
        for c, n in zip(use, (r.length, 1, bearing)):
            c[r.sequence_id] += n
    assert max(use[0].values()) <= 256 and max(use[1].values()) <= 5 and max(use[2].values()) <= 100
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_tokens_equal_the_tokenizers_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for special in (True, False):
        exact.encode_special_tokens = not special
        encoder = Encoder(special=special)
        for text in ("don't  stop", "  x", " \n\n a", "a\n\n\nb  ", "àéÿ×÷ˆ", "１２3٣", "a\u00a0b", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "日本語 🙂", "I'm we'Re 12a34", "x\r\ny", "\n \n"):
            assert exact.encode(text, add_special_tokens=False).ids == encoder.encode(text).tolist()


def fuzzy_lines_expected(docs):
    occurrences = {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if line := " ".join(line.lower().split()):
                occurrences.setdefault(line, []).append((i, k))
    grams = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} for x in occurrences]
    linked = [(a, b) for a in range(len(grams)) for b in range(a) if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    group = components_of(range(len(grams)), linked)
    first = {}
    for k, at in enumerate(occurrences.values()):
        first[group[k]] = min(first.get(group[k], (10**9, 0)), min(at))
    return {o: (*first[group[k]], first[group[k]] == o) for k, at in enumerate(occurrences.values()) for o in at}


def line_docs():
    rng = random.Random(8)
    base = [prose(rng, n) for n in (3, 20, 20, 60)]
    docs = []
    for i in range(40):
        chosen = [rng.choice(base) for _ in range(2)] + [prose(rng, 12), "", "ok", "  OK "]
        chosen = [x.replace("w1", "q", 1) if rng.random() < 0.3 else x for x in chosen]
        docs.append((i, "\n".join(chosen)))
    return docs + [(40, None), (41, ""), (42, "\n\n"), (43, "ok")]


@pytest.mark.parametrize("small", [16, 2])
def test_fuzzy_lines(spark, monkeypatch, small):
    monkeypatch.setattr(lines, "SMALL", small)
    docs = line_docs()
    got = lines.line_groups(spark.createDataFrame([(i, t, 3, "z") for i, t in docs], "doc_id long, text string, row int, line string")).collect()
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in got} == fuzzy_lines_expected(docs)


def test_dedup_lines(spark):
    docs = [(1, "Alpha beta gamma\n\nshort"), (2, "alpha  beta gamma"), (3, "alpha beta gamma\nnew line"), (None, None), (4, ""), (3, "short\nother\nOther"), (5, "\n \n")]
    table = spark.createDataFrame([(i, t, "k", 7, "c", "l") for i, t in docs], "doc_id long, text string, _n string, _row int, _cut string, row string")
    got = lines.dedup_lines(table)
    assert got.columns == table.columns
    assert all((r._n, r._row, r._cut, r.row) == ("k", 7, "c", "l") for r in got.collect())
    want = [(1, "Alpha beta gamma\n\nshort"), (3, "new line"), (3, "other"), (None, None), (4, ""), (5, "\n \n")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sorted(((r.doc_id, r.text) for r in lines.dedup_lines(table, drop_emptied=False).collect()), key=str) == sorted([*want, (2, "")], key=str)
    assert lines.line_groups(table.limit(0)).count() == 0 and lines.dedup_lines(table.limit(0)).count() == 0


def test_separator_scan(spark):
    rng = random.Random(9)
    files, want = {}, []
    for f in range(3):
        ids = [rng.choice([1, 2, 3, 9]) for _ in range(50 * f)]
        files[f"f{f}"], at, k = ids, 0, 0
        for i, x in enumerate(ids + ([None] if ids and ids[-1] != 9 else [])):
            if x in (9, None):
                want.append((f"f{f}", k, at, i - at, x == 9))
                at, k = i + 1, k + 1
    for size in (1, 4, 7, 1000):
        blocks = [(f, 3 * b, np.array(ids[lo : lo + size], "<u2").tobytes()) for f, ids in files.items() for b, lo in enumerate(range(0, len(ids), size))]
        table = spark.createDataFrame(blocks + blocks[:2] + [("f0", 0, None)], "file string, block long, ids binary")
        got = separators.document_counts(table, end_id=9, itemsize=2, group_blocks=5).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert separators.document_counts(table.limit(0), 9, 2).count() == 0


@pytest.mark.parametrize("itemsize", [2, 4])
def test_token_files_in_parts(spark, tmp_path, itemsize):
    """Parts and blocks begin anywhere: the ids come back whole, whatever bytes they have."""
    rng = np.random.default_rng(itemsize)
    plain = rng.integers(0, 40, 3000).astype(f"<u{itemsize}").tobytes()
    mark = b"\xef\xbb\xbf\x00"
    files = {"a": plain, "b": b"\n" * 401, "c": plain[:37], "d": b"", "e": mark + plain[:400], "f": bytes([10, 0] * 200), "g": mark, "h": bytes(rng.integers(0, 256, 5000, np.uint8))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for tokens in (1, 7, 1000):
            got = {}
            for r in separators.read_token_files(spark, str(tmp_path), itemsize, tokens).orderBy("file", "block").collect():
                assert len(r.ids) % itemsize == 0 or r.file[-1] in "bcegh"
                got[r.file[-1]] = got.get(r.file[-1], b"") + bytes(r.ids)
            assert {k: v[: len(v) // itemsize * itemsize] for k, v in got.items()} == {k: v[: len(v) // itemsize * itemsize] for k, v in files.items() if v}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_separator_scan_of_documents_and_files(spark, tmp_path):
    docs = corpus()
    encoder = Encoder(special=False)
    docs.append((99, "ends <|endoftext|> not here"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(len(encoder.encode(t)) for _, t in docs)
    blocks = separators.token_blocks(table, block_tokens=64)
    assert sorted(r.n_tokens for r in separators.document_counts(blocks).collect()) == want
    data = b"".join(np.append(encoder.encode(t), separators.END_OF_TEXT).astype("<u4").tobytes() for _, t in docs)
    (tmp_path / "flat.bin").write_bytes(data)
    found = separators.document_counts(separators.read_token_files(spark, str(tmp_path), block_tokens=100)).orderBy("ordinal").collect()
    assert [r.n_tokens for r in found] == [len(encoder.encode(t)) for _, t in docs]


def test_separator_scan_saves_no_blocks(spark, sf_dir, tmp_path):
    """A saved row of a block is as wide as the block, and a reader holds thousands of them."""
    before = len(Scratch.made)
    separators.op9_separator_scan(spark, sf_dir).count()
    saved = [spark.read.parquet(f"{s.root}/{k}") for s in Scratch.made[before:] for k in range(1, s.n + 1)]
    assert saved and not any(kind == "binary" for table in saved for _, kind in table.dtypes)
    (tmp_path / "flat.bin").write_bytes(b"\n" * 400_000)
    assert separators.read_token_files(spark, str(tmp_path)).agg(F.max(F.octet_length("ids"))).first()[0] <= 1 << 17


def test_quality_classifier(spark, sf_dir):
    """Held-out documents: the combined views beat either alone, and exchanging labels doesn't hurt."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 4 > 0"), labels.where("doc_id % 4 = 0")
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in held.collect()}
    model = quality.train(docs, train)

    def right(mix):
        got = {r.doc_id: r.score for r in quality.score(docs, quality.Classifier(model.text, model.meta, mix)).collect()}
        return sum((got[i] >= 0.5) == g for i, g in good.items() if i in got) / len(good)

    both = right(model.mix)
    assert both > 0.85 and both >= right((1.0, 0.0, 0.0)) - 0.03 and both > right((0.0, 1.0, 0.0)) - 0.01
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    assert quality.score(odd, model).count() == 3
    assert quality.train(docs, labels.limit(0)) is None and quality.keep_good(docs, None).count() == docs.count()


def test_scores_equal_a_plain_recomputation(spark, sf_dir):
    """Rows of the query equal scores found one by one from the model's weights."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    docs = docs.withColumns({"good": F.lit(7), "words": F.lit("x")})
    model = quality.train(docs, labels, rounds=2)
    got = Counter((r.doc_id, round(r.score, 5)) for r in quality.trained_and_scored(docs, labels, rounds=2).collect())
    want, places = Counter(), (quality.Places(quality.TEXT_PLACES), quality.Places(quality.META_PLACES))
    for r in docs.collect():
        want[r.doc_id, round(model.score(r.text, r.lang, r.source, r.n_chars, *places), 5)] += 1
    assert sum((got & want).values()) >= 0.99 * sum(want.values()) and sum(got.values()) == sum(want.values())


def test_quality_hears_all_unlabelled_documents(spark):
    rows, labels = [], []
    for i in range(400):  # labelled: the words decide, and source s says the same
        good = i % 2
        rows.append((i, f"{'fine' if good else 'vile'} w{i % 7}", "en", "clean" if good else "spam", 10))
        labels.append((i, good, 0))
    # Unlabelled: more than any old bound, and only the last of them have the word "rare".
    rows += [(1000 + i, f"fine w{i % 7}", "en", "clean", 10) for i in range(12000)]
    rows += [(50000 + i, f"rare x{i}", "en", "spam", 10) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    places = quality.Places(quality.TEXT_PLACES)
    assert model.text.weights[places["rare"]] < -0.3


def test_quality_with_few_bad_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    bad = "quality = 0 or toxic = 1"
    few = spark.createDataFrame(labels.where(bad).orderBy("doc_id").limit(2).unionByName(labels.where(f"not ({bad})")).collect(), labels.schema)
    model = quality.train(docs, few, rounds=1)  # held out by a hash alone, either side may be of one kind
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    worst = {r.doc_id for r in few.where(bad).collect()}
    assert max(got[i] for i in worst) < sum(got.values()) / len(got)
    assert quality.train(docs, few.where(bad).limit(1).unionByName(few.where(f"not ({bad})")), rounds=1) is not None
    with pytest.raises(ValueError):
        quality.train(docs, few.where(f"not ({bad})"))


def test_buckets_of_a_task_join_components_once():
    """Small buckets are compared together and large ones alone, whatever the batches; a second link of two components isn't looked for."""
    rng = np.random.default_rng(8)
    texts = [f"{'shared words of the line ' * 3}{k % 7}{'x' * (k % 3)}" if k % 5 else f"alone {rng.integers(1 << 40)} and more {rng.integers(1 << 40)}" for k in range(160)]
    own = rng.integers(0, 2, (160, 16)).astype(np.uint64)
    rows = [(b * 64 + band, k, k // 2, sigs) for b, size in enumerate((2, 3, 2, 90, 1, 40)) for band in (0, 3) for k in rng.permutation(160)[:size].tolist() for sigs in [own[k].tobytes()]]
    rows.sort(key=lambda r: r[0])
    table = pa.table({"key": pa.array([r[0] for r in rows], pa.int64()), "node": pa.array([r[1] for r in rows], pa.int64()), "comp": pa.array([r[2] for r in rows], pa.int64()), "sig": [r[3] for r in rows], "bands": pa.nulls(len(rows), pa.binary()), "text": [texts[r[1]] for r in rows]})
    threshold = Fraction(4, 5)
    run = buckets._joined(lambda: partial(lines.line_set, width=9), threshold, 16, 64, [(64, 0)])

    def groups(links):
        up = {k: k // 2 for k in range(160)}
        for a, b in links:
            x, y = up[a], up[b]
            up = {k: min(x, y) if c in (x, y) else c for k, c in up.items()}
        return up

    want = []
    for key in {r[0] for r in rows}:
        inside = [r[1] for r in rows if r[0] == key]
        want += [(a, b) for a in inside for b in inside if a < b and np.flatnonzero(own[a] == own[b])[:1].tolist() == [key % 64] and buckets.reaches(lines.line_set(texts[a], 9), lines.line_set(texts[b], 9), threshold)]
    for size in (1, 13, 1000):
        found = [(r["a"], r["b"]) for b in run(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert groups(found) == groups(want) and set(found) <= set(want) and len(want) > 20
    twice = pa.concat_tables([table.slice(k, 1) for k in (0, 0, 0, 0)]).set_column(0, "key", pa.array([0, 0, 64, 64])).set_column(1, "node", pa.array([1, 2, 3, 4])).set_column(2, "comp", pa.array([1, 2, 1, 2]))
    held = next(iter(pa.concat_tables([twice, twice.slice(0, 1).set_column(0, "key", pa.array([128]))]).combine_chunks().to_batches()))
    assert sum(b.num_rows for b in run(iter([held]))) == 1


def test_cut_lines_are_broadcast(spark):
    """The texts aren't shuffled to be joined with the numbers of the lines to cut, unless these are many megabytes."""
    docs = spark.createDataFrame([(k, f"the same line in every one of the documents\nline {k} of its own, {k * k * 7919} times") for k in range(30)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = lines.dedup_lines(docs)
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sum("same line" in r.text for r in made.collect()) == 1 and made.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

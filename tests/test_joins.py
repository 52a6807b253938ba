"""Joins by sound, edit distance, word set and vector against all pairs; translations, the store and the table function."""

import json
import random
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.functions import semantic
from glossa.operators import alignment, components, embedding, lookup, nearest, pairs, scoring, setjoin, sounds, tablefunc
from glossa.plans import oracle, queries
from glossa.plans.fixtures import CHOICES, PARTS, RESPONSES, ROOTS, rows_of
from glossa.sources import translations
from glossa.sources.phonology import Phonology
from glossa.sources.store import Store

PLAIN = Phonology()
ODD = [PLAIN, PLAIN.merged(gap_penalty=-0.2, expansion_penalty=-0.1), PLAIN.merged(gap_penalty=-1.5, expansion_penalty=0.1), PLAIN.merged(gap_penalty=0.05)]


def words_of(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def random_words(rng, letters, n, longest):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(0, longest))) for _ in range(n)})


# By sound


@pytest.mark.parametrize("which", range(len(ODD)))
@pytest.mark.parametrize("least", [0.55, 0.75, 0.9, 1.0])
def test_bounds_lose_no_pair(which, least):
    rng, phonology = random.Random(which), ODD[which]
    segments = scoring.Segments(phonology)
    words = [[rng.choice("ptkaiusʃ7é") for _ in range(n)] for n in (1, 2, 3, 4, 5, 7) for _ in range(14)]
    for x in words:
        for y in words:
            n, m = len(x), len(y)
            raw = scoring.raw_scores([x], [y], phonology, segments)[0]
            if n > m or not (raw + m) / (2 * m) >= least:
                continue
            assert scoring.shifts(n, m, least, phonology) is not None
            p, q = (np.array([[segments[t] for t in w]]) for w in (x, y))
            every = np.arange(len(segments))
            bound = scoring.upper_bounds(p, q, segments.similarity(every[:, None], every[None, :]), least, phonology)
            assert bound[0, 0] >= raw - 1e-4


def test_batch_scores_equal_the_walk():
    rng = random.Random(3)
    words = [[rng.choice("ptkaiusʃ7é") for _ in range(rng.randrange(0, 7))] for _ in range(60)]
    for phonology in ODD:
        both = [(x, y) for x in words for y in words[:20]]
        for most in (1000, 0):
            got = scoring.raw_scores([x for x, _ in both], [y for _, y in both], phonology, scoring.Segments(phonology), most)
            for (x, y), raw in zip(both[:300], got):
                memo, total = {}, None
                for path in alignment.best_paths(x, y, phonology.merged(max_alignments=1, return_gaps=True), memo):
                    total = 0.0
                    i = j = 0
                    for p, q in path:
                        a = [] if p == "-" else next(x[i : i + k] for k in (1, 2) if "".join(x[i : i + k]) == p)
                        b = [] if q == "-" else next(y[j : j + k] for k in (1, 2) if "".join(y[j : j + k]) == q)
                        i, j = i + len(a), j + len(b)
                        sims = [alignment.segment_similarity(s, t, phonology, memo) for s in a for t in b]
                        total += phonology.gap_penalty if not sims else 2 * sims[0] - 1 if len(sims) == 1 else sum(sims) - 1 + phonology.expansion_penalty
                assert total == pytest.approx(raw, abs=1e-9)


@pytest.mark.parametrize("least", [0.7, 0.9])
def test_similar_sounding_equals_all_pairs(spark, least):
    rng = random.Random(5)
    a, b = (words_of(spark, [*random_words(rng, "ptkaisu7ʃ", n, 8), "tʰa", "t͡sa", None, "", "...", "a"]) for n in (150, 120))
    found = {(r.a, r.b): (round(r.raw, 9), round(r.similarity, 9)) for r in sounds.similar_sounding(a, b, least, block_words=32).collect()}
    scored = alignment.aligned_scores(pairs.all_pairs(a.distinct(), b.distinct())).where(F.col("similarity") >= least)
    assert found == {(r.a, r.b): (round(r.raw, 9), round(r.similarity, 9)) for r in scored.collect()} and len(found) > 50
    assert sounds.similar_sounding(a.limit(0), b, least).count() == 0


def test_most_pairs_are_never_scored():
    rng = random.Random(6)
    segments = scoring.Segments(PLAIN)
    x, y = (np.array([[segments[rng.choice("abdefgiklmnoprstuvz")] for _ in range(7)] for _ in range(500)]) for _ in range(2))
    every = np.arange(len(segments))
    bound = scoring.upper_bounds(x, y, segments.similarity(every[:, None], every[None, :]), 0.9, PLAIN)
    assert (bound >= 0.8 * 7).mean() < 0.02


def test_alignments_as_rows(spark):
    spark.createDataFrame([("tat", "t"), ("kæt", "kat"), ("", ""), (None, "pa")], "a string, b string").createOrReplaceTempView("word_pairs")
    tablefunc.register(spark)
    got = spark.sql("SELECT a, b, nth, place, seg_a, seg_b FROM word_pairs, LATERAL align_words(a, b)").collect()
    want = {(r.a, r.b, n, k, p.a, p.b) for r in alignment.alignments(spark.table("word_pairs")).collect() for n, path in enumerate(r.alignments) for k, p in enumerate(path)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_unknown_segments_shuffle_words_only(spark):
    words = words_of(spark, [f"{a}7{b}é{c}{a}7" for a in "ptkbdg" for b in "aiueo" for c in "smnlr"] * 2 + [None, "t͡s ʰ9"])
    got = {r.word: r.unknown for r in alignment.unknown_segments(words).collect()}
    assert len(got) == 152 and got[None] == [] and got["t͡s ʰ9"] == ["ʰ", "9"] and {tuple(u) for w, u in got.items() if w and "é" in w} == {("7", "é")}
    assert shuffled(spark, lambda: alignment.unknown_segments(words)) <= 302  # and no segments


# By edit distance


def plain_distance(a, b):
    table = [[float(i + j if not i or not j else 0) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            near = j > 1 and a[i - 1] == b[j - 2] or i > 1 and a[i - 2] == b[j - 1]
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 0.5 if near else 1))
    return table[-1][-1]


@pytest.mark.parametrize("most", [0, 0.5, 1, 2, 3.5])
def test_trie_and_band_equal_the_table(most):
    rng = random.Random(8)
    words = random_words(rng, "abcdé", 250, 9)
    trie = lookup.Trie(words)
    for word in [*words[:40], "", "zz"]:
        found, distances = trie.within(word, most)
        assert {(trie.words[i], d) for i, d in zip(found, distances)} == {(w, plain_distance(w, word)) for w in words if plain_distance(w, word) <= most}
    both = [(rng.choice(words), rng.choice(words)) for _ in range(800)]
    for (a, b), got in zip(both, lookup.banded_distances([a for a, _ in both], [b for _, b in both], most)):
        want = plain_distance(a, b)
        assert got == want if want <= most else np.isnan(got)


def test_band_at_a_thousand_letters():
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    texts = []
    for k in range(12):
        text = list(base)
        for _ in range(k):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(0, 2)] = rng.choice(["", "x", "yz"])
        texts.append("".join(text))
    got = lookup.banded_distances([base] * 12, texts, 6)
    want = [plain_distance(base, t) for t in texts]
    assert [w if w <= 6 else None for w in want] == [None if np.isnan(g) else g for g in got] and any(w > 6 for w in want)


def test_lookup_in_slices_and_nulls(spark):
    rng = random.Random(10)
    a, b = random_words(rng, "abc", 60, 6), random_words(rng, "abc", 50, 6)
    want = {(x, y, plain_distance(x, y)) for x in a for y in b if plain_distance(x, y) <= 1.5}
    left, right = words_of(spark, [*a, a[1], None]), words_of(spark, [*b, b[2], None])
    for trie_words in (1000, 7):
        got = [tuple(r) for r in lookup.words_within(left, right, 1.5, trie_words).collect()]
        assert set(got) == want and len(got) == len(want)
    assert lookup.words_within(left, right.limit(0), 1.5).count() == lookup.words_within(left.limit(0), right, 1.5).count() == 0
    table = spark.createDataFrame([("ab", "ba"), ("", "abcd"), (None, "a"), ("a", None), ("", "")], "a string, b string")
    assert [r.distance for r in lookup.distance_within(table, 2).collect()] == [plain_distance("ab", "ba"), None, None, None, 0.0]


# By word set


@pytest.mark.parametrize("least", [Fraction(1, 3), Fraction(1, 2), Fraction(4, 5), Fraction(1)])
def test_similar_sets_equal_all_pairs(spark, least):
    rng = random.Random(12)
    bags = [(i, [f"w{int(40 * rng.random() ** 2)}" for _ in range(rng.randrange(0, 9))]) for i in range(120)]
    bags += [(200 + i, ["hot"] + [f"w{rng.randrange(6)}"]) for i in range(60)]  # a word that a third of all sets has
    bags += [(300, None), (None, ["hot"]), (301, []), (302, ["w1", None, "w1"])]
    got = {tuple(r) for r in setjoin.similar_sets(spark.createDataFrame(bags, "id int, words array<string>"), least).collect()}
    sets = {i: set(w) - {None} for i, w in bags if i is not None and w}
    want = {(a, b, len(x & y), len(x | y)) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) >= least * len(x | y)}
    assert got == want and want
    with pytest.raises(ValueError):
        setjoin.similar_sets(spark.createDataFrame(bags, "id int, words array<string>"), Fraction(0))


def shuffled(spark, rows):
    """The rows that a query shuffles, its own result not among them."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    rows().write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("least", [Fraction(1, 6), Fraction(1, 2)])
def test_pairs_without_enough_words_leave_no_task(spark, least):
    rng = random.Random(13)
    hot = [f"h{k}" for k in range(9)]  # a million pairs meet in these, and hardly any is found
    sets = {i: {*rng.sample(hot, 3), *(f"w{i}-{k}" for k in range(rng.randrange(17, 40)))} for i in range(1500)}
    big = [f"b{k}" for k in range(3000)]
    sets |= {2000 + k: set(big[300 * k :]) for k in range(9)}  # sets of 600 to 3000 words, some of them at the threshold
    table = spark.createDataFrame([(i, sorted(w)) for i, w in sets.items()], "id long, words array<string>")
    want = {(a, b, len(x & y), len(x | y)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= least * len(x | y)}
    for parts in (None, 3):
        assert {tuple(r) for r in setjoin.similar_sets(table, least, parts=parts).collect()} == want and want
    assert shuffled(spark, lambda: setjoin.similar_sets(table, least)) < 10 * len(sets)


def test_sets_are_shuffled_once(spark):
    """No row is copied for each of the parts that it meets."""
    bags = spark.range(600).selectExpr("id", "array(concat('w', id), concat('h', id % 9)) words")
    assert shuffled(spark, lambda: setjoin.similar_sets(bags, Fraction(1, 2), parts=5)) == 600


@pytest.mark.parametrize("num, den", [(1, 6), (1, 2)])
def test_few_pairs_are_compared_set_by_set(monkeypatch, num, den):
    """Near the threshold too, and a block's side of the product is made once, not for each block that it meets."""
    rng, compared, made = np.random.default_rng(16), [], []
    sets = sorted((np.sort(rng.choice(700, n, False)) for n in rng.integers(100, 160, 1500)), key=len)
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", 256)
    common, side = setjoin._common, setjoin._Side.__init__
    monkeypatch.setattr(setjoin, "_common", lambda x, y: compared.append(1) or common(x, y))
    monkeypatch.setattr(setjoin._Side, "__init__", lambda self, *a: made.append(1) or side(self, *a))
    table = pa.table({"part": pa.array([0] * 1500, pa.int32()), "n": pa.array([len(w) for w in sets], pa.int32()), "id": list(range(1500)), "words": pa.array([w.tolist() for w in sets], pa.list_(pa.int64()))})
    rows = [{"key_p": b["key"], "key_q": b["key"], **{f"{c}_{s}": b[c] for s in "pq" for c in ("ids", "sizes", "words")}} for b in pa.Table.from_batches(setjoin._packed(iter(table.to_batches()))).to_pylist()]
    found = sum(b.num_rows for b in setjoin._alike(num, den)(iter(pa.Table.from_pylist(rows).to_batches())))
    ends = np.zeros((1500, 700), np.float32)
    for k, w in enumerate(sets):
        ends[k, w] = 1
    both, n = ends @ ends.T, ends.sum(axis=1)
    assert found == np.triu(both * den >= (n[:, None] + n - both) * num, 1).sum()
    assert len(compared) <= found + 1500 and (found > 500) == (num == 1 and den == 6) and len(made) < 30


def test_blocks_of_sets_meet(monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK_WORDS", 40)
    rng = random.Random(15)
    sets = sorted(((sorted(rng.sample(range(52), n)), f"i{k:03}") for k, n in enumerate([*(rng.randrange(1, 30) for _ in range(70)), 50, 41, 40, 40])), key=lambda x: (len(x[0]), x[1]))
    table = pa.table({"part": pa.array([3] * len(sets), pa.int32()), "n": pa.array([len(w) for w, _ in sets], pa.int32()), "id": [i for _, i in sets], "words": pa.array([w for w, _ in sets], pa.list_(pa.int64()))})
    blocks = pa.Table.from_batches(setjoin._packed(iter(table.to_batches(max_chunksize=7)))).to_pylist()
    assert [i for b in blocks for i in b["ids"]] == [i for _, i in sets] and len({b["key"] for b in blocks}) == len(blocks) > 20
    assert all(len(b["words"]) <= 8 * 40 or len(b["ids"]) == 1 for b in blocks)
    rows = [{"key_p": p["key"], "key_q": q["key"], **{f"{c}_{s}": b[c] for s, b in (("p", p), ("q", q)) for c in ("ids", "sizes", "words")}} for p in blocks for q in blocks if p["key"] <= q["key"]]
    got = [tuple(r.values()) for b in setjoin._alike(1, 3)(iter(pa.Table.from_pylist(rows).to_batches(max_chunksize=10))) for r in b.to_pylist()]
    named = [(i, set(w)) for w, i in sets]
    want = {(i, j, len(x & y), len(x | y)) for i, x in named for j, y in named if i < j and 3 * len(x & y) >= len(x | y)}
    assert set(got) == want and len(got) == len(want) > 20


# By vector


def test_nearest_vectors_equal_all_pairs(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-3, 4, 4).astype(float).tolist()) for i in range(90)]  # many ties
    odd = [(100, [0.0] * 4), (101, None), (102, []), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan")] * 4), (None, [1.0] * 4), (105, [1.0, 2.0]), (106, [2.0, 1.0]), (5, [9.0, 0.0, 0.0, 1.0])]
    used = [(i, np.array(v)) for i, v in rows + odd if i is not None and v and None not in v and np.isfinite(v).all()]
    unit = [(i, v / (np.linalg.norm(v) or 1)) for i, v in used]
    for size in (1000, 16):
        got = {(x.id, x.rank): (x.other, round(x.cosine, 9)) for x in nearest.nearest_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), 3, block_rows=size).where("id <> 5").collect()}
        want = {}
        for i, v in unit:
            near = sorted((-round(float(v @ w), 9), j) for j, w in unit if i != j and len(w) == len(v))
            want |= {(i, k): (j, -d) for k, (d, j) in enumerate(near[:3], 1)}
        assert got == {k: v for k, v in want.items() if k[0] != 5}
    assert nearest.nearest_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"), 3).count() == 0


def test_combined_distance_at_the_last_vector(spark, tmp_path):
    spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"a w{t}") for t in range(4)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(k, [1.0, float(k)]) for k in range(32)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("conversations", "embeddings"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.combined_distance(spark, str(tmp_path)).collect()  # turn 0 comes to vector 31, the last
    assert sorted(tuple(r) for r in got) == sorted(con.execute(oracle.ORACLE_SQL["combined_distance"]).fetchall()) and len(got) == 2


def test_nearest_vectors_shuffle_no_blocks_of_pairs(spark):
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, r.normal(size=3).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    # Of 75 blocks, a row goes to each of 16 parts and gets two from each; more blocks than parts change nothing.
    assert shuffled(spark, lambda: nearest.nearest_vectors(rows, 2, block_rows=8)) <= 600 * nearest.PARTS * 3 + 10


# Translations


def test_chain_of_languages(spark):
    texts = [("a", "eo", "A"), ("a", "ru", "А"), ("b", "eo", "  "), ("b", "ru", "Б"), ("c", "fr", "C"), ("d", "de", "zwei"), ("d", "de", "D"), ("d", "ru", "Д"), (None, "eo", "x"), ("e", "eo", None)]
    table = spark.createDataFrame(texts, "key string, lang string, text string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 6), (None, 7), ("a", 8)], "key string, text int")
    one = {r.text: (r.shown, r.lang) for r in translations.translated(rows, table, "eo", source_col="lang").collect()}
    assert one == {1: ("A", "eo"), 2: ("Б", "ru"), 3: ("c", None), 4: ("Д", "ru"), 5: ("e", None), 6: ("f", None), 7: (None, None), 8: ("A", "eo")}
    more = {r.text: r.shown for r in translations.translated(rows, table, "eo", ("de", "ru", "fr")).collect()}
    assert more == one_of(one) | {3: "C", 4: "D"}
    assert translations.translated(rows, table.limit(0), "eo").where("shown <> key").count() == 0


def one_of(found):
    return {k: v for k, (v, _) in found.items()}


# Embeddings from a server


class Stub:
    """Answers in turn, and notes what was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, address, body):
        self.asked.append((address.rpartition("/")[2], body.get("input", body.get("prompt"))))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_client_of_a_server():
    def ask(*answers, texts=("a",), retries=1):
        stub = Stub(*answers)
        return embedding.Client(stub, "http://x/", retries, 0).vectors(list(texts), "m"), stub.asked

    good = lambda *v: (200, "OK", json.dumps({"embeddings": list(v)}))
    assert ask(good([1, 2]))[0] == [([1, 2], None)]
    assert ask(good([1], [2]), texts=("a", "b"))[0] == [([1], None), ([2], None)]
    # An older server; a failure there; an answer without a vector.
    older = ask((404, "Not Found", ""), (200, "OK", '{"embedding": [3]}'), (500, "Oops", "x" * 300), (500, "Oops", "x" * 300), (200, "OK", "{}"), texts=("a", "b", "c"))
    assert older[0] == [([3], None), (None, "Embedding request failed: 500 Oops — " + "x" * 200), (None, "Invalid embedding response from /api/embeddings")]
    assert [path for path, _ in older[1]] == ["embed", "embeddings", "embeddings", "embeddings", "embeddings"]
    # Broken connections and busy servers are asked again; refusals aren't.
    assert ask(OSError("reset"), good([1]))[0] == [([1], None)] and ask((429, "Slow", ""), good([1]))[0] == [([1], None)]
    assert ask(OSError("reset"), OSError("reset"))[0] == [(None, "Embedding request failed: 0 reset")]
    assert ask((400, "Bad", ""))[0] == [(None, "Embedding request failed: 400 Bad")]
    # One text's failure isn't the others'.
    assert ask((400, "Bad", ""), good([1]), (400, "Bad", ""), texts=("a", "b"))[0] == [([1], None), (None, "Embedding request failed: 400 Bad")]
    for odd in ("no json", "[]", '{"embeddings": [1]}', '{"embeddings": [["x"]]}', '{"embeddings": []}'):
        assert ask((200, "OK", odd))[0] == [(None, "Invalid embedding response from /api/embed")]


def _counting(address, body):
    return 200, "OK", json.dumps({"embeddings": [[float(len(t)), 1.0] for t in body["input"]]})


def test_provider(spark):
    wanted = spark.createDataFrame([("abc", "m"), ("abc", "m"), ("abc", "n"), ("", "m"), (None, "m"), ("x", None)], "text string, model string")
    found = embedding.asked(_counting)(wanted)
    assert sorted((r.text, r.model, r.vector[0], r.error) for r in found.collect()) == [("", "m", 0.0, None), ("abc", "m", 3.0, None), ("abc", "n", 3.0, None)]
    found.unpersist()


# The store


def test_last_write_wins(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    frame = lambda *rows: spark.createDataFrame(list(rows), "key string, document string")
    state = lambda: {r.key: r.document for r in store.read().collect()}
    assert state() == {}
    store.write(frame(("a", "1"), ("b", "1"), ("c", "1"), (None, "x")))
    store.write(frame(("b", "2"), ("d", "2"), ("d", "1"), ("c", None)))
    assert state() == {"a": "1", "b": "2", "d": "2"}

    def fails(*_):
        raise OSError("no room")

    whole = store._add
    # A write that fails, while its rows are written or before they are named, leaves the old state.
    broken = frame(("a", "9")).withColumn("document", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.write(broken)
    assert state() == {"a": "1", "b": "2", "d": "2"}
    with monkeypatch.context() as patch:
        patch.setattr(store.spark, "createDataFrame", fails)
        with pytest.raises(OSError):
            whole(spark.range(1).selectExpr("'a' as key", "'9' as document"), 9, True)
    assert state() == {"a": "1", "b": "2", "d": "2"}
    store.compact()
    assert state() == {"a": "1", "b": "2", "d": "2"} and len(store._named()) == 1
    store.write(frame(("a", None), ("c", "3")))
    assert state() == {"b": "2", "c": "3", "d": "2"}
    store.compact()
    assert store.drop_old() >= 4 and state() == {"b": "2", "c": "3", "d": "2"} and store.drop_old() == 0


# What the queries over small inputs had as expected by hand


def test_pasted_answers(spark):
    want = [
        (1, 0.62, 0.38, "x", False), (2, 0.62, 0.38, "", False), (3, 0.5, 0.5, "", False), (4, 0.62, 0.38, "", False), (5, 0.15, 0.85, "", False), (6, 0.985, 0.015, "", False), (7, None, None, None, True),
        (8, None, None, None, None), (9, None, None, None, None), (10, 0.4, 0.6, "", False), (11, 0.7, 0.3, "", False), (12, 0.5, 1.0, "", False), (13, 1.0, 0.0, "", False), (14, 0.0, 1.0, "", False),
    ]
    found = rows_of(spark, RESPONSES, "id int, raw string").withColumn("p", semantic.parse_manual_response(F.col("raw")))
    assert sorted(tuple(r) for r in found.select("id", F.round("p.similarity", 9), F.round("p.distance", 9), "p.reason", "p.error").collect()) == want


def test_components_by_hand(spark):
    found = components.localized_components(rows_of(spark, PARTS, components.COMPONENT.removeprefix("struct<").removesuffix(">")), "en")
    got = {r.id: (r.shown_label, r.shown_meaning, r.shown_assimilation, r.shown_note) for r in found.collect()}
    assert got["u1"] == ("Primary root word", "видеть", "No assimilation", "") and got["u2"] == ("Primary root word", "to sit", "1. seder — sess- (to sit)", "")
    assert got["u3"] == ("Prefixes", "opposite meaning; also “in”", "", "before p and m") and got["u5"] == ("Прочее", "z", "", "") and got["suf-er"][0] == "Noun suffixes"
    affixes = components.affix_components(rows_of(spark, CHOICES, "component_id string, variant string")).select("component_id", "variant", *[f"component.{c}" for c in ("form", "source_id", "base_form", "assimilation_note")])
    assert {tuple(r) for r in affixes.collect()} == {
        ("pre-in", "il-", "il-", "pre-in", "in-", "перед l"), ("pre-in", None, None, None, None, None), ("pre-in", "zz-", None, None, None, None), ("suf-er", None, "-er", "suf-er", None, None),
        ("pre-re", None, "re-", "pre-re", None, None), ("gone", None, None, None, None, None), (None, None, None, None, None, None),
    }
    roots = components.root_components(rows_of(spark, ROOTS, "form string, meaning string, assimilation string")).select("assimilation", "component.form", "component.meaning")
    assert sorted(map(tuple, roots.collect()), key=repr) == sorted([("exc-seder", "seder", "сидеть"), ("none", "vider", "видеть"), ("none", None, None), ("add-t", None, None), ("exc-ceder", None, None), (None, None, None)], key=repr)

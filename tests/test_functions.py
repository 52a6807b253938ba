"""Column functions against golden values, plain recomputation and their properties."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from glossa.functions import edit, semantic, text
from glossa.operators import pairs
from glossa.sources import state


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema or "x string").select(expression.alias("r")).first().r


def words(n, seed=1, letters="abcde fг"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(n)]


def plain_distance(a, b, cost):
    row = list(map(float, range(len(b) + 1)))
    for i in range(1, len(a) + 1):
        next_row = [float(i)]
        for j in range(1, len(b) + 1):
            next_row.append(min(row[j] + 1, next_row[-1] + 1, row[j - 1] + cost(i, j)))
        row = next_row
    return row[-1]


def plain_graphic(a, b):
    def cost(i, j):
        if a[i - 1] == b[j - 1]:
            return 0
        return 0.5 if (j > 1 and a[i - 1] == b[j - 2]) or (i > 1 and a[i - 2] == b[j - 1]) else 1

    return plain_distance(a, b, cost)


def test_graphic_distance(spark):
    rows = list(zip(words(300), words(300, 2)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", edit.graphic_distance(F.col("a"), F.col("b")).alias("d"), edit.graphic_distance(F.col("b"), F.col("a")).alias("e")).collect()
    assert all(r.d == r.e == plain_graphic(r.a, r.b) for r in got)
    for a, b, d in (("ab", "ba", 1.5), ("kitten", "sitting", 3.0), ("hot rod", "old rod", 2.5), ("", "abc", 3.0), ("", "", 0.0)):
        assert one(spark, edit.graphic_distance(F.col("a"), F.col("b")), a=a, b=b) == d
    assert one(spark, edit.graphic_similarity(F.col("a"), F.col("b")), a="ab", b="ba") == 0.25
    assert one(spark, edit.graphic_similarity(F.col("a"), F.col("b")), a="", b="ba") is None


def test_phonetic(spark):
    tokens = edit.phonetic_tokens(F.col("a"))
    assert one(spark, tokens, a="t͡sa") == ["t͡s", "a"] and one(spark, tokens, a="t͡ɕa") == ["t", "͡", "ɕ", "a"] and one(spark, tokens, a="a\nb") == ["a", "\n", "b"]
    assert one(spark, tokens, a="") == []
    distance = edit.phonetic_distance(edit.phonetic_tokens(F.col("a")), edit.phonetic_tokens(F.col("b")))
    for a, b, d in (("dat", "tad", 1.0), ("t͡sa", "d͡za", 0.5), ("", "ab", 2.0), ("a|", "a", 1.0)):
        assert one(spark, distance, a=a, b=b) == d
    assert one(spark, edit.phonetic_similarity(F.col("a"), F.col("b")), a="dat", b="tad") == pytest.approx(2 / 3)


def test_shift_similarity(spark):
    for a, b, s in (("abcd", "abcx", 1.0), ("xabcd", "abcd", 0.5), ("abcd", "xxabcd", 0.4), ("xyzabc", "abc", 0.3), ("ab", "ab", 0.0), ("abc", "xyz", 0.0)):
        assert one(spark, edit.shift_similarity(F.col("a"), F.col("b")), a=a, b=b) == s


@pytest.mark.parametrize("least", [0.4, 0.6, 0.8, 1.0])
def test_pruned_join_is_exact(spark, least):
    a, b = (sorted({w for w in words(120, s, "abc") if w}) for s in (3, 4))
    x, y = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in (a, b))
    got = {(r.a, r.b) for r in pairs.similar_pairs(x, y, least).collect()}
    assert got == {(p, q) for p in a for q in b if 1 - plain_graphic(p, q) / max(len(p), len(q)) >= least}


@pytest.mark.parametrize("letters", ["abc", "abcdefghijklmnop"])
def test_most_similar(spark, letters):
    """The same pairs as all of them in order, whether many are alike or few."""
    ws = sorted({w for w in words(30, 5, letters) if w})
    scored = sorted((-round(1 - plain_graphic(a, b) / max(len(a), len(b)), 9), a, b) for a in ws for b in ws if a < b)
    got = pairs.most_similar(spark.createDataFrame([(w,) for w in ws], "word string"), 15).collect()
    assert [(r.a, r.b, -r.similarity) for r in got] == [(a, b, pytest.approx(s)) for s, a, b in scored[:15]]


def test_normalisation(spark):
    assert one(spark, text.normalize_graphic(F.col("a")), a="﻿  AbC　") == "abc"
    assert one(spark, text.normalize_text(F.col("a")), a=" Ёж \t  И ") == "еж и" and one(spark, text.normalize_text(F.col("a")), a=None) == ""
    assert one(spark, text.normalize_semantic(F.col("a")), a=' (A). "B"  c-d «e»! ') == "a b c-d «e»"
    assert one(spark, text.semantic_tokens(F.col("a")), a=" . ") == []
    assert one(spark, text.escape_html(F.col("a")), a="<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#039;"
    assert one(spark, text.has_value(F.col("a")), a=" ") is False


def test_fixed3(spark):
    for x, shown in ((0.0625, "0.063"), (0.3125, "0.313"), (0.9125, "0.912"), (1.0, "1.000"), (0.0, "0.000"), (2 / 3, "0.667")):
        assert one(spark, text.fixed3(F.col("a")), a=x) == shown


def test_codecs(spark):
    for value in ("", "a", "ab", "é" * 100, 'q"\\\n', "?>~"):
        code = one(spark, text.base64url(F.col("a")), a=value)
        assert code == base64.urlsafe_b64encode(value.encode()).decode().rstrip("=") and one(spark, text.from_base64url(F.col("a")), a=code) == value
    entries = F.array(F.struct(F.lit("k").alias("key"), F.col("a").alias("value")), F.struct(F.lit("box").alias("key"), F.lit(None).cast("string").alias("value")))
    code = one(spark, state.link_state(entries), a='x "y"')
    assert json.loads(base64.urlsafe_b64decode(code + "=" * (-len(code) % 4))) == [["k", 'x "y"'], ["box", 1]]
    assert [tuple(e) for e in one(spark, state.from_link_state(F.col("a")), a=code)] == [("k", 'x "y"'), ("box", "1")]
    assert one(spark, state.from_link_state(F.col("a")), a="!!") == []


def test_numbers(spark):
    nan, inf = float("nan"), float("inf")
    for x, y in ((nan, 0.0), (inf, 0.0), (2.0, 1.0), (-1.0, 0.0), (0.5, 0.5)):
        assert one(spark, semantic.clamp01(F.col("a")), a=x) == y
    assert one(spark, F.isnan(semantic.clamp(F.col("a"), 0.0, 1.0)), a=nan) and one(spark, semantic.clamp(F.col("a").cast("double"), 0.0, 1.0), a=None) is None
    assert one(spark, semantic.weighted_move(F.col("a"), 55, 0.35), a=10.0) == pytest.approx(25.75) and one(spark, semantic.weighted_move(F.col("a"), 55, 0.35), a=nan) == 0
    assert one(spark, semantic.almost_equal(F.col("a"), F.lit(0.3)), a=0.1 + 0.2)


def test_meanings(spark):
    j = one(spark, semantic.jaccard(F.col("a"), F.col("b")), a="vision again", b="revision")
    assert (j.similarity, j.distance, j.union) == (0, 1, 3)
    j = one(spark, semantic.jaccard(F.col("a"), F.col("b")), a="", b=None)
    assert (j.similarity, j.distance, j.intersection, j.union) == (0, 1, 0, 1)
    assert one(spark, semantic.jaccard(F.col("a"), F.col("b")), a="A, b", b="b a a").similarity == 1
    assert one(spark, semantic.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]) == 0
    assert one(spark, semantic.embedding_distance(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]).similarity == 0.5
    assert one(spark, semantic.embedding_distance(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0]) is None
    c = one(spark, semantic.combined(F.lit(1.0), F.col("a")), a=0.38)
    assert c.distance == pytest.approx(0.814) and c.similarity == pytest.approx(0.186)
    c = one(spark, semantic.combined(F.lit(0.25), F.col("a").cast("double")), a=None)
    assert (c.distance, c.similarity, c.rule_weight, c.embedding_weight) == (0.25, 0.75, 1, 0)
    assert one(spark, semantic.manual_prompt(F.col("a"), F.col("b")), a="", b="x").split("\n")[7:9] == ['Logical analysis: "—"', 'International meaning: "x"']


def test_explanations(spark):
    got = pairs.compared(spark.createDataFrame([(" AB", "ba"), ("", "x"), (None, "x")], "a string, b string"), "graphic", "en").collect()
    assert [r.shown for r in got] == ["0.250", "Please fill in both words", "Please fill in both words"]
    assert got[0].explanation.split("\n")[5:10] == ["Word A: ab", "Word B: ba", "", "Levenshtein distance: 1.5".replace("1.5", "1.5"), "Max length: 2"][:5]

"""Alignment, classification, the lexicon and the registered queries."""

import math
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glossa import registry
from glossa.functions import edit, semantic
from glossa.operators import alignment, classify, components
from glossa.plans.fixtures import rows_of
from glossa.sources import lexicon, state
from glossa.sources.phonology import FEATURES, INVENTORY, Phonology, normalize_ipa

PLAIN = Phonology()


def scores(spark, rows, phonology=PLAIN):
    return {(r.a, r.b): r for r in alignment.aligned_scores(spark.createDataFrame(rows, "a string, b string"), phonology).collect()}


def test_inventory():
    assert len(INVENTORY) == 141 and sum(f["syllabic"] for f in INVENTORY.values()) == 44 and sum(w for w, _ in FEATURES.values()) == 271
    assert INVENTORY["w"]["place"] == 10 and INVENTORY["h"]["aspirated"] == 1 and INVENTORY["ʈ͡ʂ"]["retroflex"] == 1


@pytest.mark.parametrize(
    "a, b, d",
    [("t", "d", 0.044280), ("t", "s", 0.030996), ("t", "k", 0.056089), ("m", "b", 0.157934), ("i", "y", 0.036900), ("a", "ä", 0.044280), ("t", "a", 0.357196), ("t", "tʰ", 0.018450), ("t", "tʲ", 0.078690), ("a", "7", 1), ("7", "7", 0)],
)
def test_segment_distance(spark, a, b, d):
    assert 1 - alignment.segment_similarity(a, b, PLAIN, {}) == pytest.approx(d, abs=1e-6)
    found = alignment.segment_pairs(alignment.token_features(spark.createDataFrame([(a,), (b,)], "token string"))).collect()
    assert all(r.distance == pytest.approx(d if r.a != r.b else 0, abs=1e-6) for r in found)


def test_tokens(spark):
    table = spark.createDataFrame([("t͜sa",), ("t.s",), ("ts",), ("ˈkæt ",), ("ã",), ("ɛ̃ː",), ("x͡a",), (None,), ("aʰ.ʰ",)], "word string")
    got = {r.word: r.tokens for r in alignment.tokenized(table).collect()}
    assert got["t͜sa"] == ["t͡s", "a"] and got["t.s"] == ["t", "s"] and got["ts"] == ["ts"] and got["ˈkæt "] == ["k", "æ", "t"]
    assert got["ã"] == ["ã"] and got["ɛ̃ː"] == ["ɛ̃ː"] and got["x͡a"] == ["x", "͡", "a"] and got[None] == [] and got["aʰ.ʰ"] == ["aʰ", "ʰ"]
    assert PLAIN.features("ã") is None and Phonology(decompose=True).features("ã")["nasal"] == 0.8
    assert normalize_ipa(" Aː:'﻿") == "aːːˈ"
    unknown = {r.word: r.unknown for r in alignment.unknown_segments(spark.createDataFrame([("a7b77é",), ("ab",), ("",), (None,)], "word string")).collect()}
    assert unknown == {"a7b77é": ["7", "é"], "ab": [], "": [], None: []}


def test_scores(spark):
    got = scores(spark, [("ta", "da"), ("pa", "p"), ("ts", "t͡s"), ("", ""), ("pa", ""), (None, "pa")])
    for pair, raw, similarity in ((("ta", "da"), 1.911439, 0.977860), (("pa", "p"), 0.490849, 0.622712), (("ts", "t͡s"), 1, 1), (("", ""), 0, 1), (("pa", ""), -1.3, 0), ((None, "pa"), -1.3, 0)):
        assert (got[pair].raw, got[pair].similarity) == (pytest.approx(raw, abs=1e-6), pytest.approx(similarity, abs=1e-6))
    apart = scores(spark, [("ts", "t͡s")], PLAIN.merged(merge_plain_affricates=False))["ts", "t͡s"]
    assert apart.raw == pytest.approx(0.789004, abs=1e-6) and apart.similarity == pytest.approx(0.697251, abs=1e-6)


def test_native_score_equals_the_walk(spark):
    rows = [(a, b) for a in ("kæt", "straɪk", "t͡ʃɜːt͡ʃ", "aʊə", "ps") for b in ("kat", "trek", "ʃurʃ", "ksa", "")]
    for phonology in (PLAIN, PLAIN.merged(merge_diphthongs=True, gap_penalty=-0.3, keep_length=False)):
        for r in alignment.alignments(spark.createDataFrame(rows, "a string, b string"), phonology).collect():
            memo = {}
            sim = lambda x, y: alignment.segment_similarity(x, y, phonology, memo)
            assert 1 <= len(r.alignments) <= 20 or not r.tokens_a and not r.tokens_b
            for path in r.alignments:
                i = j = 0
                total = 0.0
                for p in path:
                    x = [] if p.a == "-" else next(r.tokens_a[i : i + k] for k in (1, 2) if "".join(r.tokens_a[i : i + k]) == p.a)
                    y = [] if p.b == "-" else next(r.tokens_b[j : j + k] for k in (1, 2) if "".join(r.tokens_b[j : j + k]) == p.b)
                    i, j = i + len(x), j + len(y)
                    if not x or not y:
                        total += phonology.gap_penalty
                    elif len(x) == len(y):
                        total += 2 * sim(x[0], y[0]) - 1
                    else:
                        (one,), two = (x, y) if len(x) == 1 else (y, x)
                        total += sim(one, two[0]) + sim(one, two[1]) - 1 + phonology.expansion_penalty
                assert (i, j) == (len(r.tokens_a), len(r.tokens_b)) and total == pytest.approx(r.raw, abs=1e-9)


def test_options(spark):
    with pytest.raises(ValueError):
        PLAIN.merged(gap=1)
    more = PLAIN.with_feature("7", place=30.0, manner=1.0).with_alias("8", "7")
    assert scores(spark, [("7", "8")], more)["7", "8"].similarity == 1 and PLAIN.features("7") is None
    # One segment left over goes into a two-to-one move on either side, and the other is a gap: two best ways.
    ties = spark.createDataFrame([("tat", "t"), ("pap", "pp"), ("aaaa", "aa")], "a string, b string")
    ways = lambda **o: {r.a: [[(p.a, p.b) for p in path] for path in r.alignments] for r in alignment.alignments(ties, PLAIN.merged(**o)).collect()}
    assert ways() == {"tat": [[("ta", "t"), ("t", "-")], [("t", "-"), ("at", "t")]], "pap": [[("pa", "p"), ("p", "p")], [("p", "p"), ("ap", "p")]], "aaaa": [[("aa", "a"), ("aa", "a")]]}
    assert ways(max_alignments=1, return_gaps=False) == {"tat": [[("ta", "t")]], "pap": [[("pa", "p"), ("p", "p")]], "aaaa": [[("aa", "a"), ("aa", "a")]]}
    places = alignment.explained(spark.createDataFrame([("tat", "t7")], "a string, b string"), PLAIN.merged(expansion_penalty=-5.0)).orderBy("place").collect()
    assert [(r.seg_a, r.seg_b, r.note) for r in places] == [("t", "t", None), ("a", "-", "gap"), ("t", "7", None)] and [r.distance for r in places] == [0, 1, 1]
    assert places[0].features_a == [float(INVENTORY["t"][f]) for f in FEATURES] and places[1].features_a is None and places[2].features_b is None
    assert all(r.unknown_a == [] and r.unknown_b == ["7"] for r in places)


def test_more_segments_than_the_constant_holds(spark):
    """The same scores where every pair finds the similarities of its own segments."""
    rows = spark.createDataFrame([(a, b) for a in ("kæt", "straɪk", "t͡ʃɜː7", "", None) for b in ("kat", "ksa", "7", "")], "a string, b string")
    few, many = ({(r.a, r.b): (r.raw, r.similarity) for r in alignment.aligned_scores(rows, max_segments=n).collect()} for n in (500, 0))
    assert few.keys() == many.keys() and all(few[k] == pytest.approx(many[k], abs=1e-12) for k in few)


def test_fixed_values():
    """Golden checksums of the fixed tables: the queries' SQL is built from the same tables, so it can't tell."""
    crc = lambda x: zlib.crc32(x.encode())
    assert [(len(x.splitlines()), crc(x)) for x in (lexicon.COMPONENTS, lexicon.ASSIMILATIONS, lexicon.PREFIX_VARIANTS)] == [(147, 1475273823), (27, 2255599146), (33, 2657859456)]
    assert crc("\n".join(semantic.PROMPT)) == 412966496 and (len(edit.PHONETIC_PAIRS), crc(repr(edit.PHONETIC_PAIRS))) == (27, 3067091697)
    assert crc(repr(sorted(classify.REASONS.items()))) == 3249803186 and crc(repr(sorted(FEATURES.items()))) == 2220367443
    sums = {"place": 4492, "manner": 204.3, "voice": 104, "height": 30.86, "back": 23.35, "round": 23}
    assert all(sum(f[n] for f in INVENTORY.values()) == pytest.approx(x) for n, x in sums.items())


def record(regular="re/vis/ion", logical="vision again", international="revision", natural="re/vis/ion/u", parts=1, llm=False, pasted=None):
    return (regular, logical, international, natural, [("1", "re")] * parts, llm, None, None, pasted)


RECORD = "regular_word string, logical_meaning string, international_meaning string, naturalistic_word string, components array<struct<id:string,form:string>>, use_llm boolean, ollama_url string, embedding_model string, manual_response string"


def test_classes(spark):
    cases = [
        (record(), "double_meaning_with_modification", "high", "rule_only"),
        (record(natural=""), "double_meaning_modification_missing", "medium", "rule_only"),
        (record(logical="Revision"), "regular_only", "high", "rule_only"),
        (record(logical="Revision.", natural=None), "double_meaning_modification_missing", "low", "rule_only"),
        (record(regular="  "), "insufficient_data", "low", None),
        (record(pasted='{"distance":0.0}'), "double_meaning_with_modification", "high", "rule_plus_manual_embedding"),
        (record(llm=True, pasted="no number"), "double_meaning_with_modification", "high", "rule_plus_embedding"),
        (record(logical="other", llm=True), "double_meaning_with_modification", "high", "rule_fallback"),
    ]
    vectors = spark.createDataFrame([("vision again", classify.MODEL, [1.0, 0.0]), ("revision", classify.MODEL, [1.0, 0.0])], "text string, model string, vector array<double>")
    rows = rows_of(spark, [(i, *c[0]) for i, c in enumerate(cases)], "k int, " + RECORD)
    got = {r.k: r for r in classify.classified(rows, classify.precomputed(vectors), "en").collect()}
    assert [(got[i].classification, got[i].confidence, got[i].method) for i in range(len(cases))] == [c[1:] for c in cases]
    assert got[6].final.distance == pytest.approx(0.7) and got[7].error.startswith("Local model unavailable") and got[4].reasons == ["Regular-model word is missing."]
    assert classify.classified(rows, None, "ru").where("k = 0").first().reasons == [classify.REASONS["differs"][0], classify.REASONS["provided"][0]]


def test_lexicon(spark):
    parts = lexicon.components(spark)
    assert (parts.count(), parts.select("id").distinct().count(), lexicon.assimilations(spark).count(), lexicon.prefix_variants(spark).count()) == (147, 147, 27, 33)
    assert {r.category: len(r["items"]) for r in components.by_category(spark).collect()}["Приставки"] == 51
    assert lexicon.assimilations(spark).where("fixed").count() == 13 and parts.where("meaning_en is null").count() == 0


def test_sessions(spark):
    stored = '{"regularWord":"w","components":[{"id":"1","type":"root","label":"x","form":"f"},{"id":"2","type":"component","label":"old","category":"C","assimilationNote":"n"}],"useLLM":true}'
    got = state.restored(spark.createDataFrame([(1, stored), (2, "{bad"), (3, None), (4, "{}"), (5, "[1]")], "k int, s string"), "s").collect()
    by_key = {r.k: r for r in got}
    assert set(by_key) == {1, 4}
    assert [(c.label, c.assimilation_note) for c in by_key[1].components] == [("root", None), ("C", "n")] and by_key[1].use_llm and by_key[4].embedding_model == classify.MODEL


def same(x, y):
    return x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("part", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r) for r in registry.QUERIES[name](spark, sf_dir).select(*[F.col(f"`{c}`") for c in columns]).collect()), key=str)
    assert len(want) == len(got) and all(same(x, y) for a, b in zip(want, got) for x, y in zip(a, b))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Phonetic alignment of word pairs by weighted features of their segments.

Words are normalised and cut once per distinct word. Scores and alignments are found in
Arrow batches: all pairs of a batch whose words have the same numbers of segments are
scored in step, and a batch looks features up once per distinct segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.scoring import TABLE, Segments, raw_scores
from glossa.sources.phonology import FEATURES, Phonology, normalize_ipa

TOTAL_WEIGHT = sum(weight for weight, _ in FEATURES.values())
GAP = "-"
KNOWN_TOKENS = 1 << 16  # that a task remembers


def normalized_words(words: DataFrame, phonology: Phonology = Phonology()) -> DataFrame:
    """word, ipa for each distinct value of the column word; null is an empty transcription."""
    decompose = phonology.decompose

    @F.pandas_udf("string")
    def ipa(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(lambda w: normalize_ipa(w, decompose))

    return words.select("word").distinct().withColumn("ipa", ipa("word"))


def tokenized(words: DataFrame, phonology: Phonology = Phonology()) -> DataFrame:
    """word, tokens for each distinct value of the column word."""
    tokens = F.regexp_extract_all("ipa", F.lit("(?s)" + phonology.token_pattern), F.lit(1))
    return normalized_words(words, phonology).select("word", tokens.alias("tokens"))


def token_features(tokens: DataFrame, phonology: Phonology = Phonology()) -> DataFrame:
    """token and a double for each feature (all null if its base is unknown), for each distinct token."""
    names = list(FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [phonology.features(t) for t in batch["token"]]
            yield pd.DataFrame({"token": batch["token"], **{n: [None if f is None else f[n] for f in rows] for n in names}}).astype({n: "float64" for n in names})

    return tokens.select("token").distinct().mapInPandas(run, "token string, " + ", ".join(f"`{n}` double" for n in names))


def _distance(a: str, b: str) -> Column:
    """Weighted mean of the features' differences; 0 for equal tokens, 1 if either is unknown."""
    total = F.lit(0.0)
    for name, (weight, span) in FEATURES.items():
        total = total + F.least(F.lit(1.0), F.abs(F.col(f"{a}.{name}") - F.col(f"{b}.{name}")) / float(span)) * float(weight)
    unknown = F.isnan(F.coalesce(F.col(f"{a}.place"), F.lit(float("nan")))) | F.isnan(F.coalesce(F.col(f"{b}.place"), F.lit(float("nan"))))
    return F.when(F.col(f"{a}.token") == F.col(f"{b}.token"), 0.0).when(unknown, 1.0).otherwise(total / float(TOTAL_WEIGHT))


def segment_pairs(features: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """a, b, distance, similarity for all pairs of the tokens of token_features(), or of these and others: inventories, not corpora."""
    pairs = features.alias("a").join(F.broadcast((features if others is None else others).alias("b")), how="cross")
    distance = _distance("a", "b")
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))
    return pairs.select(F.col("a.token").alias("a"), F.col("b.token").alias("b"), distance.alias("distance"), similarity.alias("similarity"))


def aligned_scores(pairs: DataFrame, phonology: Phonology = Phonology(), max_segments: int = TABLE) -> DataFrame:
    """The columns of pairs (with a, b), tokens_a, tokens_b, raw, similarity, distance.

    raw is the greatest sum of scores over matches, gaps and one-to-two moves; similarity
    is (raw + longest) / (2 longest) in [0, 1], 1 if both are empty, 0 if one is. A batch's
    segments are compared in one table if there are at most max_segments of them, else pair by pair.
    """
    words = pairs.select(F.col("a").alias("word")).unionByName(pairs.select(F.col("b").alias("word")))
    tokens = tokenized(words, phonology)
    x, y = (tokens.select(F.col("word").alias(f"_{s}"), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
    both = pairs.join(x, F.col("a").eqNullSafe(F.col("_a"))).join(y, F.col("b").eqNullSafe(F.col("_b"))).drop("_a", "_b")

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        segments = Segments(phonology)
        for a, b in batches:
            yield pd.Series(raw_scores(a, b, phonology, segments, max_segments))

    n, m = F.size("tokens_a"), F.size("tokens_b")
    longest = F.greatest(n, m)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("raw") + longest) / (2 * F.greatest(longest, F.lit(1)))))
    similarity = F.when(longest == 0, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(inside)
    return both.withColumn("raw", scored("tokens_a", "tokens_b")).withColumn("similarity", similarity).withColumn("distance", 1 - F.col("similarity"))


def unknown_segments(words: DataFrame, phonology: Phonology = Phonology()) -> DataFrame:
    """word, unknown: the distinct tokens of each distinct word whose base has no features, in their order."""

    @F.pandas_udf("array<string>")
    def unknown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = re.compile("(?s)" + phonology.token_pattern).findall
        known = lru_cache(KNOWN_TOKENS)(lambda t: phonology.features(t) is not None)
        for words in batches:
            yield words.map(lambda w: [t for t in dict.fromkeys(tokens(normalize_ipa(w, phonology.decompose))) if not known(t)])

    return words.select("word").distinct().withColumn("unknown", unknown("word"))


def alignments(pairs: DataFrame, phonology: Phonology = Phonology()) -> DataFrame:
    """The columns of aligned_scores() and alignments: up to max_alignments best ones, each an array of (a, b).

    A gap is "-". The order is that of a depth-first walk from the words' ends, which
    tries a match, a gap in b, a gap in a, one-to-two and two-to-one moves in turn.
    """
    scored = aligned_scores(pairs, phonology)

    @F.pandas_udf("array<array<struct<a:string,b:string>>>")
    def walk(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict = {}
        return pd.Series([[[{"a": x, "b": y} for x, y in path] for path in best_paths(list(x), list(y), phonology, memo)] for x, y in zip(a, b)])

    return scored.withColumn("alignments", walk("tokens_a", "tokens_b"))


def segment_similarity(x: str, y: str, phonology: Phonology, memo: dict) -> float:
    """One minus the distance of two segments, for rows that want single values."""
    if (x, y) not in memo:
        f, g = phonology.features(x), phonology.features(y)
        if x == y:
            memo[x, y] = 1.0
        elif f is None or g is None:
            memo[x, y] = 0.0
        else:
            memo[x, y] = 1 - sum(min(1.0, abs(f[n] - g[n]) / span) * weight for n, (weight, span) in FEATURES.items()) / TOTAL_WEIGHT
    return memo[x, y]


def best_paths(a: list[str], b: list[str], phonology: Phonology, memo: dict) -> list[list[tuple[str, str]]]:
    """The co-optimal alignments of two token lists, in the order of the walk."""
    gap, expansion = phonology.gap_penalty, phonology.expansion_penalty
    sim = lambda x, y: segment_similarity(x, y, phonology, memo)

    def moves(i: int, j: int) -> Iterator[tuple[int, int, float]]:
        if i and j:
            yield 1, 1, 2 * sim(a[i - 1], b[j - 1]) - 1
        if i:
            yield 1, 0, gap
        if j:
            yield 0, 1, gap
        if i and j > 1:
            yield 1, 2, sim(a[i - 1], b[j - 2]) + sim(a[i - 1], b[j - 1]) - 1 + expansion
        if i > 1 and j:
            yield 2, 1, sim(b[j - 1], a[i - 2]) + sim(b[j - 1], a[i - 1]) - 1 + expansion

    best, steps = {(0, 0): 0.0}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                tried = [(best[i - p, j - q] + score, p, q) for p, q, score in moves(i, j)]
                best[i, j] = max(t[0] for t in tried)
                steps[i, j] = [(p, q) for score, p, q in tried if abs(score - best[i, j]) <= 1e-10]
    found, stack = [], [(len(a), len(b), ())]
    while stack and len(found) < phonology.max_alignments:
        i, j, path = stack.pop()
        if not i and not j:
            found.append([p for p in path if phonology.return_gaps or GAP not in p])
            continue
        for p, q in reversed(steps[i, j]):
            pair = ("".join(a[i - p : i]) or GAP, "".join(b[j - q : j]) or GAP)
            stack.append((i - p, j - q, (pair, *path)))
    return found


def explained(pairs: DataFrame, phonology: Phonology = Phonology()) -> DataFrame:
    """a, b, place, seg_a, seg_b, similarity, distance, note, features_a, features_b, unknown_a, unknown_b: a row for each place of the first alignment.

    A gap has similarity 0 and note "gap". The two segments of a one-to-two move are
    compared as one joined segment, of which only the first base counts. Features are
    arrays in the order of FEATURES, null for gaps and unknown bases; unknown_a and
    unknown_b are the words' segments without features.
    """
    first = F.posexplode(F.get("alignments", F.lit(0))).alias("place", "pair")
    each = alignments(pairs, phonology).select("a", "b", first).select("a", "b", "place", F.col("pair.a").alias("seg_a"), F.col("pair.b").alias("seg_b"))

    @F.pandas_udf("struct<similarity:double,features_a:array<double>,features_b:array<double>>")
    def compared(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        memo: dict = {}
        known: dict = {GAP: None}

        def of(segment: str) -> list[float] | None:
            if segment not in known:
                f = phonology.features(segment)
                known[segment] = None if f is None else [float(f[name]) for name in FEATURES]
            return known[segment]

        rows = [(0.0, None, None) if GAP in (p, q) else (segment_similarity(p, q, phonology, memo), of(p), of(q)) for p, q in zip(x, y)]
        return pd.DataFrame(rows, columns=["similarity", "features_a", "features_b"])

    gap = (F.col("seg_a") == GAP) | (F.col("seg_b") == GAP)
    each = each.withColumn("_c", compared("seg_a", "seg_b")).select("a", "b", "place", "seg_a", "seg_b", "_c.similarity", (1 - F.col("_c.similarity")).alias("distance"), F.when(gap, "gap").alias("note"), "_c.features_a", "_c.features_b")
    unknown = unknown_segments(pairs.select(F.col("a").alias("word")).unionByName(pairs.select(F.col("b").alias("word"))), phonology)
    for s in "ab":
        own = unknown.select(F.col("word").alias(f"_{s}"), F.col("unknown").alias(f"unknown_{s}"))
        each = each.join(own, F.col(s).eqNullSafe(F.col(f"_{s}"))).drop(f"_{s}")
    return each

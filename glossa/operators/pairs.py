"""Pairs of distinct words, and the pruned join of those that are alike enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.edit import PHONETIC_PAIRS, graphic_distance, graphic_similarity, phonetic_distance, phonetic_tokens
from glossa.functions.text import fixed3, let, normalize_graphic

# The texts of the explanations.
EXPLAINED = {
    "graphic": {"ru": "Графическая похожесть", "en": "Graphic similarity"},
    "phonetic": {"ru": "Фонетическая похожесть", "en": "Phonetic similarity"},
    "formula": {"ru": "Формула:", "en": "Formula:"},
    "result": {"ru": "Результат", "en": "Result"},
    "fill_graphic": {"ru": "Пожалуйста, заполните оба слова", "en": "Please fill in both words"},
    "fill_phonetic": {"ru": "Пожалуйста, заполните оба слова в МФА", "en": "Please fill in both IPA words"},
}


def distinct_words(df: DataFrame, column: str) -> DataFrame:
    """word: the distinct normalised values that aren't empty. Words repeat far more often than texts, so pairs start here."""
    return df.select(normalize_graphic(F.col(column)).alias("word")).where("word <> ''").distinct()


#: Words up to which one side of all pairs is broadcast.
BROADCAST_WORDS = 100_000


def all_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: every pair of two tables of words, for vocabularies small enough that all pairs are wanted."""
    other = b.select(F.col("word").alias("b"))
    if other.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        other = F.broadcast(other)
    return a.select(F.col("word").alias("a")).join(other, how="cross")


def most_similar(words: DataFrame, k: int) -> DataFrame:
    """a, b, similarity: the k most similar pairs a < b of distinct words, ties in order of the words.

    Pairs are made for as high a similarity as k of them reach; all of them only if no k do.
    """
    for least in (0.8, 0.6, 0.4, 0.2):
        found = similar_pairs(words, words, least).where("a < b").select("a", "b", F.round("similarity", 9).alias("similarity"))
        top = found.orderBy(F.desc("similarity"), "a", "b").limit(k)
        if top.count() == k:
            return top
    found = all_pairs(words, words).where("a < b").withColumn("similarity", F.round(graphic_similarity(F.col("a"), F.col("b")), 9))
    return found.orderBy(F.desc("similarity"), "a", "b").limit(k)


def similar_pairs(a: DataFrame, b: DataFrame, least: float, q: int = 2) -> DataFrame:
    """a, b, distance, similarity of the pairs whose graphic similarity is at least `least`; exact.

    An edit changes at most q of the q-grams with their positions' neighbours, so pairs
    within k edits of words of n letters share a q-gram unless 2kq >= n + q - 1; only pairs
    of words that share one are made, besides words too short for that bound, which meet
    by length. The length ratio and the built-in unit-cost distance, of which a substitution
    costs half at least, prune before the weighted distance is found.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    # d >= lev / 2 and d <= (1 - least) * longest, so at most 2 (1 - least) longest unit edits.
    edits = F.floor(2 * (1 - least) * F.col("n") / least + 1e-9)

    def grams(df: DataFrame, side: str) -> DataFrame:
        words = df.select(F.col("word"), F.length("word").alias("n"))
        padded = F.concat(F.lit("\x01" * (q - 1)), F.col("word"), F.lit("\x02" * (q - 1)))
        each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") + q - 1), lambda i: F.substring(padded, i, F.lit(q))))
        short = edits * q >= F.col("n") + q - 1  # may share no q-gram with a partner
        words = words.withColumns({"short": short, "grams": each})
        return words.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"), F.col("short").alias(f"short_{side}"), F.col("grams").alias(f"grams_{side}"))

    x, y = grams(a, "a"), grams(b, "b")
    by_gram = x.withColumn("g", F.explode("grams_a")).join(y.withColumn("g", F.explode("grams_b")), "g")
    low, high = F.ceil(F.col("n_a") * least - 1e-9), F.floor(F.col("n_a") / least + 1e-9)
    by_size = x.where("short_a").withColumn("size", F.explode(F.sequence(low, high))).join(y.where("short_b").withColumn("size", F.col("n_b")), "size")
    columns = ("a", "b", "n_a", "n_b")
    met = by_gram.select(*columns).unionByName(by_size.select(*columns))
    longest, shortest = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    most = F.floor(2 * (1 - least) * longest + 1e-9).cast("int")
    near = met.where(shortest >= least * longest - 1e-9).distinct().where(F.expr("levenshtein(a, b)") <= most)
    found = let(graphic_distance(F.col("a"), F.col("b")), lambda d: F.struct(d.alias("distance"), (1 - d / longest).alias("similarity")))
    return near.select("a", "b", found.alias("_c")).where(F.col("_c.similarity") >= least).select("a", "b", "_c.distance", "_c.similarity")


def compared(pairs: DataFrame, kind: str = "graphic", lang: str = "ru", a: str = "a", b: str = "b") -> DataFrame:
    """The columns of pairs with similarity, shown (three decimals, or what to fill in) and explanation."""
    text = {k: v[lang] for k, v in EXPLAINED.items()}
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)

    def words(w: Column) -> Column:
        """The words with their units (letters or tokens) and distance."""
        if kind == "graphic":
            distance, sizes = graphic_distance(w["x"], w["y"]), (F.length(w["x"]), F.length(w["y"]))
            return F.struct(w["x"].alias("x"), w["y"].alias("y"), distance.alias("d"), F.least(*sizes).alias("least"), F.greatest(*sizes).alias("most"))
        distance, sizes = phonetic_distance(w["s"], w["t"]), (F.size(w["s"]), F.size(w["t"]))
        return F.struct(*[w[c].alias(c) for c in "xyst"], distance.alias("d"), F.least(*sizes).alias("least"), F.greatest(*sizes).alias("most"))

    def shown(w: Column) -> Column:
        similarity = F.when(w["least"] > 0, 1 - w["d"] / w["most"])
        lines = [F.lit(text[kind]), F.lit(""), F.lit(text["formula"])]
        if kind == "graphic":
            lines += [F.lit("1 − (Levenshtein distance / max length)"), F.lit(""), line("Word A", w["x"]), line("Word B", w["y"]), F.lit("")]
            lines += [line("Levenshtein distance", number(w["d"])), line("Max length", w["most"].cast("string"))]
        else:
            lines += [F.lit("1 − (Psycho-Levenshtein / max token length)"), F.lit(""), line("IPA A", w["x"]), line("IPA B", w["y"])]
            lines += [line("Tokens A", F.array_join(w["s"], " ")), line("Tokens B", F.array_join(w["t"], " ")), F.lit(""), F.lit("Similar sounds used:")]
            lines += [F.lit(", ".join(f"{p} ↔ {q}" for p, q in PHONETIC_PAIRS)), F.lit(""), line("Distance", number(w["d"]))]
        lines += [F.lit(""), F.lit(text["result"] + ":")]
        return let(
            F.struct(similarity.alias("s"), F.concat_ws("\n", *lines).alias("lines")),
            lambda r: F.struct(
                r["s"].alias("similarity"),
                F.coalesce(fixed3(r["s"]), F.lit(text[f"fill_{kind}"])).alias("shown"),
                F.when(r["s"].isNotNull(), F.concat(r["lines"], F.lit("\n"), fixed3(r["s"]), F.lit("\n"))).alias("explanation"),
            ),
        )

    x, y = normalize_graphic(F.coalesce(F.col(a), F.lit(""))), normalize_graphic(F.coalesce(F.col(b), F.lit("")))
    tokens = [] if kind == "graphic" else [phonetic_tokens(x).alias("s"), phonetic_tokens(y).alias("t")]
    found = let(let(F.struct(x.alias("x"), y.alias("y"), *tokens), words), shown)
    return pairs.withColumn("_c", found).select(*[pairs[c] for c in pairs.columns], "_c.similarity", "_c.shown", "_c.explanation")

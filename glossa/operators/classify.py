"""Semantic distance of two meanings and the class of a word, record by record as one select."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.semantic import combined, embedding_distance, jaccard, parse_manual_response
from glossa.functions.text import js_trim, normalize_text

URL, MODEL = "http://localhost:11434", "qwen3-embedding"
FAR = 0.5

# The reasons, by language.
REASONS = {
    "regular": ("Слово по регулярной модели не заполнено.", "Regular-model word is missing."),
    "logical": ("Логический анализ компонентов не заполнен.", "Logical component analysis is missing."),
    "international": ("Международное значение эквивалентного деривата не заполнено.", "International meaning of equivalent derivative is missing."),
    "naturalistic": ("Слово по натуралистической модели не заполнено.", "Naturalistic-model word is missing."),
    "components": ("Компонентный анализ не добавлен.", "No component analysis added."),
    "same": (
        "Логическое значение совпадает с международным значением. Различение не требуется.",
        "Logical meaning matches international meaning. Distinction is not required.",
    ),
    "differs": ("Логическое значение отличается от международного значения.", "Logical meaning differs from international meaning."),
    "provided": ("Слово по натуралистической модели задано.", "Naturalistic model word is provided."),
    "no_form": (
        "Логическое значение отличается от международного значения, но натуралистическая форма отсутствует.",
        "Logical meaning differs from international meaning, but naturalistic form is missing.",
    ),
    "unavailable": (
        "Локальная модель недоступна. Использован только расчёт по правилам.",
        "Local model unavailable. Used only Rule-based calculation.",
    ),
}
#: A provider gives the records' embeddings: columns text, model, vector for the columns text, model.
Provider = Callable[[DataFrame], DataFrame]


def analysis_records(df: DataFrame) -> DataFrame:
    """Records with all strings trimmed; url and model default where they are null; the rest becomes empty."""
    trimmed = {c: js_trim(F.coalesce(F.col(c), F.lit(""))) for c in ("regular_word", "logical_meaning", "international_meaning", "naturalistic_word", "manual_response")}
    trimmed |= {"ollama_url": F.coalesce(js_trim(F.col("ollama_url")), F.lit(URL)), "embedding_model": F.coalesce(js_trim(F.col("embedding_model")), F.lit(MODEL))}
    return df.withColumns(trimmed | {"use_llm": F.coalesce("use_llm", F.lit(False))})


def precomputed(embeddings: DataFrame) -> Provider:
    """The provider of a table text, model, vector that is there already."""
    return lambda wanted: wanted.join(embeddings, ["text", "model"])


def semantic_distances(records: DataFrame, provider: Provider | None = None, lang: str = "ru") -> DataFrame:
    """The columns of records and method, rule, manual, embedding, final, error.

    A pasted answer with a number wins; else without use_llm the rule alone; else the
    embeddings of both meanings, or the rule alone where one is missing. Only the distinct
    meanings of records that need embeddings are asked of the provider.
    """
    found = records.withColumns({"rule": jaccard(F.col("logical_meaning"), F.col("international_meaning")), "manual": parse_manual_response(F.col("manual_response"))})
    pasted = F.coalesce(~F.col("manual.error"), F.lit(False))
    asks = ~pasted & F.col("use_llm")
    found = found.withColumn("_model", F.coalesce(F.nullif("embedding_model", F.lit("")), F.lit(MODEL)))
    if provider is not None:
        needed = found.where(asks).select(F.explode(F.array("logical_meaning", "international_meaning")).alias("text"), F.col("_model").alias("model")).distinct()
        vectors = provider(needed).select("text", "model", "vector")
        for side, column in (("_u", "logical_meaning"), ("_v", "international_meaning")):
            own = vectors.select(F.col("text").alias(f"{side}t"), F.col("model").alias(f"{side}m"), F.col("vector").alias(side))
            found = found.join(own, (found[column] == own[f"{side}t"]) & (found["_model"] == own[f"{side}m"]), "left").drop(f"{side}t", f"{side}m")
        embedded = F.when(asks, embedding_distance(F.col("_u"), F.col("_v")))
    else:
        embedded = F.lit(None).cast("struct<similarity_raw:double,similarity:double,distance:double>")
    found = found.withColumn("embedding", embedded)
    method = F.when(pasted, "rule_plus_manual_embedding").when(~asks, "rule_only").when(F.col("embedding").isNotNull(), "rule_plus_embedding").otherwise("rule_fallback")
    other = F.when(pasted, F.col("manual.distance")).otherwise(F.col("embedding.distance"))
    found = found.withColumns({"method": method, "final": combined(F.col("rule.distance"), other)})
    error = F.when(F.col("method") == "rule_fallback", REASONS["unavailable"][lang == "en"])
    return found.withColumn("error", error).drop("_model", "_u", "_v")


def classified(records: DataFrame, provider: Provider | None = None, lang: str = "ru") -> DataFrame:
    """The columns of semantic_distances() with classification, confidence and reasons.

    Records without a regular word or one of the meanings are insufficient: their
    method, distances and error are null.
    """
    found = semantic_distances(analysis_records(records), provider, lang)
    say = lambda key: F.lit(REASONS[key][lang == "en"])
    blank = lambda c: F.col(c) == ""
    enough = ~(blank("regular_word") | blank("logical_meaning") | blank("international_meaning"))
    same = normalize_text(F.col("logical_meaning")) == normalize_text(F.col("international_meaning"))
    natural, far = ~blank("naturalistic_word"), F.col("final.distance") >= FAR
    no_parts = F.coalesce(F.size("components"), F.lit(0)) <= 0
    kind = F.when(~enough, "insufficient_data").when(same, "regular_only").when(natural, "double_meaning_with_modification").otherwise("double_meaning_modification_missing")
    sure = F.when(~enough, "low").when(same, "high").when(natural, F.when(far, "high").otherwise("medium")).otherwise(F.when(far, "medium").otherwise("low"))

    def reason(when: Column, key: str) -> Column:
        return F.when(when, say(key))

    reasons = F.array_compact(
        F.array(
            reason(blank("regular_word"), "regular"),
            reason(blank("logical_meaning"), "logical"),
            reason(blank("international_meaning"), "international"),
            reason(blank("naturalistic_word"), "naturalistic"),
            reason(no_parts, "components"),
            reason(enough & same, "same"),
            reason(enough & ~same & natural, "differs"),
            reason(enough & ~same & natural, "provided"),
            reason(enough & ~same & ~natural, "no_form"),
        )
    )
    kept = {c: F.when(enough, F.col(c)) for c in ("method", "rule", "manual", "embedding", "final", "error")}
    return found.withColumns({"classification": kind, "confidence": sure, "reasons": reasons} | kept)

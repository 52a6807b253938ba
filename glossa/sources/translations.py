"""Texts in several languages: the first that a chain of languages has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAIN = ("ru",)


def translated(rows: DataFrame, texts: DataFrame, lang: str, chain: Sequence[str] = CHAIN, key_col: str = "key", shown_col: str = "shown", source_col: str | None = None) -> DataFrame:
    """rows with shown_col: the text of its key in `lang`, else in the first language of the chain that has one, else the key itself.

    texts: key, lang, text, a row for each key and language; blank and null texts count as
    missing, and of rows that repeat a key and a language the smallest text is taken. Keys
    without any text show themselves, null keys nothing. source_col, if named, gets the
    language shown (null for a key). Only languages asked for are shuffled, and each key
    has one row before it is joined.
    """
    order = list(dict.fromkeys([lang, *chain]))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("lang"))
    ranked = texts.where(F.col("lang").isin(order) & (F.trim("text") != "")).select(F.col("key").alias("_key"), F.struct(rank.alias("rank"), "text", "lang").alias("_t"))
    best = ranked.groupBy("_key").agg(F.min("_t").alias("_best"))
    found = rows.join(best, rows[key_col] == best["_key"], "left")
    shown = {shown_col: F.coalesce(F.col("_best.text"), F.col(key_col))}
    if source_col:
        shown[source_col] = F.col("_best.lang")
    return found.select(*[rows[c] for c in rows.columns if c not in shown], *[v.alias(c) for c, v in shown.items()])

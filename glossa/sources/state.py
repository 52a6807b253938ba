"""Saved sessions as JSON documents, and form states in links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import base64url, from_base64url
from glossa.operators.classify import MODEL, URL
from glossa.operators.components import COMPONENT, FIELDS, migrated

# A document's keys and the columns they stand for.
KEYS = {
    "regularWord": "regular_word", "logicalMeaning": "logical_meaning", "internationalMeaning": "international_meaning", "naturalisticWord": "naturalistic_word",
    "components": "components", "useLLM": "use_llm", "ollamaUrl": "ollama_url", "ollamaModel": "embedding_model", "manualPrompt": "manual_prompt",
    "manualEmbeddingResponse": "manual_response", "resultHtml": "result_html", "resultIsEmpty": "result_is_empty",
}
COMPONENT_KEYS = dict(zip(("id", "type", "label", "form", "meaning", "assimilation", "sourceId", "category", "baseForm", "assimilationNoteRaw"), FIELDS))


def saved(records: DataFrame) -> Column:
    """The JSON document of a record with the columns of KEYS; columns that aren't there are left out."""
    parts = lambda c: F.struct(*[c[f].alias(k) for k, f in COMPONENT_KEYS.items()])
    value = lambda c: F.transform(c, parts) if c == "components" else F.col(c)
    return F.to_json(F.struct(*[value(c).alias(k) for k, c in KEYS.items() if c in records.columns]))


def restored(sessions: DataFrame, column: str) -> DataFrame:
    """Records of JSON documents: defaults for what is missing, components migrated; rows that aren't JSON objects go."""
    component = ", ".join(f"{k}: string" for k in (*COMPONENT_KEYS, "assimilationNote"))
    kinds = {"components": f"array<struct<{component}>>", "useLLM": "boolean", "resultIsEmpty": "boolean"}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in KEYS) + ", _bad string"
    read = sessions.withColumn("_s", F.from_json(column, schema, {"columnNameOfCorruptRecord": "_bad"}))
    read = read.where(F.col("_s").isNotNull() & F.col("_s._bad").isNull() & F.trim(column).startswith("{"))
    note = lambda c: F.coalesce(F.nullif(c["assimilationNoteRaw"], F.lit("")), c["assimilationNote"])
    parts = F.transform("_s.components", lambda c: F.struct(*[(note(c) if f == "assimilation_note" else c[k]).alias(f) for k, f in COMPONENT_KEYS.items()]))
    parts = migrated(F.coalesce(parts, F.array().cast(f"array<{COMPONENT}>")))
    default = {"ollama_url": URL, "embedding_model": MODEL}
    text = lambda k, c: F.coalesce(F.nullif(F.col(f"_s.{k}"), F.lit("")), F.lit(default.get(c, "")))
    columns = {c: parts if c == "components" else F.coalesce(F.col(f"_s.{k}"), F.lit(False)) if k in kinds else text(k, c) for k, c in KEYS.items()}
    return read.withColumns(columns).drop("_s")


def link_state(entries: Column) -> Column:
    """A form's array of struct(key, value) as the text that links carry; a checked box, of value null, is the number 1."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    pair = lambda e: F.concat(F.lit("["), quoted(e["key"]), F.lit(","), F.when(e["value"].isNull(), "1").otherwise(quoted(e["value"])), F.lit("]"))
    return base64url(F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: pair(e)), ","), F.lit("]")))


def from_link_state(encoded: Column) -> Column:
    """The array of struct(key, value) of a link's text; empty where it can't be read. The number 1 comes back as "1"."""
    pairs = F.from_json(from_base64url(encoded), "array<array<string>>")
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return F.coalesce(F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value"))), empty)

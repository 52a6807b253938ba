"""The test tables as inputs of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.alignment import tokenized
from glossa.operators.pairs import all_pairs, distinct_words
from glossa.sources import lexicon

N_COMPONENTS, N_RULES, N_VARIANTS = (len(t.splitlines()) for t in (lexicon.COMPONENTS, lexicon.ASSIMILATIONS, lexicon.PREFIX_VARIANTS))
#: No component of the lexicon has more.
MOST_LETTERS = 12


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word: the distinct names of parts, some dozens at any scale."""
    return distinct_words(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = part_words(spark, sf_dir)
    return all_pairs(words, words)


def letter_words(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """word: the distinct runs of a to z in a table's whole texts, in lower case."""
    texts = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


def affix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, stem, n: how many of the documents' words begin (pre) and end (suf) with a stem of up to MOST_LETTERS letters, or are it (whole)."""
    size = F.least(F.length("word"), F.lit(MOST_LETTERS))
    part = lambda side, stem: F.struct(F.lit(side).alias("side"), stem.alias("stem"))
    begin = F.transform(F.sequence(F.lit(1), size), lambda i: part("pre", F.substring("word", F.lit(1), i)))
    end = F.transform(F.sequence(F.lit(1), size), lambda i: part("suf", F.substring("word", F.length("word") - i + 1, i)))
    each = letter_words(spark, sf_dir).select(F.explode(F.concat(begin, end, F.array(part("whole", F.col("word"))))).alias("x"))
    return each.groupBy("x.side", "x.stem").agg(F.count("*").alias("n_words"))


def side_of(form):
    """The side and the stem of a form such as re-, -er or al."""
    side = F.when(form.startswith("-"), "suf").when(form.endswith("-"), "pre").otherwise("whole")
    return side.alias("side"), F.replace(form, F.lit("-"), F.lit("")).alias("stem")


def counted(rows: DataFrame, form: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows with n_words: how many of the documents' words have the form."""
    side, stem = side_of(F.col(form))
    return rows.withColumns({"side": side, "stem": stem}).join(affix_counts(spark, sf_dir), ["side", "stem"], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0))).drop("side", "stem")


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, n_words: how many of the documents' words have the segment."""
    tokens = tokenized(letter_words(spark, sf_dir))
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n_words"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, asked, answered: each user turn with the next turn of its conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered"))
    return asked.join(answered, ["conv_id", "turn"])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis records of the meanings: fields left out by turn number, so that every class occurs."""
    k = F.col("conv_id") % 7
    none = F.array().cast("array<struct<id:string,form:string>>")
    return meanings(spark, sf_dir).select(
        "conv_id", "turn",
        F.when(k == 0, "").otherwise("re/vis/ion").alias("regular_word"),
        F.col("asked").alias("logical_meaning"),
        F.when(k == 1, F.concat(F.lit("  "), F.col("asked"), F.lit(" "))).when(k == 2, None).otherwise(F.col("answered")).alias("international_meaning"),
        F.when(k >= 4, "re/vis/ion/u").alias("naturalistic_word"),
        F.when(k == 5, none).otherwise(F.array(F.struct(F.lit("x").alias("id"), F.lit("re").alias("form")))).alias("components"),
        (k == 6).alias("use_llm"), F.lit(None).cast("string").alias("ollama_url"), F.lit(None).cast("string").alias("embedding_model"),
        F.when(k == 3, F.concat(F.lit("distance: "), (F.col("turn") % 10).cast("string"), F.lit("0"))).alias("manual_response"),
    )


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, a, b: each vector with that of the next id."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select("vec_id", F.col("embedding").alias("a")).join(vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")

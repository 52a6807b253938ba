"""The training-data pipeline: quality, lines, near-duplicates, contamination, packing.

Each stage is a function of (spark, docs, sf_dir) whose result is written and read again
as the next one's docs; all but the last return the columns of documents. As it is
written by then, a stage deletes the intermediate tables of those before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import decontam, lines, minhash, packing, quality
from glossa.llm.shared import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: list[Scratch] = []  # of earlier stages


def _stage(of: Stage) -> Stage:
    @wraps(of)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        for earlier in list(_tables):
            if earlier.spark is not spark:  # a session that has ended
                _tables.remove(earlier)
            elif not any(earlier.name in f for f in files):
                earlier.close()
                _tables.remove(earlier)
        before = len(Scratch.made)
        made = of(spark, docs, sf_dir)
        _tables.extend(Scratch.made[before:])
        return made

    return run


def _with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels)).select(*COLUMNS)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; documents left without a line go."""
    return _with_size(lines.dedup_lines(docs))


@_stage
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.dedup_documents(docs).select(*COLUMNS)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]

#: Co-training and packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs

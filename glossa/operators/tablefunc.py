"""Alignments as rows in SQL: a table function of the session, joined laterally."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from glossa.operators.alignment import best_paths
from glossa.sources.phonology import Phonology, normalize_ipa

ROWS = "nth int, place int, seg_a string, seg_b string"


def alignment_rows(phonology: Phonology = Phonology()):
    """A table function of two words: a row for each of their best alignments and each place in it, both from 0."""
    pattern = re.compile(phonology.token_pattern, re.S)

    @udtf(returnType=ROWS)
    class Aligned:
        def __init__(self):
            self.memo: dict = {}

        def eval(self, a: str, b: str):
            x, y = ([m[1] for m in pattern.finditer(normalize_ipa(word, phonology.decompose))] for word in (a, b))
            for nth, path in enumerate(best_paths(x, y, phonology, self.memo)):
                for place, (p, q) in enumerate(path):
                    yield nth, place, p, q

    return Aligned


def register(spark: SparkSession, name: str = "align_words", phonology: Phonology = Phonology()) -> None:
    """From now on `SELECT ... FROM pairs, LATERAL align_words(a, b)` works in the session's SQL. Null words are empty ones."""
    spark.udtf.register(name, alignment_rows(phonology))

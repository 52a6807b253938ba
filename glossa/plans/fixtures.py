"""Small inputs of queries for which the test tables have nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESPONSES = [
    (1, '{"distance":0.38,"similarity":0.62,"reason":"x"}'), (2, '{"distance":0.38}'), (3, '{"similarity":"0.5"}'), (4, "similarity: 62"), (5, "85"),
    (6, "distance 1.5"), (7, "no number"), (8, "  "), (9, None), (10, "Схожесть = 0.4"), (11, "дистанцию: 30"), (12, '{"distance":1,"similarity":0.5}'), (13, "distance -2"), (14, "about 500"),
]
PARTS = [
    ("u1", "root", "root", "vider", "видеть", "none", None, None, None, None),
    ("u2", "root", "root", "seder", "сидеть", "exc-seder", None, None, None, None),
    ("u3", "component", "Приставки", "im-", "x", None, "pre-in", "Приставки", "in-", "перед p и m"),
    ("suf-er", "component", "old", "-er", "y", None, None, None, None, None),
    ("u5", "component", "Прочее", "-zz", "z", None, "gone", None, None, None),
]
CHOICES = [("pre-in", "il-"), ("pre-in", None), ("pre-in", "zz-"), ("suf-er", None), ("pre-re", None), ("gone", None), (None, None)]
ROOTS = [("seder", "", "exc-seder"), (" vider ", " видеть ", "none"), ("vider", "", "none"), ("", "x", "add-t"), ("ceder", "", "exc-ceder"), (None, None, None)]


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)

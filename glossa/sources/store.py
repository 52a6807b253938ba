"""A store of saved documents by key in which the last write wins.

A store is a folder of generations, each written whole before a small file names it:
readers see the generations that are named, so that a write that fails leaves the old
state. Writes append a generation; compaction writes one with the last version of each
key and then names it as the new beginning. All files are written by Spark or through its
file system, so the folder may be anywhere that it reaches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = "generation long, base boolean, folder string"


class Store:
    """Documents (key, document) under a path; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _named(self) -> list:
        """The generations in force, oldest first: the last base and what came after it."""
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/names")
        if not files.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
            return []
        rows = self.spark.read.schema(_NAMES).json(f"{self.path}/names/*/part-*").collect()  # one a write since the last compactions
        rows.sort(key=lambda r: r.generation)
        start = max((i for i, r in enumerate(rows) if r.base), default=0)
        return rows[start:]

    def _add(self, documents: DataFrame, generation: int, base: bool) -> None:
        folder = f"{generation}-{uuid.uuid4().hex}"
        documents.write.parquet(f"{self.path}/data/{folder}")
        # Until this is there, the folder above belongs to nothing.
        self.spark.createDataFrame([(generation, base, folder)], _NAMES).coalesce(1).write.json(f"{self.path}/names/{folder}")

    def write(self, documents: DataFrame, key_col: str = "key", document_col: str = "document") -> None:
        """Writes documents; of rows that repeat a key the largest document stays. A null document deletes its key; null keys are left out."""
        named = self._named()
        rows = documents.select(F.col(key_col).cast("string").alias("key"), F.col(document_col).cast("string").alias("document")).where("key is not null")
        # max() skips nulls: a key is deleted by a write that has nothing else for it.
        self._add(rows.groupBy("key").agg(F.max("document").alias("document")), named[-1].generation + 1 if named else 0, not named)

    def _last(self, named: list) -> DataFrame:
        if not named:
            return self.spark.createDataFrame([], "key string, document string")
        every = None
        for r in named:
            rows = self.spark.read.schema("key string, document string").parquet(f"{self.path}/data/{r.folder}").withColumn("generation", F.lit(r.generation))
            every = rows if every is None else every.unionByName(rows)
        if len(named) > 1:
            # In a struct, as max_by would skip the null document of a deletion.
            every = every.groupBy("key").agg(F.max_by(F.struct("document"), "generation").alias("last")).select("key", "last.document")
        return every.select("key", "document").where("document is not null")

    def read(self) -> DataFrame:
        """key, document: the last version of each key that isn't deleted. A store that isn't there yet is empty."""
        return self._last(self._named())

    def compact(self) -> None:
        """Makes the state one generation. Older folders stay for readers that have begun; drop_old() removes them."""
        named = self._named()
        if len(named) > 1:
            self._add(self._last(named), named[-1].generation + 1, True)

    def drop_old(self) -> int:
        """Removes what no reader that begins now can see, failed writes included; how many folders went. Not while a write runs."""
        jvm, kept = self.spark.sparkContext._jvm, {r.folder for r in self._named()}
        gone = 0
        # Names first: a folder without a name belongs to nothing, a name without its folder would break readers.
        for kind in ("names", "data"):
            top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            if files.exists(top):
                for status in files.listStatus(top):
                    if status.getPath().getName() not in kept:
                        files.delete(status.getPath(), True)
                        gone += kind == "data"
        return gone

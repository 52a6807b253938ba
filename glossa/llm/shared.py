"""What the operators of this subpackage share: tables in the cluster's shared folder, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
BROADCAST_KEYS = 400_000
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a new local one if driver and executors are one process, as in
    tests; on a cluster others wouldn't see its files, and so it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", master := spark.sparkContext.master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="glossa-")
    return _own_dirs[app]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor, as the stage that made it
    isn't needed again. drop() deletes tables that no later read needs, close() all of them.
    """

    #: Those that haven't been closed, in the order in which they were made.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        self.name = uuid.uuid4().hex
        self.root = f"{shared_dir(spark)}/glossa/{self.name}"
        self.n = 0
        Scratch.made.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._glossa_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._glossa_path)

    def close(self) -> None:
        """Deletes all tables: what is read later may depend on none of them."""
        self._delete(self.root)
        if self in Scratch.made:
            Scratch.made.remove(self)
        free_shuffles(self.spark)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, with which the shuffle files of finished queries go: Spark keeps them until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few(keys: DataFrame) -> DataFrame:
    """A saved table of one long a row, broadcast in its next join if it is a few megabytes at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b (orderable ids; rows with null or a = b are ignored, repeats
    and both directions are allowed). Returns node, component: one row per node that
    has an edge, component being the smallest node reachable. Each step is a
    pre-aggregated minimum per node and a join that AQE may split, so a node with
    very many edges never has to fit into one task. No edges: no rows.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u moves to u's smallest neighbour.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large)
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        moved = scratch.save(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(now, large)
        now = moved
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each u of edges (u > v) has one v, which has none itself: then v is u's component."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    return roles.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups > 1 or ups = 1 and downs = 1").isEmpty()


def merged_components(joined: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """joined (node, component) with further links a, b between or outside its components.

    Only the graph of the components that the new links touch is searched.
    """
    placed = more
    for side in ("a", "b"):
        own = joined.select(F.col("node").alias(f"n{side}"), F.col("component").alias(f"c{side}"))
        placed = placed.join(own, placed[side] == own[f"n{side}"], "left")
    placed = scratch.save(placed.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    top = components(placed.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch).select(F.col("node").alias("t"), F.col("component").alias("c"))
    ends = placed.select(F.col("a").alias("node"), F.col("ca").alias("component")).unionByName(placed.select(F.col("b").alias("node"), F.col("cb").alias("component")))
    every = joined.unionByName(ends.distinct().join(joined.select("node"), "node", "left_anti"))
    return scratch.save(every.join(top, every["component"] == top["t"], "left").select("node", F.coalesce("c", "component").alias("component")))

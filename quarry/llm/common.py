"""Shared storage, small helpers and connected components for the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words of the 'space' contracts: what lies between these six characters.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


#: Rows and bytes that go to a Python worker at once; texts can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "250", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and reread: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished steps, which it does when the driver's JVM collects garbage.

    No variable may hold a frame of those steps. A plan is still referenced for a moment after its job, so one
    collection finds nothing: a second one follows.
    """
    gc.collect()
    for pause in (0.5, 0.5):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as make it none of df's columns (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def at_most(df: DataFrame, bound: int) -> bool:
    """Whether df has at most bound rows; reads no more than bound + 1 of them."""
    return df.limit(bound + 1).count() <= bound


def small(df: DataFrame, bound: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most bound rows; else unchanged (a shuffle join)."""
    return F.broadcast(df) if at_most(df, bound) else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of an edge (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps; hubs are handled by partial aggregation and splittable joins,
    and each round is checkpointed in the shared folder. Null ends and loops are ignored. Rounds go on until nothing
    changes; their number grows with the logarithm of the longest chain.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct().checkpoint()
    while True:
        # Settled when no node is both a root and below one.
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("s")), F.struct(F.col("b").alias("n"), F.lit(2).alias("s")))).alias("x"))
        held = e.groupBy("b").count().filter("count > 1").select(F.col("b").alias("n")).unionByName(ends.select("x.*").groupBy("n").agg(F.bit_or("s").alias("s")).filter("s = 3").select("n"))
        if held.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        e = (
            large.join(low, "b")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a < b")
            .distinct()
            .checkpoint()
        )
    nodes = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

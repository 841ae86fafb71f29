"""Intermediate tables: written once, read by every later step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Local sessions without that setting get a folder of their own; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as zstd Parquet, under `path` or a new one, and reread: not computed anew for each reader, survives lost executors."""
    path = path or work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bound: int = 500_000) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most bound rows (of few, short columns); else unchanged (a shuffle join)."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df

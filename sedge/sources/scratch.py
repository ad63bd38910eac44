"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder (tests, a single machine).
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path there, deleted when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    path = f"{base.rstrip('/')}/sedge-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df as a table that cuts its lineage; the files go when the application ends. wide: of rows so large that a batch of
    them must not grow beyond small row groups."""
    path = fresh_path(df.sparkSession, name)
    out = df.write
    if wide:
        out = out.option("parquet.block.size", str(16 << 20)).option("parquet.page.size.row.check.min", "4")
    out.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # tells a written frame from a plan over one
    return out

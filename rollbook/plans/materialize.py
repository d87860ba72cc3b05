"""Materialize an intermediate result as a Parquet table in the shared
checkpoint folder (``spark.checkpoint.dir``) and read it back.

This cuts lineage like ``checkpoint()`` but computes the plan once (an
eager RDD checkpoint runs it a second time to write it) and stores columnar,
compressed data that later scans can prune and filter.  ``clear_scratch``
removes what a session has written once its results are out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from rollbook.session import checkpoint_dir

_WRITTEN: list[str] = []  # paths of this driver process, for clear_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For a write whose rows are read from its files alone from then on: Spark
    drops its shuffle files when it ends.  Else they stay until the driver
    happens to collect its garbage, those of all steps of a job side by side."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str = "t", compression: str | None = None) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.mode("errorifexists").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables written so far by this driver; to be called
    when no DataFrame built on them is needed any more.  Returns their number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n

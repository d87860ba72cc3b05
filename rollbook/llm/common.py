"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollbook.plans.materialize import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The column's text; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back:
    cuts the lineage, survives lost executors, and is computed once however
    often it is read."""
    return materialize(df, f"llm-{label}")


def known(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by the keys of a join, whose size Spark then knows before
    it chooses the join.  A guess is too low after an explode, and for tables
    that compress well; what it broadcasts lies whole in the driver's memory."""
    return df.repartition(*keys)


def spread(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))



class Bounded(dict):
    """A cache of ``make(key)`` that is emptied when it holds ``most`` keys."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def small_batches(spark: SparkSession) -> None:
    """From now on in this session Arrow batches hold at most 1,000 rows and
    8 MB.  Batches of texts lie outside the heap, several at a time for each
    task, so the defaults (10,000 rows, 64 MB) take more memory than a task's
    share."""
    for key, most, unit in (("maxRecordsPerBatch", 1000, ""), ("maxBytesPerBatch", 8 << 20, "b")):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name)
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(name, f"{most}{unit}")

"""Key translation user_id -> role-table id (one join instead of a lookup per request)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def role_key(role_table: DataFrame, key: str, user_id: int | None = None,
             requests: DataFrame | None = None, request_col: str = "user_id") -> DataFrame:
    """``(user_id, <key>)`` with one row per user: the smallest role id when a
    user has several rows (the application takes the first row it gets).

    ``user_id`` filters to one user; ``requests`` narrows the role table to
    the users a batch names (semi join) before aggregating, so a small batch
    does not aggregate the whole table.  Aggregation is partial (map-side),
    so a user with many rows never lands whole in one task.
    """
    t = role_table.select("user_id", key)
    if user_id is not None:
        t = t.where(F.col("user_id") == F.lit(user_id))
    if requests is not None:
        ids = requests.select(F.col(request_col).alias("user_id")).where(F.col("user_id").isNotNull()).distinct()
        t = t.join(ids, "user_id", "left_semi")
    return t.groupBy("user_id").agg(F.min(key).alias(key))


def left_join_nullable(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """``left`` left-joined with ``right`` on ``key``, the rows whose key is
    NULL dealt out by ``by``: they match nothing, yet would all be shuffled
    to one task."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(1024)))
    return (left.withColumn("_spread", F.coalesce(spread, F.lit(-1).cast("long")))
            .join(right.withColumn("_spread", F.when(F.col(key).isNull(), F.lit(-2)).otherwise(F.lit(-1)).cast("long")), [key, "_spread"], "left")
            .drop("_spread"))


def only_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Restrict ``df`` to the given keys without fan-out (left semi join)."""
    return df.join(keys.select(key), key, "left_semi")

"""Connected components of a table of links, by alternating stars.

Each round hooks every node's larger neighbours, then its smaller ones, to its
smallest neighbour; it ends when all that is left are stars around their
smallest nodes.  Links stay in tables; only the answer to that question comes
to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.llm.common import known, stored

SALTS = 8


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` with ``m`` of their ``u``.  The links of one node, which can be
    a third of all, are dealt over ``SALTS`` tasks."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(known(salted, "u", "salt"), ["u", "salt"]).drop("salt")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, _least(both)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    hooked = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _is_flat(links: DataFrame) -> bool:
    """No node has two smaller neighbours, or a smaller and a larger one."""
    ends = (links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, c) of every node of ``links`` (a, b), dealt out by id: c is the
    smallest id of its component.  Null ends and loops are left out; no links, no rows."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while not _is_flat(now):
        now = stored(_small_star(_large_star(now)), "stars")
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("c")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("c")).distinct())
    return known(labels, "id")

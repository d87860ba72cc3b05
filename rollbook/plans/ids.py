"""Dense id assignment for inserted rows, without a single-partition step.

New ids continue after the table's current maximum, in the order of the
given columns (normally the request ``seq``), the way identity columns
number rows inserted one after another.

Plan: write the rows to number once (the range partitioner samples its input,
so they would be computed twice), range-partition by the order columns, sort
within partitions, tag every row with its partition and position, and write
that once (so the tags are pinned and lineage is cut).  Rows per partition
are counted, and a row's id is its position plus the rows in the partitions
before it.  Those offsets are a prefix sum over one row per partition, taken
level by level over blocks of ``BLOCK`` partitions and joined on the partition
number: nothing per partition reaches the driver or the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.plans.materialize import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
BLOCK = 1024  # partitions whose counts are summed up in one group
_LEVELS = 4  # blocks of blocks; covers BLOCK ** 4 partitions


def current_max(df: DataFrame, column: str) -> int:
    """The largest value of ``column`` (0 for an empty table): one scalar."""
    v = df.agg(F.max(column)).first()[0]
    return int(v) if v is not None else 0


def current_maxes(tables: dict[str, tuple[DataFrame, str]]) -> dict[str, int]:
    """``current_max`` of several tables in one job (one row per table)."""
    parts = [df.agg(F.max(c).cast("long").alias("m")).select(F.lit(name).alias("t"), "m")
             for name, (df, c) in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return {r["t"]: int(r["m"]) if r["m"] is not None else 0 for r in union.collect()}


def _tag(df: DataFrame, order_cols: list[str]) -> DataFrame:
    ordered = materialize(df, "rows").repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    return materialize(ordered.withColumn("_part", F.spark_partition_id())
                              .withColumn("_mono", F.monotonically_increasing_id()), "ids")


def prefix_sums(counts: DataFrame, groups: list[str]) -> DataFrame:
    """``counts`` (groups..., _part, _n) with ``_before``: the sum of ``_n`` of
    the same group's smaller ``_part``s."""
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = counts.withColumn("_before", F.lit(0).cast("long"))
    level, width, at = counts, 1, "_part"
    for _ in range(_LEVELS):
        # Within a block: the running total of the units before this one.
        block = level.withColumn("_block", F.floor(F.col(at) / BLOCK).cast("long"))
        running = F.sum("_n").over(Window.partitionBy(*groups, "_block").orderBy(at)) - F.col("_n")
        ahead = block.select(*groups, F.col(at).alias("_unit"), running.alias("_ahead"))
        out = (out.withColumn("_unit", F.floor(F.col("_part") / width).cast("long")).join(ahead, [*groups, "_unit"])
               .withColumn("_before", F.col("_before") + F.col("_ahead")).drop("_unit", "_ahead"))
        width *= BLOCK
        if partitions <= width:
            break
        level, at = block.groupBy(*groups, "_block").agg(F.sum("_n").alias("_n")).withColumnRenamed("_block", "_at"), "_at"
    return out


def number_rows(df: DataFrame, order_cols: list[str], id_col: str, start: int) -> DataFrame:
    """Add ``id_col`` = start + 1-based rank of the row in ``order_cols`` order."""
    tagged = _tag(df, order_cols)
    offsets = prefix_sums(tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), []).select("_part", "_before")
    local = F.col("_mono") - F.shiftleft(F.col("_part").cast("long"), _ROW_BITS)
    return (tagged.join(offsets, "_part").withColumn(id_col, F.lit(start).cast("long") + F.col("_before") + local + 1)
                  .drop("_part", "_mono", "_before"))


def number_rows_by_group(df: DataFrame, group_col: str, order_cols: list[str], id_col: str,
                         starts: dict) -> DataFrame:
    """Number rows within each group: ``id_col`` = starts[group] + 1-based
    rank of the row among its group's rows in ``order_cols`` order.

    One range shuffle over (group, order) serves every group; offsets have
    one row per (partition, group) that occurs.  ``starts`` becomes part of
    the plan, so it holds a few groups (absent ones start at 0).
    """
    tagged = _tag(df, [group_col, *order_cols])
    stats = tagged.groupBy("_part", group_col).agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    offsets = prefix_sums(stats.select(group_col, "_part", "_n"), [group_col]).select(group_col, "_part", "_before")
    lookup = stats.select(group_col, "_part", "_first").join(offsets, [group_col, "_part"])
    start = F.lit(0).cast("long")
    for g, n in starts.items():
        start = F.when(F.col(group_col) == F.lit(g), F.lit(int(n)).cast("long")).otherwise(start)
    return (tagged.join(lookup, ["_part", group_col])
                  .withColumn(id_col, start + F.col("_before") + (F.col("_mono") - F.col("_first")) + 1)
                  .drop("_part", "_mono", "_before", "_first"))


def _in_ranges(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` dealt out by ranges of (group, order), with its partition in ``_part``."""
    ranged = materialize(df, "rows").repartitionByRange(group, *order)
    return materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group up to
    and with this one, in the given order (NULL first; ties in any order).

    A group may be any part of all rows: its rows are summed up within range
    partitions, and the sums of the partitions before, one row each, are added.
    """
    rows = _in_ranges(df, group, order)
    totals = rows.groupBy(group, "_part").agg(F.sum(value).cast("long").alias("_n"))
    before = prefix_sums(totals, [group]).select(group, "_part", "_before")
    local = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_local", F.sum(value).over(local)).join(before, [group, "_part"])
            .withColumn(out, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before"))


def running_last(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the last ``value`` that is not NULL among the rows of the
    same group before this one, in the given order (NULL first); dealt out like
    ``running_sum``, with the last value of each partition carried on."""
    rows = _in_ranges(df, group, order)
    local = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition that a group reaches into.
    ends = rows.groupBy(group, "_part").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v")))).alias("_end"))
    carried = ends.select(group, "_part", F.last("_end._v", ignorenulls=True).over(
        Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    return (rows.withColumn("_local", F.last(value, ignorenulls=True).over(local)).join(carried, [group, "_part"])
            .withColumn(out, F.coalesce("_local", "_carried")).drop("_part", "_local", "_carried"))

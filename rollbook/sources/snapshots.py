"""Tables kept as versions of hash partitions, so that a batch of changes reads
and writes the partitions it touches and carries the others over.

A row's partition is the hash of its key, modulo the number of partitions.  A
table's folder holds ``data/<write>/part=<n>``, one folder a write, and
``versions/v=<n>``: one small Parquet file that says which writes make up each
partition of that version.  This list is at most one row a partition and write,
and is all that the driver reads.  Data are only ever added, in a folder of
their own; a version exists once its list is written, and writing the list of
a version that exists already fails.  So a failed or repeated job leaves the
current version as it was, and of two writers that start from one version the
later one gets an error.

* ``rewrite`` replaces partitions, ``rewrite_groups`` likewise, one group of them
  after the other, ``append`` adds rows to them without reading
  them, ``compact`` rewrites those that many writes have added to.
* ``open_snapshot`` reads the newest version, or an older one.

Choose ``parts`` so that a partition holds some 100 MB to 1 GB; keys are unique
or nearly so, and their hashes spread evenly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.plans.batches import key_filtered
from rollbook.plans.materialize import shuffles_dropped
from rollbook.schema import TABLES
from rollbook.sources.io import conform

#: A batch that touches more than so many bytes is applied in groups of partitions, so many at most:
#: what is shuffled for one group is off the disk before the next.  Each group reads the batch once.
GROUP_BYTES, GROUPS = 1 << 30, 2

LIST = "part int, write string, name string, key string, parts int"


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """One version of a table."""

    spark: SparkSession
    path: str
    name: str
    key: str
    parts: int
    version: int
    held: dict[int, list[str]]  # partition -> its writes

    def read(self, parts: Iterable[int] | None = None) -> DataFrame:
        """The rows of all partitions, or of those given."""
        schema = TABLES[self.name]
        asked = self.held if parts is None else {p: self.held[p] for p in parts if p in self.held}
        paths = [f"{self.path}/data/{w}/part={p}" for p, writes in sorted(asked.items()) for w in writes]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The partitions in which the rows' keys lie, if they exist."""
        found = rows.where(F.col(self.key).isNotNull()).select(part_of(self.key, self.parts).alias("part")).distinct().collect()
        return sorted(r["part"] for r in found if r["part"] in self.held)

    def parts_with(self, keys: DataFrame, column: str) -> list[int]:
        """The partitions that hold a row whose ``column`` is among ``keys``:
        one scan of that column and the key."""
        wanted = keys.select(column)
        return self.parts_of(key_filtered(self.read().select(*{self.key, column}), [column], wanted).join(wanted, column, "left_semi"))

    def difference(self, older: Snapshot) -> tuple[DataFrame, DataFrame]:
        """``(added, gone)``: the rows of the writes that this version has and
        ``older`` has not, and the other way round.  Rows of a rewritten
        partition that stayed as they were are in both."""
        return tuple(Snapshot(self.spark, self.path, self.name, self.key, self.parts, self.version, {
            p: kept for p, writes in a.held.items() if (kept := [w for w in writes if w not in b.held.get(p, [])])}).read()
            for a, b in ((self, older), (older, self)))

    def _write(self, rows: DataFrame | None, tasks: int, stay: DataFrame | None = None) -> tuple[str, list[int]]:
        write = f"{self.version + 1:08d}-{uuid.uuid4().hex}"
        folder = f"{self.path}/data/{write}"
        # Rows of one partition meet in one task, so that it gets one file a write.  Rows that stay lie
        # together as they are read: a file for each part of a file that a task has read.
        placed = [None if df is None else conform(df, self.name).withColumn("part", part_of(self.key, self.parts)) for df in (rows, stay)]
        if placed[0] is not None:
            placed[0] = placed[0].repartition(max(tasks, 1), "part")
        with shuffles_dropped(self.spark):
            (reduce(DataFrame.unionByName, [df for df in placed if df is not None])
             .write.mode("errorifexists").partitionBy("part").parquet(folder, compression="zstd"))
        # From the folder names; no file is read.
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        names = [s.getPath().getName() for s in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
        return write, sorted(int(n.removeprefix("part=")) for n in names if n.startswith("part="))

    def _commit(self, held: dict[int, list[str]]) -> Snapshot:
        new = Snapshot(self.spark, self.path, self.name, self.key, self.parts, self.version + 1, held)
        rows = [(p, w, self.name, self.key, self.parts) for p, writes in sorted(held.items()) for w in writes]
        rows.append((None, None, self.name, self.key, self.parts))  # an empty table has a list, too
        self.spark.createDataFrame(rows, LIST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/v={new.version}")
        return new

    def rewrite(self, parts: Iterable[int], rows: DataFrame | None, stay: DataFrame | None = None) -> Snapshot:
        """The version in which ``rows`` take the place of the given partitions,
        and beside them ``stay``: rows just read from these partitions, and only
        filtered, which are written without a shuffle.  All must have their keys
        in these partitions; there is an error if one has not."""
        parts = set(parts)
        if not parts:
            return self
        write, written = self._write(rows, len(parts), stay)
        if not set(written) <= parts:
            raise ValueError(f"rows of partitions that are not rewritten: {sorted(set(written) - parts)[:5]}")
        held = {p: w for p, w in self.held.items() if p not in parts}
        return self._commit(held | {p: [write] for p in written})

    def groups(self, parts: Iterable[int]) -> list[list[int]]:
        """The given partitions as one group, or as up to ``GROUPS`` if their files hold more than ``GROUP_BYTES``."""
        parts = sorted(parts)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{w}/part={p}") for p in parts for w in self.held.get(p, [])]
        held = sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)
        n = max(1, min(GROUPS, len(parts), -(-held // GROUP_BYTES)))
        return [parts[i::n] for i in range(n)]

    def rewrite_groups(self, groups: list[list[int]], rows: Callable[[list[int]], DataFrame]) -> Snapshot:
        """The version in which ``rows(group)`` takes the place of each group of
        partitions; written group by group, committed as one."""
        held = dict(self.held)
        for group in filter(None, groups):
            write, written = self._write(rows(group), len(group))
            if not set(written) <= set(group):
                raise ValueError(f"rows of partitions that are not rewritten: {sorted(set(written) - set(group))[:5]}")
            held = {p: w for p, w in held.items() if p not in group} | {p: [write] for p in written}
        return self if held == self.held else self._commit(held)

    def append(self, rows: DataFrame) -> Snapshot:
        """The version with further rows; no old row is read."""
        write, written = self._write(rows, self.parts)
        if not written:
            return self
        return self._commit(self.held | {p: [*self.held.get(p, []), write] for p in written})

    def compact(self, most: int = 8) -> Snapshot:
        """Partitions of more than ``most`` writes become one write."""
        worn = [p for p, writes in self.held.items() if len(writes) > most]
        return self.rewrite(worn, self.read(worn))


def create_snapshot(rows: DataFrame, path: str, name: str, key: str, parts: int) -> Snapshot:
    """Write a table as version 1 below ``path``."""
    empty = Snapshot(rows.sparkSession, path.rstrip("/"), name, key, parts, 0, {})
    write, written = empty._write(rows, parts)
    return empty._commit({p: [write] for p in written})


def open_snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest version of the table below ``path``, or the given one."""
    path = path.rstrip("/")
    if version is None:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
        names = [s.getPath() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
        done = [p for p in names if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        version = max(int(p.getName().removeprefix("v=")) for p in done)
    rows = spark.read.schema(LIST).parquet(f"{path}/versions/v={version}").collect()
    held: dict[int, list[str]] = {}
    for r in sorted((r for r in rows if r["part"] is not None), key=lambda r: (r["part"], r["write"])):
        held.setdefault(r["part"], []).append(r["write"])
    return Snapshot(spark, path, rows[0]["name"], rows[0]["key"], rows[0]["parts"], version, held)

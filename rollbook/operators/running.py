"""Counts and sums kept up to date across versions of stored tables.

Each of the counts behind Q7, Q10, Q11 and Q13 is a sum of what every row
contributes to its group.  So after a batch it is the old sum, plus what the
rows of new writes contribute, less what the rows of replaced writes did:
``Snapshot.difference`` names these, and rows of partitions that no change has
touched are not read.  Sums are of whole numbers and decimals, so the result
equals a new count exactly.  ``n_rows`` counts a group's rows; a group whose
last row goes leaves the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import money
from rollbook.schema import ATTENDANCE_ABSENT, ATTENDANCE_EXCUSED, ATTENDANCE_PRESENT, FEE_PAID, FEE_PENDING, FEE_UNPAID
from rollbook.sources.snapshots import Snapshot


@dataclass(frozen=True)
class Running:
    key: str
    parts: dict[str, Callable[[], Column]]  # what a row adds to each column

    def of(self, rows: DataFrame) -> DataFrame:
        """The sums over ``rows``: one row a group (NULL is one group)."""
        return self._signed(rows, 1)

    def _signed(self, rows: DataFrame, sign: int) -> DataFrame:
        # A hash aggregate with fixed-width buffers, combined map-side.
        sums = [F.sum(part() * sign).alias(name) for name, part in self.parts.items()]
        return rows.groupBy(self.key).agg(F.sum(F.lit(sign).cast("long")).alias("n_rows"), *sums)

    def after(self, stored: DataFrame, old: Snapshot, new: Snapshot, only: Callable[[DataFrame, Snapshot], DataFrame] | None = None) -> DataFrame:
        """``stored``, the sums of version ``old``, brought to version ``new``.
        ``only(rows, version)`` restricts both versions' rows to those that count."""
        added, gone = new.difference(old)
        if only is not None:
            added, gone = only(added, new), only(gone, old)
        both = stored.unionByName(self._signed(added, 1)).unionByName(self._signed(gone, -1))
        names = ["n_rows", *self.parts]
        types = dict(stored.dtypes)
        return (both.groupBy(self.key).agg(*[F.sum(c).cast(types[c]).alias(c) for c in names]).where(F.col("n_rows") != 0))


def _one(condition: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.when(condition(), 1).otherwise(0).cast("long")


def _amount(status: str | None = None) -> Callable[[], Column]:
    amount = lambda: F.coalesce(money("amount"), F.lit(0).cast("decimal(18,2)"))
    return amount if status is None else lambda: F.when(F.col("payment_status") == status, amount()).otherwise(F.lit(0).cast("decimal(18,2)"))


#: A1, A2: enrolled students of a course.
ENROLLED = Running("course_id", {"enrolled_students": _one(lambda: F.col("student_id").isNotNull())})

#: A3: a student's classes by status.
CLASSES = Running("student_id", {"total_classes": _one(lambda: F.col("attendance_id").isNotNull()), **{
    c: _one(lambda s=s: F.col("attendance_id").isNotNull() & (F.col("status") == s))
    for c, s in (("present", ATTENDANCE_PRESENT), ("absent", ATTENDANCE_ABSENT), ("excused", ATTENDANCE_EXCUSED))}})

#: A4: a student's fees by status.
FEES = Running("student_id", {"total": _amount(), "paid": _amount(FEE_PAID), "pending": _amount(FEE_PENDING), "unpaid": _amount(FEE_UNPAID)})

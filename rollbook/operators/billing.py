"""Fees: per-fee detail and per-student statistics (exact decimal sums)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import money_out, money_sum, pct
from rollbook.operators.keys import only_keys, role_key
from rollbook.schema import FEE_PAID, FEE_PENDING, FEE_UNPAID


def _students(students: DataFrame, user_id: int | None) -> DataFrame:
    """The student ids the answer covers (user id translated, smallest first)."""
    if user_id is None:
        return students.select("student_id")
    return role_key(students, "student_id", user_id).select("student_id")


def fee_detail(students: DataFrame, fees: DataFrame, user_id: int | None = None) -> DataFrame:
    """Q9: every fee of an existing student."""
    f = only_keys(fees, _students(students, user_id), "student_id")
    return f.select("student_id", F.col("fee_id").alias("id"), "amount", "payment_status",
                    "payment_date")


def fee_stats(students: DataFrame, fees: DataFrame | None, user_id: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Q10: per student the total, paid, pending and unpaid sums and the paid
    percentage.  Sums are exact (decimal), NULL amounts add nothing, and a
    student without fees gets zeros.  With ``counts`` (``running.FEES``) no fee
    is read.
    """
    st = F.col("payment_status")
    if counts is not None:
        per = counts
    else:
        if user_id is not None:  # before the sums
            fees = only_keys(fees, _students(students, user_id), "student_id")
        per = fees.groupBy("student_id").agg(
            money_sum("amount").alias("total"),
            money_sum("amount", st == FEE_PAID).alias("paid"),
            money_sum("amount", st == FEE_PENDING).alias("pending"),
            money_sum("amount", st == FEE_UNPAID).alias("unpaid"))
    out = _students(students, user_id).join(per, "student_id", "left").select(
        "student_id", money_out("total").alias("total_fees"), money_out("paid").alias("paid_fees"),
        money_out("pending").alias("pending_fees"), money_out("unpaid").alias("unpaid_fees"))
    return out.withColumn("paid_percentage", pct("paid_fees", "total_fees"))

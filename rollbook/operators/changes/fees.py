"""Fee payments (C11)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import date_lit
from rollbook.operators.keys import role_key
from rollbook.plans.batches import first_claim, reason_of, split, wanted
from rollbook.schema import (
    FEE_PAID, MSG_FEE_ALREADY_PAID, MSG_FEE_NOT_FOUND, MSG_STUDENT_NOT_FOUND,
)
from rollbook.sources.io import conform


def pay_fees(fees: DataFrame, students: DataFrame, batch: DataFrame, as_of: dt.date
             ) -> tuple[DataFrame, DataFrame]:
    """C11: ``batch(seq, user_id, fee_id)``.

    Checks in order: the user has a Students row; the fee exists and is the
    student's; the fee is not paid yet -- neither before the batch (a NULL
    status counts as not paid) nor by an earlier accepted request in it.
    Accepted fees become paid on ``as_of``.  Returns (fees, rejects).
    """
    r = batch.join(role_key(students, "student_id", requests=batch), "user_id", "left")
    owner = fees.join(wanted(batch, ["fee_id"]), "fee_id", "left_semi").select(
        "fee_id", F.col("student_id").alias("owner_id"), F.col("payment_status").alias("status_before"))
    r = r.join(owner, "fee_id", "left")
    no_student = F.col("student_id").isNull()
    not_theirs = ~F.coalesce(F.col("owner_id") == F.col("student_id"), F.lit(False))
    paid_before = F.col("status_before").eqNullSafe(F.lit(FEE_PAID))
    r = first_claim(r, ["fee_id"], ~no_student & ~not_theirs & ~paid_before)
    annotated = r.withColumn("reason", reason_of([
        (no_student, MSG_STUDENT_NOT_FOUND),
        (not_theirs, MSG_FEE_NOT_FOUND),
        (paid_before | (F.col("seq") > F.col("first_seq")), MSG_FEE_ALREADY_PAID),
    ]))
    ok, rejects = split(annotated, pin=False)
    paid_now = ok.select("fee_id").distinct().withColumn("paid_now", F.lit(True))
    f = fees.join(paid_now, "fee_id", "left")
    now = F.col("paid_now").isNotNull()
    out = f.select("fee_id", "student_id", "amount",
                   F.when(now, F.lit(FEE_PAID)).otherwise(F.col("payment_status")).alias("payment_status"),
                   F.when(now, date_lit(as_of)).otherwise(F.col("payment_date")).alias("payment_date"))
    return conform(out, "fees"), rejects

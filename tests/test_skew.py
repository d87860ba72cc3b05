"""Hot keys: one key holds a third of all rows.  Joins are forced to
shuffle (no broadcast) and AQE is told to split skewed partitions
aggressively; results must equal a brute-force computation."""

import datetime as dt

import pandas as pd
import pytest
from conftest import table

from rollbook.operators import changes, learning
from rollbook.plans.inspect import physical_plan

AS_OF = dt.datetime(2025, 1, 15, 9, 30)
N = 3000


@pytest.fixture()
def skewed(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_fee_first_payment_wins(skewed):
    spark = skewed
    students = table(spark, "students", [{"student_id": s, "user_id": 100 + s} for s in range(50)])
    fees = table(spark, "fees", [{"fee_id": f, "student_id": f % 50, "amount": 1.0, "payment_status": "unpaid"}
                                 for f in range(200)])
    # A third of all requests pay fee 0 (owned by student 0); the rest spread out.
    reqs = [(i, 100, 0) if i % 3 == 0 else (i, 100 + (i % 200) % 50, i % 200) for i in range(N)]
    batch = spark.createDataFrame(reqs, "seq long, user_id long, fee_id long")
    new, rejects = changes.pay_fees(fees, students, batch, AS_OF.date())
    rej = {r["seq"]: r["reason"] for r in rejects.collect()}
    # brute force: requests in seq order against the evolving state
    paid, expect = set(), {}
    for seq, user, fee in sorted(reqs):
        if fee in paid:
            expect[seq] = "Fee is already paid"
        else:
            paid.add(fee)
    assert rej == expect
    assert {r["fee_id"] for r in new.where("payment_status = 'paid'").collect()} == paid
    assert "Window" not in physical_plan(rejects)


def test_hot_student_attendance_stats(skewed):
    spark = skewed
    statuses = ["present", "absent", "excused", "late"]
    rows = [{"attendance_id": i, "student_id": 0 if i % 3 == 0 else i % 97, "course_id": i % 7,
             "status": statuses[i % 4]} for i in range(N)]
    attendance = table(spark, "attendance", rows)
    students = table(spark, "students", [{"student_id": s, "user_id": s + 1000} for s in range(100)])
    courses = table(spark, "courses", [{"course_id": c} for c in range(6)])   # course 6 unknown
    got = {r["student_id"]: r for r in learning.attendance_stats(students, attendance, courses).collect()}
    df = pd.DataFrame(rows)
    df = df[df.course_id < 6]
    for s in range(100):
        part = df[df.student_id == s]
        total, present = len(part), int((part.status == "present").sum())
        assert got[s]["total_classes"] == total
        assert got[s]["present"] == present
        assert got[s]["present_percentage"] == (present / total * 100 if total else 0.0)


def test_hot_domain_id_claims(skewed):
    spark = skewed
    users = table(spark, "users", [{"user_id": 1, "domain_id": "taken", "role": "student"}])
    empty = {n: table(spark, n, []) for n in ("students", "teachers", "management")}
    reqs = []
    for i in range(N):
        dom = "hot" if i % 3 == 0 else ("taken" if i % 11 == 0 else f"d{i % 400}")
        roll = None if i in (0, 3) else f"R{i}"      # the first two hot claims lack a roll number
        reqs.append((i, dom, "pw", "student", "n", "e", None, None, None, roll))
    batch = spark.createDataFrame(reqs, "seq long, domain_id string, password string, role string, name string, "
                                        "email string, phone_number string, department string, address string, "
                                        "roll_number string")
    out, rejects = changes.create_users(users, empty["students"], empty["teachers"], empty["management"],
                                        batch, AS_OF)
    rej = {r["seq"]: r["reason"] for r in rejects.collect()}
    taken, expect, created = {"taken"}, {}, []
    for seq, dom, *_, roll in reqs:
        if dom in taken:
            expect[seq] = "User already exists"
        elif roll is None:
            expect[seq] = "Roll number is required for students"
        else:
            taken.add(dom)
            created.append((seq, dom))
    assert rej == expect
    new = {r["domain_id"]: r["user_id"] for r in out["users"].collect() if r["user_id"] > 1}
    assert new == {dom: 1 + k + 1 for k, (_, dom) in enumerate(created)}


def test_null_keys_are_dealt_out(spark):
    """A third of a million requests without a key do not meet in one task."""
    from pyspark.sql import functions as F
    from rollbook.operators.keys import left_join_nullable
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(1_000_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 != 0, F.col("id") % 1000).alias("k"))
        right = spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("v")).unionByName(
            spark.createDataFrame([(None, 7)], "k long, v long"))
        out = left_join_nullable(left, right, "k", "seq")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1_000_000 and max(sizes) < 2 * sum(sizes) / len(sizes)
        assert out.where("v is not null").count() == left.where("k < 500").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])

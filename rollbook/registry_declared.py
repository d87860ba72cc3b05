"""Registered queries for the routes declared without a body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators import billing, changes, declared, learning, running
from rollbook.operators.keys import only_keys
from rollbook.plans.materialize import scratch_path
from rollbook.registry_changes import AS_OF, batch_attendance, batch_pay_fees
from rollbook.sources.snapshots import create_snapshot
from rollbook.sources.campus import driver_table, load_driver, pin, student_user, unknown_user


def batch_enroll(spark, sf_dir) -> DataFrame:
    """One enrollment request per order: F orders ask for a course the
    customer already has (the order's smallest part), others for a course
    derived from the order's key; LOW priority orders come from non-students."""
    o = driver_table(spark, sf_dir, "orders")
    li = driver_table(spark, sf_dir, "lineitem")
    first_part = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("first_part"))
    j = o.join(first_part, "o_orderkey", "left")
    return j.select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") == "5-LOW", unknown_user(F.col("o_custkey")))
         .otherwise(student_user(F.col("o_custkey"))).alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("first_part"))
         .otherwise(F.floor(F.col("o_orderkey") / 30)).alias("course_id"))


def _d2(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return declared.enroll(c.enrollments, c.students, c.courses, pin(batch_enroll(spark, sf_dir)), AS_OF)


def _d2_filtered(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return declared.enroll(c.enrollments, c.students, c.courses, pin(batch_enroll(spark, sf_dir)), AS_OF, filter_from=0)


def _d2_stored(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    old = create_snapshot(c.enrollments, scratch_path(spark, "stored-enrollments"), "enrollments", "course_id", 16)
    return declared.stored_enroll(old, c.students, c.courses, pin(batch_enroll(spark, sf_dir)), AS_OF)


def d01_available_course_counts(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return declared.available_course_counts(c.students, c.courses, c.enrollments)


def d01_available_courses_set(spark, sf_dir):
    """The courses that the students of one segment and nation can still take."""
    c = load_driver(spark, sf_dir)
    asked = driver_table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 7))
    return declared.available_courses_of(asked.select(F.col("c_custkey").alias("student_id")), c.courses, c.enrollments)


def _enrolled_since(spark, sf_dir):
    """The counts of enrolled students, kept up to date over the enroll batch."""
    c = load_driver(spark, sf_dir)
    old = create_snapshot(c.enrollments, scratch_path(spark, "stored-enrollments"), "enrollments", "course_id", 16)
    new, _ = declared.stored_enroll(old, c.students, c.courses, pin(batch_enroll(spark, sf_dir)), AS_OF)
    return c, running.ENROLLED.after(pin(running.ENROLLED.of(old.read())), old, new)


def q11_teacher_course_load_running(spark, sf_dir):
    c, counts = _enrolled_since(spark, sf_dir)
    return learning.teacher_course_load(c.teachers, c.courses, None, counts=counts)


def q13_course_catalog_running(spark, sf_dir):
    c, counts = _enrolled_since(spark, sf_dir)
    return learning.course_catalog(c.courses, c.teachers, None, counts=counts)


def q07_attendance_stats_running(spark, sf_dir):
    """Attendance statistics kept up to date over the attendance batch."""
    c = load_driver(spark, sf_dir)
    requests, records = batch_attendance(c, spark, sf_dir)
    old = create_snapshot(c.attendance, scratch_path(spark, "stored-attendance"), "attendance", "attendance_id", 16)
    new, _ = changes.stored_take_attendance(old, c.teachers, c.courses, requests, records, AS_OF)
    known = lambda rows, _: only_keys(rows, c.courses, "course_id")
    return learning.attendance_stats(c.students, None, None, counts=running.CLASSES.after(pin(running.CLASSES.of(known(old.read(), old))), old, new, known))


def q10_fee_stats_running(spark, sf_dir):
    """Fee statistics kept up to date over the payments."""
    c = load_driver(spark, sf_dir)
    old = create_snapshot(c.fees, scratch_path(spark, "stored-fees"), "fees", "fee_id", 16)
    new, _ = changes.stored_pay_fees(old, c.students, batch_pay_fees(spark, sf_dir), AS_OF.date())
    return billing.fee_stats(c.students, None, counts=running.FEES.after(pin(running.FEES.of(old.read())), old, new))


def d03_course_assignments(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return declared.course_assignments(c.assignments, c.courses)


def d04_course_attendance(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return declared.course_attendance(c.attendance, c.courses)


def d05_student_progress(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return declared.student_progress(c.enrollments, c.assignments, c.grades, c.attendance)


DECLARED = {
    "d01_available_course_counts": d01_available_course_counts,
    "d01_available_courses_set": d01_available_courses_set,
    "d02_enroll_key_filter": lambda s, d: _d2_filtered(s, d)[0],
    "d02_enroll_stored": lambda s, d: _d2_stored(s, d)[0].read(),
    "q07_attendance_stats_running": q07_attendance_stats_running,
    "q10_fee_stats_running": q10_fee_stats_running,
    "q11_teacher_course_load_running": q11_teacher_course_load_running,
    "q13_course_catalog_running": q13_course_catalog_running,
    "d02_enroll": lambda s, d: _d2(s, d)[0],
    "d02_enroll_rejects": lambda s, d: _d2(s, d)[1],
    "d03_course_assignments": d03_course_assignments,
    "d04_course_attendance": d04_course_attendance,
    "d05_student_progress": d05_student_progress,
}

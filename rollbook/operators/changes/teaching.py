"""Teacher-side change batches: grades (C7), attendance (C8),
assignments (C9) and notices (C10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import blank_to_null, date_lit, present_num, present_str, ts_ntz
from rollbook.operators.access import course_access_check, grade_access_check
from rollbook.plans.batches import reason_of, split
from rollbook.plans.deferred import Deferred, once
from rollbook.plans.ids import current_max, number_rows
from rollbook.plans.materialize import materialize
from rollbook.schema import (
    MARKS, MSG_ASSIGNMENT_DATE, MSG_ASSIGNMENT_FIELDS, MSG_ASSIGNMENT_PERMISSION, MSG_ATTENDANCE_PERMISSION,
    MSG_GRADE_REQUIRED, MSG_NOTICE_FIELDS, MSG_RECORDS_REQUIRED,
)
from rollbook.sources.io import conform


def _ts(as_of: dt.datetime):
    return ts_ntz(as_of)


def update_grades(grades: DataFrame, teachers: DataFrame, assignments: DataFrame,
                  courses: DataFrame, batch: DataFrame, as_of: dt.datetime
                  ) -> tuple[DataFrame, DataFrame]:
    """``batch(seq, teacher_user_id, grade_id, grade, feedback)``.

    Checks: a grade is given; the teacher exists; the grade belongs to one
    of the teacher's courses.  Accepted requests set grade, feedback ('' when
    absent) and graded_at; of several for one grade the highest seq wins.
    Returns (grades, rejects).
    """
    checked = grade_access_check(batch, teachers, grades, assignments, courses)
    annotated = checked.withColumn("reason", F.coalesce(
        reason_of([(~present_str("grade"), MSG_GRADE_REQUIRED)]), F.col("reason")))
    # Not written in between: the checks' join on the grade, the latest request of each grade and the
    # join with the grades then share one partitioning.
    ok, rejects = split(annotated, pin=False)
    latest = ok.groupBy("grade_id").agg(
        F.max(F.struct("seq", "grade", F.coalesce(blank_to_null("feedback"), F.lit("")).alias("feedback")))
         .alias("u"))
    g = grades.join(latest, "grade_id", "left")
    changed = F.col("u").isNotNull()
    out = g.select(
        "grade_id", "student_id", "assignment_id",
        F.when(changed, F.col("u.grade")).otherwise(F.col("grade")).alias("grade"),
        F.when(changed, F.col("u.feedback")).otherwise(F.col("feedback")).alias("feedback"),
        "submitted_at",
        F.when(changed, _ts(as_of)).otherwise(F.col("graded_at")).alias("graded_at"))
    return conform(out, "grades"), rejects


def nested_attendance(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``batch(seq, teacher_user_id, course_id, records array<struct<student_id, status>>)``
    into requests ``(seq, teacher_user_id, course_id, records_given)`` and
    flat records ``(seq, record_pos, student_id, status)``."""
    requests = batch.select("seq", "teacher_user_id", "course_id",
                            F.col("records").isNotNull().alias("records_given"))
    records = (batch.select("seq", F.posexplode("records").alias("record_pos", "r"))
                    .select("seq", "record_pos", "r.student_id", "r.status"))
    return requests, records


def take_attendance(attendance: DataFrame, teachers: DataFrame, courses: DataFrame,
                    requests: DataFrame, records: DataFrame, as_of: dt.datetime,
                    last_id: DataFrame | None = None) -> tuple[Deferred, DataFrame]:
    """One attendance row per record of each accepted request, dated ``as_of``.

    ``requests(seq, teacher_user_id, course_id, records_given)`` and flat
    ``records(seq, record_pos, student_id, status)`` (records are kept flat so
    that a request with a huge roster is never one row).  Checks: records given;
    teacher exists; teacher teaches the course.  No check on students or
    status values; a request is all-or-nothing.  New attendance ids follow
    the table's maximum in (seq, record_pos) order, records without a position
    by student and status (``last_id`` may name another frame to take that
    maximum from).  Returns ({attendance}, rejects); the rejects alone read no
    record.
    """
    checked = course_access_check(requests, teachers, courses, MSG_ATTENDANCE_PERMISSION)
    annotated = checked.withColumn("reason", F.coalesce(
        reason_of([(~F.col("records_given"), MSG_RECORDS_REQUIRED)]), F.col("reason")))
    ok, rejects = split(annotated, pin=False)
    order = ["seq", *(["record_pos"] if "record_pos" in records.columns else []), "student_id", "status"]

    def table() -> DataFrame:
        rows = records.join(ok.select("seq", "course_id"), "seq").select("course_id", *order)
        base = current_max(attendance if last_id is None else last_id, "attendance_id")
        new = number_rows(rows, order, "attendance_id", base).select(
            "attendance_id", "student_id", "course_id",
            date_lit(as_of).alias("attendance_date"), "status")
        return attendance.unionByName(conform(new, "attendance"))

    return Deferred({"attendance": table}), rejects


def create_assignments(assignments: DataFrame, teachers: DataFrame, courses: DataFrame,
                       batch: DataFrame, as_of: dt.datetime, last_id: DataFrame | None = None) -> tuple[Deferred, DataFrame]:
    """``batch(seq, teacher_user_id, course_id, title, description, due_date, total_marks)``.

    Checks: title and non-zero total marks given; teacher exists; teacher
    teaches the course; a given due date is a date.  Returns ({assignments,
    created}, rejects); created has ``id, title, description, due_date,
    total_marks``.
    """
    checked = course_access_check(batch, teachers, courses, MSG_ASSIGNMENT_PERMISSION)
    due = F.when(present_str("due_date"), F.try_to_date(F.col("due_date")))
    annotated = checked.withColumn("reason", F.coalesce(
        reason_of([(~(present_str("title") & present_num("total_marks")), MSG_ASSIGNMENT_FIELDS)]),
        F.col("reason"), F.when(present_str("due_date") & due.isNull(), MSG_ASSIGNMENT_DATE)))
    ok, rejects = split(annotated)

    @once
    def new() -> DataFrame:
        base = current_max(assignments if last_id is None else last_id, "assignment_id")
        return conform(number_rows(ok, ["seq"], "assignment_id", base).select(
            "assignment_id", "course_id", "title",
            blank_to_null("description").alias("description"),
            due.alias("due_date"),
            F.col("total_marks").cast(MARKS).alias("total_marks"),
            _ts(as_of).alias("created_at")), "assignments")

    return Deferred({
        "assignments": lambda: assignments.unionByName(new()),
        "created": lambda: new().select(F.col("assignment_id").alias("id"), "title", "description", "due_date", "total_marks"),
    }), rejects


def post_notices(notices: DataFrame, batch: DataFrame, as_of: dt.datetime, last_id: DataFrame | None = None
                 ) -> tuple[Deferred, DataFrame]:
    """``batch(seq, user_id, title, content)``; title and content required.

    No check on the author.  Every accepted request becomes one notice, also
    where ``seq`` is null or repeated (null first, equal ones in any order).
    Returns ({notices, created}, rejects); ``created`` has ``id, title,
    content, created_at``.  Only the ``seq`` numbers and a tag of each row are
    sorted; the texts join their ids by the tag.
    """
    annotated = batch.withColumn("reason", reason_of(
        [(~(present_str("title") & present_str("content")), MSG_NOTICE_FIELDS)]))
    ok, rejects = split(annotated, pin=False)   # a projection of the batch: nothing to settle

    @once
    def new() -> DataFrame:
        # Written once: the tag must be the same for the texts and for the numbers.
        rows = materialize(ok.withColumn("_tag", F.monotonically_increasing_id()), "notices")
        base = current_max(notices if last_id is None else last_id, "notice_id")
        ids = number_rows(rows.select("seq", "_tag"), ["seq", "_tag"], "notice_id", base).drop("seq")
        return conform(rows.join(ids, "_tag").select(
            "notice_id", "title", "content", F.col("user_id").alias("posted_by_user_id"),
            _ts(as_of).alias("created_at")), "notices")

    return Deferred({
        "notices": lambda: notices.unionByName(new()),
        "created": lambda: new().select(F.col("notice_id").alias("id"), "title", "content", "created_at"),
    }), rejects

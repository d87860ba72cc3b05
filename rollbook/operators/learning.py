"""Course, enrollment, grade and attendance reads (set-based, every entity at once).

Every ``user_id`` / ``course_id`` / ``teacher_id`` argument is an optional
equality filter; without it the operator answers for all entities.
Aggregations run on the fact table first and are joined to the entity
table afterwards, so no fact row is ever multiplied by a join before it is
counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import contains_any, count_if_eq, number_text, one_decimal, pct, where_all
from rollbook.operators.keys import left_join_nullable, only_keys, role_key
from rollbook.operators.search import candidates, narrowed
from rollbook.schema import (
    ATTENDANCE_ABSENT, ATTENDANCE_EXCUSED, ATTENDANCE_PRESENT, SHOW_NO_FEEDBACK,
    SHOW_NO_PROGRESS, SHOW_NO_TEACHER, SHOW_NOT_GRADED,
)


def _for_student(facts: DataFrame, students: DataFrame, user_id: int | None) -> DataFrame:
    if user_id is None:
        return facts
    return only_keys(facts, role_key(students, "student_id", user_id), "student_id")


def enrollment_counts(enrollments: DataFrame) -> DataFrame:
    """``(course_id, enrolled_students)``: non-NULL student ids per course."""
    return enrollments.groupBy("course_id").agg(F.count("student_id").alias("enrolled_students"))


def student_courses(students: DataFrame, enrollments: DataFrame, courses: DataFrame,
                    user_id: int | None = None) -> DataFrame:
    """Q4: the courses each student is enrolled in, with progress and status."""
    e = _for_student(enrollments, students, user_id)
    c = courses.select(F.col("course_id"), F.col("course_name").alias("name"),
                       F.col("course_code").alias("code"), "description")
    return (e.join(c, "course_id")
             .select("student_id", F.col("course_id").alias("id"), "name", "code", "description",
                     "progress", F.col("enrollment_status").alias("status")))


def student_grades(students: DataFrame, grades: DataFrame, assignments: DataFrame,
                   courses: DataFrame, user_id: int | None = None) -> DataFrame:
    """Q5: grades with assignment title and course name/code."""
    g = _for_student(grades, students, user_id)
    a = assignments.select("assignment_id", "course_id", F.col("title").alias("assignment_title"))
    c = courses.select("course_id", "course_name", "course_code")
    return (g.join(a, "assignment_id").join(c, "course_id")
             .select("student_id", F.col("grade_id").alias("id"), "grade", "feedback", "submitted_at",
                     "assignment_title", "course_name", "course_code"))


def student_attendance(students: DataFrame, attendance: DataFrame, courses: DataFrame,
                       user_id: int | None = None) -> DataFrame:
    """Q6: attendance rows with course name/code (rows of unknown courses drop out)."""
    a = _for_student(attendance, students, user_id)
    c = courses.select("course_id", "course_name", "course_code")
    return (a.join(c, "course_id")
             .select("student_id", F.col("attendance_id").alias("id"),
                     F.col("attendance_date").alias("date"), "status", "course_name", "course_code"))


def attendance_stats(students: DataFrame, attendance: DataFrame | None, courses: DataFrame | None,
                     user_id: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Q7: per student, counts by status and percentages of the Q6 rows.

    Students without rows get zeros.  Status compare is exact; other
    statuses count in the total only.  With ``counts`` (``running.CLASSES``)
    no attendance is read.
    """
    s = students.select("student_id", "user_id")
    if user_id is not None:
        s = only_keys(s, role_key(students, "student_id", user_id), "student_id")
    if counts is not None:
        per = counts
    else:
        rows = only_keys(attendance.select("student_id", "course_id", "attendance_id", "status"),
                         courses.select("course_id"), "course_id")
        if user_id is not None:  # before the counts
            rows = only_keys(rows, s, "student_id")
        per = rows.groupBy("student_id").agg(
            F.count("attendance_id").alias("total_classes"),
            count_if_eq("status", ATTENDANCE_PRESENT).alias("present"),
            count_if_eq("status", ATTENDANCE_ABSENT).alias("absent"),
            count_if_eq("status", ATTENDANCE_EXCUSED).alias("excused"))
    out = s.select("student_id").join(per, "student_id", "left")
    zero = F.lit(0).cast("long")
    out = out.select("student_id", *[F.coalesce(c, zero).alias(c)
                                     for c in ("total_classes", "present", "absent", "excused")])
    return out.select("student_id", "total_classes", "present", "absent", "excused",
                      pct("present", "total_classes").alias("present_percentage"),
                      pct("absent", "total_classes").alias("absent_percentage"),
                      pct("excused", "total_classes").alias("excused_percentage"))


def teacher_course_load(teachers: DataFrame, courses: DataFrame, enrollments: DataFrame | None,
                        user_id: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Q11: each teacher's courses with their enrollment counts (0 when none).
    With ``counts`` (``running.ENROLLED``) no enrollment is read."""
    t = role_key(teachers, "teacher_id", user_id).select("teacher_id")
    c = courses.join(t, "teacher_id")
    if user_id is not None and counts is None:  # before the counts
        enrollments = only_keys(enrollments, c, "course_id")
    return (c.join(enrollment_counts(enrollments) if counts is None else counts, "course_id", "left")
             .select("teacher_id", F.col("course_id").alias("id"), F.col("course_code").alias("code"),
                     F.col("course_name").alias("name"), "schedule",
                     F.coalesce("enrolled_students", F.lit(0).cast("long")).alias("enrolled_students")))


def course_roster(students: DataFrame, enrollments: DataFrame, courses: DataFrame,
                  course_id: int | None = None, teacher_user_id: int | None = None,
                  teachers: DataFrame | None = None) -> DataFrame:
    """Q12: students enrolled in each existing course.

    With ``teacher_user_id`` only the courses that teacher teaches are
    listed (the permission check of the application).
    """
    c = courses.select("course_id", "teacher_id")
    if course_id is not None:
        c = c.where(F.col("course_id") == F.lit(course_id))
    if teacher_user_id is not None:
        if teachers is None:
            raise ValueError("teachers is required with teacher_user_id")
        c = c.join(role_key(teachers, "teacher_id", teacher_user_id).select("teacher_id"), "teacher_id")
    e = only_keys(enrollments, c, "course_id")
    s = students.select("student_id", "name", "email", "roll_number")
    return (e.join(s, "student_id")
             .select("course_id", F.col("student_id").alias("id"), "name", "email", "roll_number",
                     F.col("enrollment_status").alias("status"), F.col("created_at").alias("enrolled_at")))


def course_catalog(courses: DataFrame, teachers: DataFrame, enrollments: DataFrame | None,
                   teacher_id: int | None = None, search: str | None = None,
                   counts: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Q13: every course with its teacher's name and enrollment count.

    Optional filters: teacher id equality, and a contains-search over code
    and name (the term's own % and _ act as wildcards).  Counts are
    aggregated per course before the joins.  With ``counts``
    (``running.ENROLLED``) no enrollment is read; with ``postings``
    (``search.course_values``) a search reads its candidates only.
    """
    ids = candidates(postings, search) if search and postings is not None else None
    if ids is not None:
        courses, = narrowed([(courses, "course_id")], ids)
    c = where_all(courses, [
        (F.col("teacher_id") == F.lit(teacher_id)) if teacher_id else None,
        contains_any(["course_code", "course_name"], search) if search else None,
    ])
    t = teachers.select("teacher_id", F.col("name").alias("teacher_name"))
    if (teacher_id or search) and counts is None:  # before the counts
        enrollments = only_keys(enrollments, c, "course_id")
    return (left_join_nullable(c, t, "teacher_id", "course_id")
             .join(enrollment_counts(enrollments) if counts is None else counts, "course_id", "left")
             .select(F.col("course_id").alias("id"), F.col("course_code").alias("code"),
                     F.col("course_name").alias("name"), "schedule", "teacher_id", "teacher_name",
                     F.coalesce("enrolled_students", F.lit(0).cast("long")).alias("enrolled_students")))


def attendance_sheet(roster: DataFrame, overrides: DataFrame) -> DataFrame:
    """Q18: every rostered (course, student) marked present unless an entry
    for it says otherwise; of several entries the one with the highest
    ``seq`` counts (NULL is lowest, ties go to the larger status), and an
    empty status falls back to present.
    """
    # One aggregate by (course, student), so it shares the join's partitioning.
    keys = ["course_id", "student_id"]
    latest = overrides.groupBy(*keys).agg(F.max(F.struct("seq", "status")).alias("last")) \
        .select(*keys, F.col("last.status").alias("override"))
    return (roster.select("course_id", "student_id")
                  .join(latest, ["course_id", "student_id"], "left")
                  .select("course_id", "student_id",
                          F.coalesce(F.nullif("override", F.lit("")), F.lit(ATTENDANCE_PRESENT))
                           .alias("status")))


def _date_text(c: str):
    return F.date_format(c, "M/d/yyyy")


def _percent_text(percentage: str):
    """A percentage with one decimal; entities without rows have 0."""
    return F.concat(one_decimal(percentage), F.lit("%"))


def display_rows(df: DataFrame, kind: str) -> DataFrame:
    """Q19: the dashboards' display columns (defaults for missing values,
    ``name (code)`` course text, ``M/d/yyyy`` dates, lower-case status).
    """
    if kind == "courses":        # Q4 rows
        return df.select("student_id", "id", "name", "code", "status",
                         F.coalesce(F.when((F.col("progress") != 0) & ~F.isnan("progress"), number_text("progress")),
                                    F.lit(SHOW_NO_PROGRESS)).alias("progress_text"))
    if kind == "grades":         # Q5 rows
        return df.select("student_id", "id",
                         F.concat_ws("", "course_name", F.lit(" ("), "course_code", F.lit(")"))
                          .alias("course_text"),
                         "assignment_title",
                         F.coalesce(F.nullif("grade", F.lit("")), F.lit(SHOW_NOT_GRADED)).alias("grade_text"),
                         F.coalesce(F.nullif("feedback", F.lit("")), F.lit(SHOW_NO_FEEDBACK))
                          .alias("feedback_text"),
                         _date_text("submitted_at").alias("submitted_text"))
    if kind == "attendance":     # Q6 rows
        return df.select("student_id", "id",
                         F.concat_ws("", "course_name", F.lit(" ("), "course_code", F.lit(")"))
                          .alias("course_text"),
                         _date_text("date").alias("date_text"),
                         "status", F.lower("status").alias("status_class"))
    if kind == "roster":         # Q12 rows (the roster carries no progress)
        return df.select("course_id", "id", "name", "email",
                         _date_text("enrolled_at").alias("enrolled_text"),
                         F.lit(SHOW_NO_PROGRESS).alias("progress_text"))
    if kind == "catalog":        # Q13 rows
        return df.select("id", "name", "code",
                         F.coalesce(F.nullif("teacher_name", F.lit("")), F.lit(SHOW_NO_TEACHER))
                          .alias("teacher_text"))
    if kind == "stats":          # Q7 rows
        return df.select("student_id", _percent_text("present_percentage").alias("present_text"),
                         _percent_text("absent_percentage").alias("absent_text"),
                         F.col("total_classes").cast("string").alias("total_text"))
    if kind == "teacher_courses":  # Q11 rows
        return df.select("teacher_id", "id", "name", F.concat(F.lit("Code: "), F.coalesce("code", F.lit(""))).alias("code_text"),
                         F.concat(F.lit("Students: "), F.coalesce("enrolled_students", F.lit(0)).cast("string")).alias("students_text"))
    raise ValueError(f"unknown display kind: {kind}")

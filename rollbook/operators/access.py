"""Ownership checks for teacher requests, as joins over a request DataFrame.

Each check annotates every request with ``reason`` (NULL when allowed),
checking in the application's order: the teacher first, then the
permission.  ``split`` turns an annotated frame into (accepted, rejects).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.keys import left_join_nullable, role_key
from rollbook.plans.batches import FILTER_FROM, FILTER_TO, key_filtered, wanted
from rollbook.plans.materialize import materialize
from rollbook.schema import MSG_ACCESS_COURSE, MSG_GRADE_PERMISSION, MSG_TEACHER_NOT_FOUND


def split(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = annotated.where(F.col("reason").isNull()).drop("reason")
    rejects = annotated.where(F.col("reason").isNotNull()).select("seq", "reason")
    return ok, rejects


def with_teacher(requests: DataFrame, teachers: DataFrame, user_col: str = "teacher_user_id", write_keys: bool = False) -> DataFrame:
    """Add ``teacher_id`` (NULL when the user has no Teachers row).  With
    ``write_keys`` the requested teachers are written first, so that Spark knows
    their size and does not shuffle the requests where they are few."""
    tk = role_key(teachers, "teacher_id", requests=requests, request_col=user_col) \
        .withColumnRenamed("user_id", user_col)
    return left_join_nullable(requests, materialize(tk, "teacher-keys") if write_keys else tk, user_col, "seq")


def course_access_check(requests: DataFrame, teachers: DataFrame, courses: DataFrame,
                        denied: str = MSG_ACCESS_COURSE) -> DataFrame:
    """Q16 as an annotation over ``(seq, teacher_user_id, course_id, ...)``."""
    r = with_teacher(requests, teachers)
    # Only the requested courses take part in the join.
    owned = courses.select("course_id", F.col("teacher_id").alias("owner_id")) \
        .join(wanted(requests, ["course_id"]), "course_id", "left_semi")
    r = r.join(owned, "course_id", "left")
    reason = (F.when(F.col("teacher_id").isNull(), F.lit(MSG_TEACHER_NOT_FOUND))
               .when(~F.coalesce(F.col("owner_id") == F.col("teacher_id"), F.lit(False)), F.lit(denied)))
    return r.withColumn("reason", reason).drop("owner_id")


def course_access(requests: DataFrame, teachers: DataFrame, courses: DataFrame,
                  denied: str = MSG_ACCESS_COURSE) -> tuple[DataFrame, DataFrame]:
    """Q16: (allowed requests with ``teacher_id``, rejects ``(seq, reason)``)."""
    return split(course_access_check(requests, teachers, courses, denied))


def grade_owner(grades: DataFrame, assignments: DataFrame, courses: DataFrame) -> DataFrame:
    """``(grade_id, owner_id)``: the teacher of the course a grade belongs to."""
    # Assignments find their owners first: the grades, far more, are joined once.
    owners = (assignments.select("assignment_id", "course_id")
              .join(courses.select("course_id", F.col("teacher_id").alias("owner_id")), "course_id")
              .select("assignment_id", "owner_id"))
    return grades.select("grade_id", "assignment_id").join(owners, "assignment_id").select("grade_id", "owner_id")


def grade_access_check(requests: DataFrame, teachers: DataFrame, grades: DataFrame,
                       assignments: DataFrame, courses: DataFrame) -> DataFrame:
    """Q17 as an annotation over ``(seq, teacher_user_id, grade_id, ...)``.

    Grades are first narrowed to the requested ids, so the assignment and
    course joins only see requested grades: by a semi join with a few ids, by
    bitmap with more.  With more than a bitmap takes, narrowing would shuffle
    requests and grades once more each, and is left out; the requests are
    joined by the exact id in any case.
    """
    r = with_teacher(requests, teachers, write_keys=True)
    many, asked = requests.count(), grades
    if many < FILTER_FROM:
        asked = grades.join(wanted(requests, ["grade_id"]), "grade_id", "left_semi")
    elif many <= FILTER_TO:
        asked = key_filtered(grades, ["grade_id"], requests.select("grade_id").where(F.col("grade_id").isNotNull()), 0)
    owners = grade_owner(asked, assignments, courses)
    r = r.join(owners, "grade_id", "left")
    reason = (F.when(F.col("teacher_id").isNull(), F.lit(MSG_TEACHER_NOT_FOUND))
               .when(~F.coalesce(F.col("owner_id") == F.col("teacher_id"), F.lit(False)),
                     F.lit(MSG_GRADE_PERMISSION)))
    return r.withColumn("reason", reason).drop("owner_id")


def grade_access(requests: DataFrame, teachers: DataFrame, grades: DataFrame,
                 assignments: DataFrame, courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q17: (allowed requests with ``teacher_id``, rejects ``(seq, reason)``)."""
    return split(grade_access_check(requests, teachers, grades, assignments, courses))

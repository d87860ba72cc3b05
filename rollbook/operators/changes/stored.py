"""Change batches applied to stored snapshots (``sources.snapshots``).

The checks and the new rows are those of the plain operators; they get the
partitions that the batch touches in place of the whole table, and only these
are written again.  Tables that the checks look keys up in are DataFrames, of
which they read the columns they need.  Each function returns the new
version(s) and the rejects.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from rollbook.operators.changes.courses import delete_courses, update_courses
from rollbook.operators.changes.fees import pay_fees
from rollbook.operators.changes.teaching import create_assignments, post_notices, take_attendance, update_grades
from rollbook.operators.changes.users import update_users
from rollbook.plans.batches import existing_keys, without_keys
from rollbook.plans.materialize import materialize
from rollbook.sources.snapshots import Snapshot, part_of


def stored_update_grades(grades: Snapshot, teachers: DataFrame, assignments: DataFrame, courses: DataFrame,
                         batch: DataFrame, as_of: dt.datetime) -> tuple[Snapshot, DataFrame]:
    """C7 on grades kept by ``grade_id``.  The requested grades all lie in the
    touched partitions, so the checks read nothing else of the grades.  Large
    partitions are rewritten in groups, each with the requests for its grades."""
    touched = grades.parts_of(batch)
    groups = grades.groups(touched)
    if len(groups) > 1:
        assignments = materialize(assignments.select("assignment_id", "course_id"), "assignments")  # read for each group
    new, rejects = update_grades(grades.read(touched), teachers, assignments, courses, batch, as_of)
    if len(groups) == 1:
        return grades.rewrite(touched, new), rejects
    part = part_of(grades.key, grades.parts)

    def updated(group: list[int]) -> DataFrame:
        return update_grades(grades.read(group), teachers, assignments, courses, batch.where(part.isin(group)), as_of)[0]

    return grades.rewrite_groups(groups, updated), rejects


def stored_pay_fees(fees: Snapshot, students: DataFrame, batch: DataFrame, as_of: dt.date) -> tuple[Snapshot, DataFrame]:
    """C11 on fees kept by ``fee_id``."""
    touched = fees.parts_of(batch)
    new, rejects = pay_fees(fees.read(touched), students, batch, as_of)
    return fees.rewrite(touched, new), rejects


def stored_update_courses(courses: Snapshot, teachers: DataFrame, batch: DataFrame, as_of: dt.datetime
                          ) -> tuple[Snapshot, DataFrame, DataFrame]:
    """C5 on courses kept by ``course_id``.  A new code may be held by any
    course: that check reads the codes and ids of all."""
    touched = courses.parts_of(batch)
    new, updated, rejects = update_courses(courses.read(), teachers, batch, as_of, target=courses.read(touched))
    return courses.rewrite(touched, new), updated, rejects


def stored_update_users(users: DataFrame, tables: dict[str, Snapshot], batch: DataFrame) -> tuple[dict[str, Snapshot], DataFrame]:
    """C2 on the role tables ``students``, ``teachers`` and ``management``, kept by ``user_id``."""
    touched = {n: s.parts_of(batch) for n, s in tables.items()}
    new, rejects = update_users(users, *(tables[n].read(touched[n]) for n in ("students", "teachers", "management")), batch)
    return {n: s.rewrite(touched[n], new[n]) for n, s in tables.items()}, rejects


def stored_delete_courses(tables: dict[str, Snapshot], batch: DataFrame) -> tuple[dict[str, Snapshot], DataFrame]:
    """C6 on ``courses``, ``attendance``, ``grades``, ``assignments`` and ``enrollments``,
    kept by any key.  A table's rows to delete are found by one scan of two
    columns; the partitions without any are carried over."""
    names = ("courses", "attendance", "grades", "assignments", "enrollments")
    courses, attendance, grades, assignments, enrollments = (tables[n].read() for n in names)
    _, rejects = delete_courses(courses, attendance, grades, assignments, enrollments, batch)
    doomed = materialize(existing_keys(courses, batch, ["course_id"]).select("course_id"), "doomed-courses")
    below = materialize(assignments.join(doomed, "course_id", "left_semi").select("assignment_id"), "doomed-assignments")
    out = {}
    for n in names:
        keys, column = (below, "assignment_id") if n == "grades" else (doomed, "course_id")
        touched = tables[n].parts_with(keys, column)
        stay, rest = without_keys(tables[n].read(touched), column, keys)
        out[n] = tables[n].rewrite(touched, rest, stay)
    return out, rejects


def stored_take_attendance(attendance: Snapshot, teachers: DataFrame, courses: DataFrame, requests: DataFrame, records: DataFrame,
                           as_of: dt.datetime) -> tuple[Snapshot, DataFrame]:
    """New rows are added; of the old ones only the largest id is read."""
    old = attendance.read()
    new, rejects = take_attendance(old.limit(0), teachers, courses, requests, records, as_of, last_id=old)
    return attendance.append(new["attendance"]), rejects


def stored_create_assignments(assignments: Snapshot, teachers: DataFrame, courses: DataFrame, batch: DataFrame, as_of: dt.datetime
                              ) -> tuple[Snapshot, DataFrame]:
    """C9, likewise."""
    old = assignments.read()
    new, rejects = create_assignments(old.limit(0), teachers, courses, batch, as_of, last_id=old)
    return assignments.append(new["assignments"]), rejects


def stored_post_notices(notices: Snapshot, batch: DataFrame, as_of: dt.datetime) -> tuple[Snapshot, DataFrame]:
    """C10, likewise."""
    old = notices.read()
    new, rejects = post_notices(old.limit(0), batch, as_of, last_id=old)
    return notices.append(new["notices"]), rejects

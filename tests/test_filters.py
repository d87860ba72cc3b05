"""Optional key filters: a filtered answer equals the unfiltered answer
restricted to that key (sf0.001 driver tables)."""

import pytest
from conftest import SF_SMALL

from rollbook.operators import billing, declared, directory, learning
from rollbook.sources import load_driver


def student_user(key):
    return key * 4 + 1


def teacher_user(key):
    return key * 4 + 2


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def c(spark):
    return load_driver(spark, SF_SMALL)


@pytest.mark.parametrize("student", [0, 7, 149])
def test_student_filters(c, student):
    uid = student_user(student)
    cases = [
        (learning.student_courses, (c.students, c.enrollments, c.courses)),
        (learning.student_grades, (c.students, c.grades, c.assignments, c.courses)),
        (learning.student_attendance, (c.students, c.attendance, c.courses)),
        (learning.attendance_stats, (c.students, c.attendance, c.courses)),
        (billing.fee_detail, (c.students, c.fees)),
        (billing.fee_stats, (c.students, c.fees)),
    ]
    for fn, args in cases:
        full = fn(*args).where(f"student_id = {student}")
        assert rows(fn(*args, user_id=uid)) == rows(full), fn.__name__


def test_profile_and_directory_filters(c):
    uid = student_user(3)
    assert rows(directory.student_profile(c.students, c.users, user_id=uid)) == \
        rows(directory.student_profile(c.students, c.users).where(f"user_id = {uid}"))
    tuid = teacher_user(2)
    assert rows(directory.teacher_profile(c.teachers, c.users, user_id=tuid)) == \
        rows(directory.teacher_profile(c.teachers, c.users).where(f"user_id = {tuid}"))
    assert rows(directory.user_directory(c.users, c.students, c.teachers, c.management, user_id=tuid)) == \
        rows(directory.user_directory(c.users, c.students, c.teachers, c.management).where(f"id = {tuid}"))
    only_teachers = directory.user_directory(c.users, c.students, c.teachers, c.management, role="teacher")
    assert {r["role"] for r in only_teachers.collect()} == {"teacher"}


@pytest.mark.parametrize("teacher", [1, 4])
def test_teacher_filters(c, teacher):
    tuid = teacher_user(teacher)
    load = learning.teacher_course_load(c.teachers, c.courses, c.enrollments, user_id=tuid)
    assert rows(load) == rows(learning.teacher_course_load(c.teachers, c.courses, c.enrollments)
                              .where(f"teacher_id = {teacher}"))
    cat = learning.course_catalog(c.courses, c.teachers, c.enrollments, teacher_id=teacher)
    assert rows(cat) == rows(learning.course_catalog(c.courses, c.teachers, c.enrollments)
                             .where(f"teacher_id = {teacher}"))
    roster = learning.course_roster(c.students, c.enrollments, c.courses, teacher_user_id=tuid, teachers=c.teachers)
    mine = [r["id"] for r in cat.collect()]
    full = learning.course_roster(c.students, c.enrollments, c.courses)
    assert rows(roster) == rows(full.where(full.course_id.isin(mine)))


def test_course_filters(c):
    for course in (3, 17):
        full = learning.course_roster(c.students, c.enrollments, c.courses).where(f"course_id = {course}")
        assert rows(learning.course_roster(c.students, c.enrollments, c.courses, course_id=course)) == rows(full)
        assert rows(declared.course_assignments(c.assignments, c.courses, course_id=course)) == \
            rows(declared.course_assignments(c.assignments, c.courses).where(f"course_id = {course}"))
        assert rows(declared.course_attendance(c.attendance, c.courses, course_id=course)) == \
            rows(declared.course_attendance(c.attendance, c.courses).where(f"course_id = {course}"))


def test_available_courses_for_one_student(c):
    student = 5
    avail = {r["id"] for r in declared.available_courses(c.courses, c.enrollments, student).collect()}
    enrolled = {r["course_id"] for r in c.enrollments.where(f"student_id = {student}").collect()}
    all_courses = {r["course_id"] for r in c.courses.collect()}
    assert avail == all_courses - enrolled
    counts = {r["student_id"]: r for r in declared.available_course_counts(c.students, c.courses, c.enrollments)
              .where(f"student_id = {student}").collect()}
    assert counts[student]["available_courses"] == len(avail)


def test_presentation_order(c):
    from rollbook.plans.presentation import present
    cat = present(learning.course_catalog(c.courses, c.teachers, c.enrollments), "course_catalog").collect()
    keys = [(r["code"], r["id"]) for r in cat]
    assert keys == sorted(keys)
    d = present(directory.user_directory(c.users, c.students, c.teachers, c.management), "user_directory").collect()
    # NULL created_at (teachers, managers) come last in descending order
    seen_null = False
    for r in d:
        if r["created_at"] is None:
            seen_null = True
        else:
            assert not seen_null

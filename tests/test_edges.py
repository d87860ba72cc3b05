"""Hand-made edge rows, one test per decision (expected outputs written out)."""

import datetime as dt
from decimal import Decimal

from conftest import as_dicts, frame, table

from rollbook.operators import billing, directory, learning, notices
from rollbook.operators import changes

AS_OF = dt.datetime(2025, 1, 15, 9, 30)


def test_r2_user_id_is_translated(spark):
    students = table(spark, "students", [{"student_id": 1, "user_id": 7, "name": "A"},
                                         {"student_id": 7, "user_id": 1, "name": "B"}])
    fees = table(spark, "fees", [{"fee_id": 10, "student_id": 1, "amount": 5.0},
                                 {"fee_id": 11, "student_id": 7, "amount": 6.0}])
    out = as_dicts(billing.fee_detail(students, fees, user_id=7), "id")
    assert [r["id"] for r in out] == [10]
    assert all(r["student_id"] == 1 for r in out)


def test_r3_zero_rows_give_zero_stats(spark):
    students = table(spark, "students", [{"student_id": 1, "user_id": 11}])
    fees = table(spark, "fees", [])
    attendance = table(spark, "attendance", [])
    courses = table(spark, "courses", [{"course_id": 1}])
    f = as_dicts(billing.fee_stats(students, fees))
    assert f == [{"student_id": 1, "total_fees": 0.0, "paid_fees": 0.0, "pending_fees": 0.0,
                  "unpaid_fees": 0.0, "paid_percentage": 0.0}]
    a = as_dicts(learning.attendance_stats(students, attendance, courses))
    assert a == [{"student_id": 1, "total_classes": 0, "present": 0, "absent": 0, "excused": 0,
                  "present_percentage": 0.0, "absent_percentage": 0.0, "excused_percentage": 0.0}]


def test_r4_status_compare_is_exact(spark):
    students = table(spark, "students", [{"student_id": 1, "user_id": 11}])
    courses = table(spark, "courses", [{"course_id": 5}])
    attendance = table(spark, "attendance", [
        {"attendance_id": i, "student_id": 1, "course_id": 5, "status": s}
        for i, s in enumerate(["present", "Present", "late", None])])
    [row] = as_dicts(learning.attendance_stats(students, attendance, courses))
    assert (row["total_classes"], row["present"], row["absent"], row["excused"]) == (4, 1, 0, 0)
    assert row["present_percentage"] == 25.0


def test_r4_null_fee_status_can_be_paid(spark):
    students = table(spark, "students", [{"student_id": 1, "user_id": 11}])
    fees = table(spark, "fees", [{"fee_id": 9, "student_id": 1, "amount": 3.0, "payment_status": None}])
    batch = frame(spark, "seq long, user_id long, fee_id long", [(1, 11, 9)])
    new, rejects = changes.pay_fees(fees, students, batch, AS_OF.date())
    assert rejects.count() == 0
    [f] = as_dicts(new)
    assert f["payment_status"] == "paid" and f["payment_date"] == AS_OF.date()


def test_r5_search_wildcards(spark):
    courses = table(spark, "courses", [
        {"course_id": 1, "course_code": "abc", "course_name": "n1"},
        {"course_id": 2, "course_code": "A-C", "course_name": "n2"},
        {"course_id": 3, "course_code": "x\\y", "course_name": "n3"},
        {"course_id": 4, "course_code": "[a]", "course_name": "n4"},
        {"course_id": 5, "course_code": "a", "course_name": "50 pct"},
        {"course_id": 6, "course_code": "q", "course_name": "5 0"}])
    teachers = table(spark, "teachers", [])
    enrollments = table(spark, "enrollments", [])

    def ids(term):
        df = learning.course_catalog(courses, teachers, enrollments, search=term)
        return sorted(r["id"] for r in df.collect())

    assert ids("a_c") == [1, 2]          # _ is a wildcard, case-insensitive
    assert ids("50%") == [5]             # % is a wildcard
    assert ids("x\\y") == [3]            # a backslash is literal, no error
    assert ids("[a]") == [4]             # brackets are literal


def test_r6_money_is_exact(spark):
    students = table(spark, "students", [{"student_id": 1, "user_id": 11}])
    fees = table(spark, "fees", [
        {"fee_id": 1, "student_id": 1, "amount": 0.1, "payment_status": "paid"},
        {"fee_id": 2, "student_id": 1, "amount": 0.2, "payment_status": "paid"},
        {"fee_id": 3, "student_id": 1, "amount": None, "payment_status": "unpaid"}])
    [row] = as_dicts(billing.fee_stats(students, fees))
    assert row["total_fees"] == 0.3 and row["paid_fees"] == 0.3
    assert row["paid_percentage"] == 100.0


def test_r8_falsy_values(spark):
    teachers = table(spark, "teachers", [{"teacher_id": 1, "user_id": 21}])
    courses = table(spark, "courses", [{"course_id": 5, "teacher_id": 1}])
    assignments = table(spark, "assignments", [])
    batch = spark.createDataFrame(
        [(1, 21, 5, "T", None, None, Decimal(0)), (2, 21, 5, "T", "", "", Decimal(10))],
        "seq long, teacher_user_id long, course_id long, title string, description string, "
        "due_date string, total_marks decimal(18,0)")
    out, rejects = changes.create_assignments(assignments, teachers, courses, batch, AS_OF)
    created = out["created"]
    assert as_dicts(rejects) == [{"seq": 1, "reason": "Please provide title and total marks"}]
    [c] = as_dicts(created)
    assert c["description"] is None and c["due_date"] is None and c["total_marks"] == Decimal(10)

    users = table(spark, "users", [])
    empty = {n: table(spark, n, []) for n in ("students", "teachers", "management")}
    b = spark.createDataFrame(
        [(1, "u1", "pw", "teacher", "N", "e@x", "", None, None, None)],
        "seq long, domain_id string, password string, role string, name string, email string, "
        "phone_number string, department string, address string, roll_number string")
    out, rej = changes.create_users(users, empty["students"], empty["teachers"], empty["management"], b, AS_OF)
    assert rej.count() == 0
    [t] = as_dicts(out["teachers"])
    assert t["phone_number"] is None

    grades = table(spark, "grades", [{"grade_id": "1", "student_id": 1, "assignment_id": 50}])
    a2 = table(spark, "assignments", [{"assignment_id": 50, "course_id": 5}])
    gb = frame(spark, "seq long, teacher_user_id long, grade_id string, grade string, feedback string",
               [(1, 21, "1", "", "x")])
    _, grej = changes.update_grades(grades, teachers, a2, courses, gb, AS_OF)
    assert as_dicts(grej) == [{"seq": 1, "reason": "Please provide a grade"}]


def test_r12_email_in_two_role_tables_takes_smallest_user(spark):
    users = table(spark, "users", [{"user_id": 5, "role": "teacher"}, {"user_id": 3, "role": "student"}])
    students = table(spark, "students", [{"student_id": 1, "user_id": 3, "email": "same@x"}])
    teachers = table(spark, "teachers", [{"teacher_id": 1, "user_id": 5, "email": "same@x"}])
    management = table(spark, "management", [])
    emails = frame(spark, "email string", [("same@x",), ("none@x",)])
    out = as_dicts(directory.find_users_by_email(emails, users, students, teachers, management))
    assert out == [{"email": "same@x", "user_id": 3, "role": "student"}]


def test_r13a_search_covers_all_role_tables(spark):
    users = table(spark, "users", [{"user_id": 1, "domain_id": "d1", "role": "student"}])
    students = table(spark, "students", [{"student_id": 1, "user_id": 1, "name": "Plain", "email": "p@x"}])
    teachers = table(spark, "teachers", [{"teacher_id": 9, "user_id": 1, "name": "Zebra", "email": "z@x"}])
    management = table(spark, "management", [])
    out = as_dicts(directory.user_directory(users, students, teachers, management, search="zebra"))
    assert [(r["id"], r["name"]) for r in out] == [(1, "Plain")]


def test_r13b_r13c_notice_posters(spark):
    users = table(spark, "users", [{"user_id": 1, "domain_id": "t1", "role": "teacher"},
                                   {"user_id": 2, "domain_id": "s2", "role": "student"}])
    teachers = table(spark, "teachers", [])
    management = table(spark, "management", [])
    n = table(spark, "notices", [{"notice_id": 1, "title": "a", "posted_by_user_id": 1},
                                 {"notice_id": 2, "title": "b", "posted_by_user_id": 2},
                                 {"notice_id": 3, "title": "c", "posted_by_user_id": 99}])
    out = as_dicts(notices.notice_board(n, users, teachers, management), "id")
    assert [(r["id"], r["posted_by"]) for r in out] == [(1, None), (2, "s2")]


def test_r13d_null_teacher_courses_stay(spark):
    courses = table(spark, "courses", [{"course_id": 1, "course_code": "a"}, {"course_id": 2, "course_code": "b"}])
    teachers = table(spark, "teachers", [])
    enrollments = table(spark, "enrollments", [{"student_id": 1, "course_id": 1}, {"student_id": None, "course_id": 1}])
    out = as_dicts(learning.course_catalog(courses, teachers, enrollments), "id")
    assert [(r["id"], r["teacher_id"], r["enrolled_students"]) for r in out] == [(1, None, 1), (2, None, 0)]


def test_c1_first_valid_request_wins(spark):
    users = table(spark, "users", [{"user_id": 100, "domain_id": "old", "role": "student"}])
    students = table(spark, "students", [{"student_id": 40, "user_id": 100}])
    empty_t, empty_m = table(spark, "teachers", []), table(spark, "management", [])
    b = spark.createDataFrame(
        [(1, "x", "pw", "student", "N", "e", None, None, None, None),
         (2, "x", "pw", "student", "N", "e", None, None, None, "R1"),
         (3, "x", "pw", "student", "N", "e", None, None, None, None),
         (4, "old", "pw", "student", "N", "e", None, None, None, "R2")],
        "seq long, domain_id string, password string, role string, name string, email string, "
        "phone_number string, department string, address string, roll_number string")
    out, rej = changes.create_users(users, students, empty_t, empty_m, b, AS_OF)
    assert as_dicts(rej, "seq") == [
        {"seq": 1, "reason": "Roll number is required for students"},
        {"seq": 3, "reason": "User already exists"},
        {"seq": 4, "reason": "User already exists"}]
    new_users = [r for r in as_dicts(out["users"], "user_id") if r["domain_id"] == "x"]
    assert [(r["user_id"], r["role"]) for r in new_users] == [(101, "student")]
    new_students = [r for r in as_dicts(out["students"], "student_id") if r["user_id"] == 101]
    assert [(r["student_id"], r["roll_number"]) for r in new_students] == [(41, "R1")]


def test_c5_three_state_patch(spark):
    from pyspark.sql import types as T
    courses = table(spark, "courses", [
        {"course_id": 1, "course_code": "A", "course_name": "a", "teacher_id": 7, "description": "d"},
        {"course_id": 2, "course_code": "B", "course_name": "b", "teacher_id": 7, "description": "d"},
        {"course_id": 3, "course_code": "C", "course_name": "c", "teacher_id": 7, "description": "d"}])
    teachers = table(spark, "teachers", [{"teacher_id": 7, "user_id": 27}])
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("course_id", T.LongType()),
                           T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
    batch = spark.createDataFrame([(1, 1, {"teacher_id": None}), (2, 2, {"name": ""}),
                                   (3, 3, {"description": None}), (4, 2, {"code": "A"}),
                                   (5, 9, {"name": "z"}), (6, 3, {"teacher_id": "8"})], schema)
    new, updated, rej = changes.update_courses(courses, teachers, batch, AS_OF)
    assert sorted(r["id"] for r in updated.collect()) == [1, 3]
    assert as_dicts(rej, "seq") == [
        {"seq": 2, "reason": "No fields to update"},
        {"seq": 4, "reason": "Course code already in use"},
        {"seq": 5, "reason": "Course not found"},
        {"seq": 6, "reason": "Teacher not found"}]
    rows = {r["course_id"]: r for r in as_dicts(new)}
    assert rows[1]["teacher_id"] is None and rows[1]["description"] == "d"
    assert rows[3]["description"] is None and rows[3]["teacher_id"] == 7
    assert rows[2]["updated_at"] is None and rows[1]["updated_at"] == AS_OF


def test_c5_patch_from_json(spark, tmp_path):
    from pyspark.sql import types as T
    from rollbook.sources import read_changes
    p = tmp_path / "req.json"
    p.write_text('{"seq": 1, "course_id": 1, "fields": {"teacher_id": null}}\n'
                 '{"seq": 2, "course_id": 1, "fields": {"name": "x", "teacher_id": 5}}\n')
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("course_id", T.LongType()),
                           T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
    rows = {r["seq"]: r["fields"] for r in read_changes(spark, str(p), schema, patch_column="fields").collect()}
    assert rows[1] == {"teacher_id": None}
    assert rows[2] == {"name": "x", "teacher_id": "5"}


def test_c6_cascade_keeps_null_assignment_grades(spark):
    courses = table(spark, "courses", [{"course_id": 1}, {"course_id": 2}])
    assignments = table(spark, "assignments", [{"assignment_id": 10, "course_id": 1},
                                               {"assignment_id": 20, "course_id": 2}])
    grades = table(spark, "grades", [{"grade_id": "1", "assignment_id": 10}, {"grade_id": "2", "assignment_id": 20},
                                     {"grade_id": "3", "assignment_id": None}])
    attendance = table(spark, "attendance", [{"attendance_id": 1, "course_id": 1},
                                             {"attendance_id": 2, "course_id": 2}])
    enrollments = table(spark, "enrollments", [{"student_id": 1, "course_id": 1}])
    batch = frame(spark, "seq long, course_id long", [(1, 1), (2, 1), (3, 5)])
    out, rej = changes.delete_courses(courses, attendance, grades, assignments, enrollments, batch)
    assert as_dicts(rej, "seq") == [{"seq": 2, "reason": "Course not found"}, {"seq": 3, "reason": "Course not found"}]
    assert sorted(r["grade_id"] for r in out["grades"].collect()) == ["2", "3"]
    assert [r["course_id"] for r in out["courses"].collect()] == [2]
    assert [r["attendance_id"] for r in out["attendance"].collect()] == [2]
    assert out["enrollments"].count() == 0
    assert [r["assignment_id"] for r in out["assignments"].collect()] == [20]


def test_c11_second_payment_is_rejected(spark):
    students = table(spark, "students", [{"student_id": 1, "user_id": 11}, {"student_id": 2, "user_id": 12}])
    fees = table(spark, "fees", [{"fee_id": 9, "student_id": 1, "amount": 3.0, "payment_status": "unpaid"},
                                 {"fee_id": 8, "student_id": 1, "amount": 3.0, "payment_status": "paid"}])
    batch = frame(spark, "seq long, user_id long, fee_id long",
                  [(1, 11, 9), (2, 11, 9), (3, 12, 9), (4, 99, 9), (5, 11, 8)])
    new, rej = changes.pay_fees(fees, students, batch, AS_OF.date())
    assert as_dicts(rej, "seq") == [
        {"seq": 2, "reason": "Fee is already paid"},
        {"seq": 3, "reason": "Fee not found or does not belong to student"},
        {"seq": 4, "reason": "Student not found"},
        {"seq": 5, "reason": "Fee is already paid"}]
    assert {r["fee_id"]: r["payment_status"] for r in new.collect()} == {9: "paid", 8: "paid"}


def test_c8_nested_records_and_rejects(spark):
    teachers = table(spark, "teachers", [{"teacher_id": 1, "user_id": 21}])
    courses = table(spark, "courses", [{"course_id": 5, "teacher_id": 1}, {"course_id": 6, "teacher_id": 2}])
    attendance = table(spark, "attendance", [{"attendance_id": 7, "student_id": 1, "course_id": 5}])
    batch = spark.createDataFrame(
        [(1, 21, 5, [(9, "present"), (2, "absent")]), (2, 21, 6, [(3, "present")]),
         (3, 21, 5, None), (4, 99, 5, [(4, "present")])],
        "seq long, teacher_user_id long, course_id long, records array<struct<student_id:long,status:string>>")
    requests, records = changes.nested_attendance(batch)
    out, rej = changes.take_attendance(attendance, teachers, courses, requests, records, AS_OF)
    new = out["attendance"]
    assert as_dicts(rej, "seq") == [
        {"seq": 2, "reason": "You do not have permission to take attendance for this course"},
        {"seq": 3, "reason": "Please provide attendance records"},
        {"seq": 4, "reason": "Teacher not found"}]
    rows = as_dicts(new, "attendance_id")
    assert [(r["attendance_id"], r["student_id"], r["status"]) for r in rows[1:]] == [(8, 9, "present"), (9, 2, "absent")]  # in the records' order
    assert all(r["attendance_date"] == AS_OF.date() for r in rows[1:])


def test_q18_sheet_defaults_to_present(spark):
    roster = frame(spark, "course_id long, student_id long", [(1, 1), (1, 2), (1, 3)])
    overrides = frame(spark, "seq long, course_id long, student_id long, status string",
                      [(1, 1, 2, "absent"), (2, 1, 2, "excused"), (3, 1, 3, "")])
    out = as_dicts(learning.attendance_sheet(roster, overrides), "student_id")
    assert [r["status"] for r in out] == ["present", "excused", "present"]


def test_as_of_does_not_depend_on_session_time_zone(spark):
    notices_t = table(spark, "notices", [{"notice_id": 1, "title": "a", "content": "b"}])
    batch = frame(spark, "seq long, user_id long, title string, content string", [(1, 5, "t", "c")])
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            new = changes.post_notices(notices_t, batch, AS_OF)[0]["notices"]
            [row] = [r for r in new.collect() if r["notice_id"] == 2]
            assert row["created_at"] == AS_OF, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_c1_register_defaults_role_to_student(spark):
    users = table(spark, "users", [])
    empty = {n: table(spark, n, []) for n in ("students", "teachers", "management")}
    b = spark.createDataFrame(
        [(1, "a", "pw", None, "N", "e", None, None, None, "R9"), (2, "b", "pw", None, "N", "e", None, None, None, None),
         (3, "c", "pw", "teacher", "N", "", None, None, None, None)],
        "seq long, domain_id string, password string, role string, name string, email string, "
        "phone_number string, department string, address string, roll_number string")
    out, rej = changes.create_users(users, empty["students"], empty["teachers"], empty["management"], b, AS_OF,
                                    register=True)
    assert as_dicts(rej, "seq") == [{"seq": 2, "reason": "Roll number is required for students"},
                                    {"seq": 3, "reason": "Please provide domain_id, password, name, and email"}]
    assert [(r["domain_id"], r["role"]) for r in out["users"].collect()] == [("a", "student")]


def test_snapshot_roundtrip_and_result_json(spark, tmp_path):
    import json
    from rollbook.sources import read_table, write_result, write_snapshot
    courses = table(spark, "courses", [{"course_id": 1, "course_code": "A", "course_name": "x"}])
    write_snapshot(courses, str(tmp_path / "courses"))
    back = read_table(spark, str(tmp_path), "courses")
    assert back.schema == courses.schema and back.count() == 1
    out = write_result(back.select("course_id", "course_code"), str(tmp_path / "res"))
    lines = [json.loads(line) for p in (tmp_path / "res").glob("part-*") for line in p.read_text().splitlines()]
    assert lines == [{"course_id": 1, "course_code": "A"}] and out.endswith("res")


def test_passwords_never_reach_outputs_or_intermediates(spark):
    import glob
    import os
    from rollbook.session import checkpoint_dir
    users = table(spark, "users", [])
    empty = {n: table(spark, n, []) for n in ("students", "teachers", "management")}
    b = spark.createDataFrame(
        [(1, "a", "s3cret-pw-xyz", "teacher", "N", "e", None, None, None, None)],
        "seq long, domain_id string, password string, role string, name string, email string, "
        "phone_number string, department string, address string, roll_number string")
    out, rej = changes.create_users(users, empty["students"], empty["teachers"], empty["management"], b, AS_OF)
    for name in out:
        assert "password" not in out[name].columns
        assert "s3cret-pw-xyz" not in str(out[name].collect())
    root = checkpoint_dir(spark).replace("file:", "")
    for f in glob.glob(os.path.join(root, "**", "*.parquet"), recursive=True):
        with open(f, "rb") as fh:
            assert b"s3cret-pw-xyz" not in fh.read()


def test_q18_same_seq_for_different_students(spark):
    roster = frame(spark, "course_id long, student_id long", [(1, 1), (1, 2)])
    overrides = frame(spark, "seq long, course_id long, student_id long, status string",
                      [(5, 1, 1, "absent"), (5, 1, 2, "excused")])
    out = as_dicts(learning.attendance_sheet(roster, overrides), "student_id")
    assert [r["status"] for r in out] == ["absent", "excused"]


def test_q18_repeated_and_null_seq(spark):
    roster = frame(spark, "course_id long, student_id long", [(1, 1), (1, 2)])
    overrides = frame(spark, "seq long, course_id long, student_id long, status string",
                      [(5, 1, 1, "absent"), (5, 1, 1, "excused"), (None, 1, 2, "absent")])
    out = as_dicts(learning.attendance_sheet(roster, overrides), "student_id")
    assert [r["status"] for r in out] == ["excused", "absent"]


def test_c3_takes_the_role_rows_along(spark):
    users = table(spark, "users", [{"user_id": 1, "role": "student"}, {"user_id": 2, "role": "teacher"}])
    students = table(spark, "students", [{"student_id": 1, "user_id": 1}, {"student_id": 2, "user_id": 9}])
    teachers = table(spark, "teachers", [{"teacher_id": 1, "user_id": 2}])
    management = table(spark, "management", [])
    batch = frame(spark, "seq long, user_id long", [(1, 1), (2, 1), (3, 9)])
    out, rej = changes.delete_users(users, students, teachers, management, batch)
    assert [r["user_id"] for r in out["users"].collect()] == [2]
    assert [r["user_id"] for r in out["students"].collect()] == [9]   # not an existing user: not deleted
    assert out["teachers"].count() == 1
    assert as_dicts(rej, "seq") == [{"seq": 2, "reason": "User not found"}, {"seq": 3, "reason": "User not found"}]


def test_c9_bad_due_date_is_rejected(spark):
    teachers = table(spark, "teachers", [{"teacher_id": 1, "user_id": 21}])
    courses = table(spark, "courses", [{"course_id": 5, "teacher_id": 1}])
    batch = spark.createDataFrame(
        [(1, 21, 5, "T", None, "31/12/2025", Decimal(5)), (2, 21, 5, "T", None, "2025-12-31", Decimal(5))],
        "seq long, teacher_user_id long, course_id long, title string, description string, "
        "due_date string, total_marks decimal(18,0)")
    out, rej = changes.create_assignments(table(spark, "assignments", []), teachers, courses, batch, AS_OF)
    assert as_dicts(rej) == [{"seq": 1, "reason": "Please provide a valid due date"}]
    assert [str(r["due_date"]) for r in out["created"].collect()] == ["2025-12-31"]


def test_c2_user_without_a_role(spark):
    users = table(spark, "users", [{"user_id": 1, "role": None}])
    empty = {n: table(spark, n, []) for n in ("students", "teachers", "management")}
    batch = frame(spark, "seq long, user_id long, name string, email string, phone_number string, department string, address string",
                  [(1, 1, "N", None, None, None, None), (2, 2, "N", None, None, None, None)])
    _, rej = changes.update_users(users, empty["students"], empty["teachers"], empty["management"], batch)
    assert as_dicts(rej, "seq") == [{"seq": 1, "reason": "null profile not found"}, {"seq": 2, "reason": "User not found"}]


def test_ids_do_not_meet_at_large_keys(spark):
    from rollbook.sources import campus
    key = frame(spark, "k long", [(1,), (10_000_001,), (20_000_001,), (10 ** 17,)])
    ids = [r[0] for f in (campus.student_user, campus.teacher_user, campus.management_user, campus.unknown_user)
           for r in key.select(f(key.k)).collect()]
    assert len(set(ids)) == 16


def test_display_stats_text(spark):
    rows = frame(spark, "student_id long, total_classes long, present_percentage double, absent_percentage double",
                 [(i + 1, n, p / n * 100 if n else 0.0, a / n * 100 if n else 0.0) for i, (n, p, a) in enumerate([(16, 1, 15), (0, 0, 0), (3, 2, 1), (5, 5, 0)])])
    out = as_dicts(learning.display_rows(rows, "stats"), "student_id")
    assert [(r["present_text"], r["absent_text"], r["total_text"]) for r in out] == [
        ("6.3%", "93.8%", "16"), ("0.0%", "0.0%", "0"), ("66.7%", "33.3%", "3"), ("100.0%", "0.0%", "5")]


def test_presentation_order(spark):
    from rollbook.plans.presentation import present
    rows = frame(spark, "id long, code string", [(1, "b"), (2, None), (3, "a"), (4, "a")])
    assert [r.id for r in present(rows, "course_catalog").collect()] == [2, 3, 4, 1]
    dated = frame(spark, "id long, payment_date string", [(1, "2024"), (2, None), (3, "2025")])
    assert [r.id for r in present(dated, "fee_detail").collect()] == [3, 1, 2]

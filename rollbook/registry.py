"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
computed over the whole driver tables under ``sf_dir``.

Request DataFrames (e-mails, domain ids, change batches) are derived from
the driver tables by Spark, so their size grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.operators import billing, directory, learning, notices, search
from rollbook.operators.keys import role_key
from rollbook.operators.requests import read_for
from rollbook.plans.materialize import scratch_path
from rollbook.plans.presentation import present
from rollbook.schema import MSG_STUDENT_NOT_FOUND, MSG_TEACHER_NOT_FOUND, MSG_USER_NOT_FOUND
from rollbook.sources import read_changes, read_requests, read_table, write_result, write_snapshot
from rollbook.sources.campus import Campus, driver_table, load_driver, student_user, teacher_user, unknown_user

Query = Callable[[SparkSession, str], DataFrame]


def _campus(spark: SparkSession, sf_dir: str) -> Campus:
    return load_driver(spark, sf_dir)


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return driver_table(spark, sf_dir, name)


def q01_user_directory(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return directory.user_directory(c.users, c.students, c.teachers, c.management)


def q01_user_directory_search(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return directory.user_directory(c.users, c.students, c.teachers, c.management,
                                    role="student", search="1_0")


def _indexed_directory(spark, sf_dir, term):
    c = _campus(spark, sf_dir)
    tables = c.users, c.students, c.teachers, c.management
    return directory.user_directory(*tables, search=term, postings=search.write_postings(search.directory_values(*tables), scratch_path(spark, "postings")))


def q01_user_directory_search_indexed(spark, sf_dir):
    return _indexed_directory(spark, sf_dir, "MER#%7_1")


def q01_user_directory_search_indexed_short(spark, sf_dir):
    return _indexed_directory(spark, sf_dir, "1_0")


def q02_student_profile(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return directory.student_profile(c.students, c.users)


def q03_teacher_profile(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return directory.teacher_profile(c.teachers, c.users)


def q04_student_courses(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.student_courses(c.students, c.enrollments, c.courses)


def q05_student_grades(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.student_grades(c.students, c.grades, c.assignments, c.courses)


def q06_student_attendance(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.student_attendance(c.students, c.attendance, c.courses)


def q07_attendance_stats(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.attendance_stats(c.students, c.attendance, c.courses)


def q08_notice_board(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return notices.notice_board(c.notices, c.users, c.teachers, c.management)


def q09_fee_detail(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return billing.fee_detail(c.students, c.fees)


def q10_fee_stats(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return billing.fee_stats(c.students, c.fees)


def q11_teacher_course_load(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.teacher_course_load(c.teachers, c.courses, c.enrollments)


def q12_course_roster(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.course_roster(c.students, c.enrollments, c.courses)


def q13_course_catalog(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.course_catalog(c.courses, c.teachers, c.enrollments)


def q13_course_catalog_search(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.course_catalog(c.courses, c.teachers, c.enrollments, search="#1_-")


def q13_course_catalog_search_indexed(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.course_catalog(c.courses, c.teachers, c.enrollments, search="AND#1_-",
                                   postings=search.write_postings(search.course_values(c.courses), scratch_path(spark, "postings")))


def q14_find_users_by_email(spark, sf_dir):
    c = _campus(spark, sf_dir)
    customer, supplier, nation = (_raw(spark, sf_dir, n) for n in ("customer", "supplier", "nation"))
    emails = (customer.select(F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"),
                                       F.lit("@example.org")).alias("email"))
              .unionByName(supplier.select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string"),
                                                    F.lit("@example.org")).alias("email")))
              .unionByName(nation.select(F.concat(F.lit("nobody."), F.col("n_nationkey").cast("string"),
                                                  F.lit("@example.org")).alias("email"))))
    return directory.find_users_by_email(emails, c.users, c.students, c.teachers, c.management)


def q15_find_users_by_domain_id(spark, sf_dir):
    c = _campus(spark, sf_dir)
    orders, supplier, nation = (_raw(spark, sf_dir, n) for n in ("orders", "supplier", "nation"))
    keys = (orders.select(F.concat(F.lit("stu_"), F.col("o_custkey").cast("string")).alias("domain_id"))
            .unionByName(supplier.select(F.concat(F.lit("tea_"), F.col("s_suppkey").cast("string"))
                                         .alias("domain_id")))
            .unionByName(nation.select(F.concat(F.lit("ghost_"), F.col("n_nationkey").cast("string"))
                                       .alias("domain_id"))))
    return directory.find_users_by_domain_id(keys, c.users)


def q15_find_users_by_id(spark, sf_dir):
    c = _campus(spark, sf_dir)
    orders, supplier = (_raw(spark, sf_dir, n) for n in ("orders", "supplier"))
    keys = (orders.select(student_user(F.col("o_custkey")).alias("user_id"))
            .unionByName(supplier.select(teacher_user(F.col("s_suppkey")).alias("user_id")))
            .unionByName(supplier.select(unknown_user(F.col("s_suppkey")).alias("user_id"))))
    return directory.find_users_by_id(keys, c.users)


def q18_attendance_sheet(spark, sf_dir):
    c = _campus(spark, sf_dir)
    overrides = c.attendance.select("course_id", "student_id", "status",
                                    F.col("attendance_id").alias("seq"))
    return learning.attendance_sheet(c.enrollments, overrides)


def q19_display_grades(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.display_rows(
        learning.student_grades(c.students, c.grades, c.assignments, c.courses), "grades")


def q19_display_courses(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.display_rows(learning.student_courses(c.students, c.enrollments, c.courses), "courses")


def q19_display_attendance(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.display_rows(learning.student_attendance(c.students, c.attendance, c.courses),
                                 "attendance")


def q19_display_roster(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.display_rows(learning.course_roster(c.students, c.enrollments, c.courses), "roster")


def q19_display_catalog(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.display_rows(learning.course_catalog(c.courses, c.teachers, c.enrollments), "catalog")


def q19_display_stats(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.display_rows(learning.attendance_stats(c.students, c.attendance, c.courses), "stats")


def q19_display_numbers(spark, sf_dir):
    """Progress texts of whole numbers, prices, and numbers of five decimals."""
    c, li = _campus(spark, sf_dir), _raw(spark, sf_dir, "lineitem")
    known = c.courses.select("course_id", "course_name", "course_code")
    kinds = F.array(*[F.struct(F.lit(kind).alias("status"), progress.alias("progress")) for kind, progress in (
        ("whole", F.col("l_quantity").cast("double")), ("price", F.col("l_extendedprice").cast("double")),
        ("small", F.concat(F.col("l_linenumber").cast("string"), F.lit("e-5")).cast("double")),
        ("none", F.lit(0.0)), ("missing", F.lit(None).cast("double")))])
    # Lines meet their courses once, before each becomes five rows.
    lines = li.select(F.col("l_orderkey").alias("student_id"), F.col("l_partkey").alias("course_id"), "l_quantity", "l_extendedprice", "l_linenumber")
    joined = (lines.join(known, "course_id").withColumn("kind", F.explode(kinds))
              .select("student_id", F.col("course_id").alias("id"), F.col("course_name").alias("name"),
                      F.col("course_code").alias("code"), "kind.status", "kind.progress"))
    return learning.display_rows(joined, "courses")


def q19_display_teacher_courses(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.display_rows(learning.teacher_course_load(c.teachers, c.courses, c.enrollments), "teacher_courses")


# The key-filtered forms that the application runs on every call.
ONE_STUDENT, ONE_TEACHER, ONE_COURSE = 7 * 4 + 1, 4 * 4 + 2, 12


def q04_student_courses_one(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.student_courses(c.students, c.enrollments, c.courses, user_id=ONE_STUDENT)


def q05_student_grades_one(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.student_grades(c.students, c.grades, c.assignments, c.courses, user_id=ONE_STUDENT)


def q07_attendance_stats_one(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.attendance_stats(c.students, c.attendance, c.courses, user_id=ONE_STUDENT)


def q09_fee_detail_one(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return billing.fee_detail(c.students, c.fees, user_id=ONE_STUDENT)


def q10_fee_stats_one(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return billing.fee_stats(c.students, c.fees, user_id=ONE_STUDENT)


def q11_teacher_course_load_one(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.teacher_course_load(c.teachers, c.courses, c.enrollments, user_id=ONE_TEACHER)


def q12_course_roster_one(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.course_roster(c.students, c.enrollments, c.courses, course_id=ONE_COURSE)


def q13_course_catalog_teacher(spark, sf_dir):
    c = _campus(spark, sf_dir)
    return learning.course_catalog(c.courses, c.teachers, c.enrollments, teacher_id=4)


def _sorted(df, operator):
    """The rows through the presentation order (the order itself is tested)."""
    return present(df, operator)


def q05_student_grades_sorted(spark, sf_dir):
    return _sorted(q05_student_grades(spark, sf_dir), "student_grades")


def q13_course_catalog_sorted(spark, sf_dir):
    return _sorted(q13_course_catalog(spark, sf_dir), "course_catalog")


def s01_snapshot_round_trip(spark, sf_dir):
    """Users written as a snapshot and scanned again."""
    root = scratch_path(spark, "snapshot")
    write_snapshot(_campus(spark, sf_dir).users, f"{root}/users")
    return read_table(spark, root, "users")


def s03_changes_from_json(spark, sf_dir):
    """Payment requests emitted as JSON lines and read as changes."""
    from rollbook.registry_changes import batch_pay_fees
    path = write_result(batch_pay_fees(spark, sf_dir), scratch_path(spark, "requests"))
    return read_changes(spark, path, batch_pay_fees(spark, sf_dir).schema)


def _request_lines(spark, sf_dir) -> DataFrame:
    """One line of JSON per customer; each segment but one has its own fault."""
    seg, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    name = F.to_json(F.struct(F.col("c_custkey").alias("seq"), F.col("c_name").alias("title"), F.struct(F.lit("x").alias("code")).alias("fields")))
    return _raw(spark, sf_dir, "customer").select(
        F.when(seg == "MACHINERY", F.concat(F.lit('{"seq": '), key, F.lit(', "title"')))
         .when(seg == "HOUSEHOLD", F.concat(F.lit('{"seq": "no'), key, F.lit('", "user_id": true}')))
         .when(seg == "FURNITURE", F.concat(F.lit('[{"seq": '), key, F.lit("}]")))
         .when(seg == "AUTOMOBILE", F.concat(F.lit('{"seq": "'), key, F.lit('", "user_id": '), key, F.lit('.0, "title": null, "fields": {"name": null, "code": 7}}')))
         .otherwise(name).alias("value"))


def s03_requests_or_rejects(spark, sf_dir):
    """S3: lines of JSON, well formed and not; each is a request or a reject."""
    path = scratch_path(spark, "request-lines")
    _request_lines(spark, sf_dir).write.mode("errorifexists").text(path)
    schema = T.StructType.fromDDL("seq long, user_id long, title string, fields map<string,string>")
    requests, rejects = read_requests(spark, path, schema, "fields")
    null = F.lit(None)
    return (requests.select("seq", "user_id", "title", F.col("fields")["code"].alias("code"), F.map_contains_key("fields", F.lit("name")).alias("clears_name"),
                            null.cast("string").alias("line"), null.cast("string").alias("reason"))
            .unionByName(rejects.select(null.cast("long").alias("seq"), null.cast("long").alias("user_id"), null.cast("string").alias("title"),
                                        null.cast("string").alias("code"), null.cast("boolean").alias("clears_name"), "line", "reason")))


def batch_reads(spark, sf_dir) -> DataFrame:
    """One read request per customer and supplier; some name nobody's id, and
    to a student's read every teacher is unknown."""
    customer, supplier = _raw(spark, sf_dir, "customer"), _raw(spark, sf_dir, "supplier")
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    return (customer.select((c * 2).alias("seq"), F.when(F.col("c_mktsegment") == "BUILDING", unknown_user(c)).otherwise(student_user(c)).alias("user_id"))
            .unionByName(supplier.select((s * 2 + 1).alias("seq"), F.when(F.col("s_acctbal") < 0, unknown_user(s)).otherwise(teacher_user(s)).alias("user_id"))))


def _read_requests(spark, sf_dir) -> dict:
    """name -> (rows, rejects) of the reads that answer "not found"."""
    c, requests = _campus(spark, sf_dir), batch_reads(spark, sf_dir)
    student, teacher = role_key(c.students, "student_id"), role_key(c.teachers, "teacher_id")
    profiles = {"q02_student_profile": (directory.student_profile(c.students, c.users), "Student profile not found"),
                "q03_teacher_profile": (directory.teacher_profile(c.teachers, c.users), "Teacher profile not found"),
                "q01_user_by_id": (directory.user_directory(c.users, c.students, c.teachers, c.management)
                                   .withColumnRenamed("id", "user_id"), MSG_USER_NOT_FOUND)}
    by_key = {"q09_fee_detail": (student, billing.fee_detail(c.students, c.fees), "student_id", MSG_STUDENT_NOT_FOUND),
              "q10_fee_stats": (student, billing.fee_stats(c.students, c.fees), "student_id", MSG_STUDENT_NOT_FOUND),
              "q11_teacher_course_load": (teacher, learning.teacher_course_load(c.teachers, c.courses, c.enrollments), "teacher_id", MSG_TEACHER_NOT_FOUND)}
    return ({n: read_for(requests, rows.select("user_id").distinct(), rows, "user_id", m) for n, (rows, m) in profiles.items()}
            | {n: read_for(requests, *args) for n, args in by_key.items()})


def _request_queries() -> dict:
    names = ["q01_user_by_id", "q02_student_profile", "q03_teacher_profile", "q09_fee_detail", "q10_fee_stats", "q11_teacher_course_load"]
    out = {f"{n}_requests": (lambda s, d, n=n: _read_requests(s, d)[n][0]) for n in names}
    return out | {f"{n}_requests_rejects": (lambda s, d, n=n: _read_requests(s, d)[n][1]) for n in names}


READS: dict[str, Query] = {name: fn for name, fn in dict(globals()).items()
                           if name[0] in "qs" and name[1:3].isdigit() and callable(fn)}


def queries() -> dict[str, Query]:
    from rollbook.registry_changes import CHANGES
    from rollbook.registry_declared import DECLARED
    out = {**READS, **_request_queries()}
    out.update(CHANGES)
    out.update(DECLARED)
    return out

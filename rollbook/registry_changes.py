"""Registered change batches.  Each batch is derived by Spark from a whole
driver table (one or two requests per customer, supplier, nation, part,
order, document, grade or enrollment); data values pick the variant of each
request (valid, duplicate, unknown key, missing field, wrong owner), so every
check path is exercised and the batch grows with the data.

Each C operator has an entry for its changed table(s) and one for its rejects.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators import access, changes
from rollbook.plans.materialize import scratch_path
from rollbook.sources.snapshots import create_snapshot
from rollbook.sources.campus import driver_table, load_driver, management_user, pin, student_user, teacher_user, unknown_user

AS_OF = dt.datetime(2025, 1, 15, 9, 30, 0)


def _raw(spark, sf_dir, name) -> DataFrame:
    return driver_table(spark, sf_dir, name)


def _seq(key: str, family: int) -> F.Column:
    """A request number of its own for each key and request family."""
    return (F.col(key).cast("long") * 5 + family).alias("seq")


def _s(c) -> F.Column:
    return F.col(c).cast("string")


# ---------------------------------------------------------------- batches
def batch_create_users(spark, sf_dir) -> DataFrame:
    c = _raw(spark, sf_dir, "customer")
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    return c.select(
        F.col("c_custkey").alias("seq"),
        F.when(seg == "BUILDING", F.concat(F.lit("stu_"), _s("c_custkey")))
         .when(seg == "MACHINERY", F.concat(F.lit("new_"), _s("c_nationkey")))
         .otherwise(F.concat(F.lit("cust_"), _s("c_custkey"))).alias("domain_id"),
        F.when(bal < 0, F.lit("")).otherwise(F.concat(F.lit("pw"), _s("c_custkey"))).alias("password"),
        F.when(seg == "HOUSEHOLD", F.lit("teacher")).when(seg == "AUTOMOBILE", F.lit("guest"))
         .when((seg == "FURNITURE") & (bal > 8000), F.lit("management"))
         .otherwise(F.lit("student")).alias("role"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(seg), F.lit(".new"), _s("c_custkey"), F.lit("@example.org")).alias("email"),
        F.when(bal > 5000, F.lit("")).otherwise(F.concat(F.lit("555-"), _s("c_custkey"))).alias("phone_number"),
        F.when(seg == "HOUSEHOLD", F.concat(F.lit("Dept "), _s("c_nationkey"))).alias("department"),
        seg.alias("address"),
        F.when(bal.between(0, 1500), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("N"), _s("c_custkey"))).alias("roll_number"))


def batch_update_users(spark, sf_dir) -> DataFrame:
    c = _raw(spark, sf_dir, "customer")
    s = _raw(spark, sf_dir, "supplier")
    n = _raw(spark, sf_dir, "nation")
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    null = F.lit(None).cast("string")
    students = c.select(
        _seq("c_custkey", 0), student_user(F.col("c_custkey")).alias("user_id"),
        F.when(bal > 5000, F.upper("c_name")).otherwise(F.lit("")).alias("name"),
        F.when(seg == "AUTOMOBILE", F.concat(F.lit("new."), _s("c_custkey"), F.lit("@example.org")))
         .alias("email"),
        F.concat(F.lit("+1-555-"), _s("c_custkey")).alias("phone_number"),
        F.lit("ignored").alias("department"),
        F.when(bal < 0, F.lit("")).otherwise(F.concat(seg, F.lit(" Hall"))).alias("address"))
    again = c.where(seg == "FURNITURE").select(
        _seq("c_custkey", 1), student_user(F.col("c_custkey")).alias("user_id"),
        F.concat(F.col("c_name"), F.lit(" II")).alias("name"), null.alias("email"),
        null.alias("phone_number"), null.alias("department"), null.alias("address"))
    teachers = s.select(
        _seq("s_suppkey", 2), teacher_user(F.col("s_suppkey")).alias("user_id"),
        null.alias("name"), F.lit("").alias("email"), null.alias("phone_number"),
        F.concat(F.lit("Dept "), _s("s_nationkey")).alias("department"), F.lit("nowhere").alias("address"))
    mgmt = n.select(
        _seq("n_nationkey", 3), management_user(F.col("n_nationkey")).alias("user_id"),
        F.lower("n_name").alias("name"), null.alias("email"), F.lit("").alias("phone_number"),
        F.lit("x").alias("department"), F.lit("y").alias("address"))
    unknown = n.select(
        _seq("n_nationkey", 4), unknown_user(F.col("n_nationkey")).alias("user_id"),
        F.lit("Ghost").alias("name"), null.alias("email"), null.alias("phone_number"),
        null.alias("department"), null.alias("address"))
    return students.unionByName(again).unionByName(teachers).unionByName(mgmt).unionByName(unknown)


def batch_delete_users(spark, sf_dir) -> DataFrame:
    c = _raw(spark, sf_dir, "customer")
    s = _raw(spark, sf_dir, "supplier")
    first = c.select(_seq("c_custkey", 0),
                     F.when(F.col("c_mktsegment") == "BUILDING", student_user(F.col("c_custkey")))
                      .otherwise(unknown_user(F.col("c_custkey"))).alias("user_id"))
    again = c.where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)).select(
        _seq("c_custkey", 1), student_user(F.col("c_custkey")).alias("user_id"))
    teachers = s.where(F.col("s_acctbal") < 0).select(
        _seq("s_suppkey", 2), teacher_user(F.col("s_suppkey")).alias("user_id"))
    return first.unionByName(again).unionByName(teachers)


def batch_create_courses(spark, sf_dir) -> DataFrame:
    p = _raw(spark, sf_dir, "part")
    t = F.col("p_type")
    return p.select(
        F.col("p_partkey").alias("seq"),
        F.when(t == "PROMO", F.concat(F.col("p_brand"), F.lit("-"), _s("p_partkey")))
         .when(t == "SMALL", F.concat(F.lit("NEW-"), F.col("p_brand")))
         .when(t == "LARGE", F.lit(""))
         .otherwise(F.concat(F.lit("X-"), _s("p_partkey"))).alias("course_code"),
        F.concat(F.lit("Advanced "), F.col("p_name")).alias("course_name"),
        F.when(t == "MEDIUM", F.lit("")).otherwise(F.lit("Mon 9:00")).alias("schedule"),
        F.when(t == "ECONOMY", -F.col("p_size")).when(t == "STANDARD", F.lit(0))
         .otherwise(F.col("p_size")).cast("long").alias("teacher_id"))


def batch_update_courses(spark, sf_dir) -> DataFrame:
    p = _raw(spark, sf_dir, "part")
    t = F.col("p_type")
    m = F.create_map
    fields = (F.when(t == "ECONOMY", m(F.lit("name"), F.upper("p_name")))
               .when(t == "SMALL", m(F.lit("code"), F.concat(F.lit("NEW-"), F.col("p_brand"))))
               .when(t == "MEDIUM", m(F.lit("teacher_id"), F.lit(None).cast("string")))
               .when(t == "LARGE", m(F.lit("teacher_id"), (F.col("p_size") + 95).cast("string")))
               .when(t == "STANDARD", m(F.lit("description"), F.col("p_name"),
                                        F.lit("code"), F.concat(F.col("p_brand"), F.lit("-"), _s("p_partkey"))))
               .otherwise(m(F.lit("name"), F.lit(""))))
    return p.select(
        F.col("p_partkey").alias("seq"),
        F.when((t == "MEDIUM") & (F.col("p_size") > 45), -F.col("p_partkey") - 1)
         .otherwise(F.col("p_partkey")).alias("course_id"),
        fields.alias("fields"))


def batch_course_codes(spark, sf_dir) -> DataFrame:
    """Courses ask for a code that ten of them share; those of type LARGE go on
    to a code of their own and so free what they had got; others ask then."""
    p = _raw(spark, sf_dir, "part")
    shared = F.concat(F.lit("POOL-"), F.floor(F.col("p_partkey") / 10).cast("string"))
    rows = None
    for turn, types, code in ((0, ["SMALL", "LARGE", "ECONOMY"], shared), (1, ["LARGE"], F.concat(F.lit("FREE-"), _s("p_partkey"))), (2, ["PROMO", "STANDARD"], shared)):
        part = p.where(F.col("p_type").isin(types)).select(
            (F.lit(turn).cast("long") * 1_000_000_000_000 + F.col("p_partkey")).alias("seq"), F.col("p_partkey").alias("course_id"), F.create_map(F.lit("code"), code).alias("fields"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def batch_delete_courses(spark, sf_dir) -> DataFrame:
    p = _raw(spark, sf_dir, "part")
    promo = F.col("p_type") == "PROMO"
    first = p.select((F.col("p_partkey") * 2).alias("seq"),
                     F.when(promo, F.col("p_partkey")).otherwise(-F.col("p_partkey") - 1)
                      .alias("course_id"))
    again = p.where(promo & (F.col("p_size") > 25)).select(
        (F.col("p_partkey") * 2 + 1).alias("seq"), F.col("p_partkey").alias("course_id"))
    return first.unionByName(again)


def _teacher_user(size_col: F.Column, wrong: F.Column) -> F.Column:
    """The course's teacher as a user id (course teacher = p_size, none when
    p_size is a multiple of 10); ``wrong`` picks the next teacher instead."""
    return teacher_user(F.when(wrong, size_col + 1).otherwise(size_col))


def batch_update_grades(campus, spark, sf_dir) -> DataFrame:
    g = campus.grades.select("grade_id", "assignment_id", "grade", "feedback")
    g = g.withColumn("course_id", F.floor(F.col("assignment_id") / 10).cast("long")) \
         .join(campus.courses.select("course_id", "teacher_id"), "course_id", "left")
    tuser = teacher_user(F.when(F.col("feedback") == "A", F.col("teacher_id") + 1).otherwise(F.col("teacher_id")))
    first = F.struct(F.concat("grade_id", F.lit("#1")).alias("seq"),
                     F.when(F.col("grade") == "1", F.lit("")).otherwise(F.concat("grade", F.lit("/50")))
                      .alias("grade"),
                     F.when(F.col("feedback").isNotNull(), F.concat(F.lit("Reviewed "), F.col("feedback")))
                      .alias("feedback"))
    again = F.struct(F.concat("grade_id", F.lit("#2")).alias("seq"), F.lit("A+").alias("grade"),
                     F.lit(None).cast("string").alias("feedback"))
    # One or two requests a grade, from one join.
    asked = F.explode(F.when(F.col("feedback") == "R", F.array(first, again)).otherwise(F.array(first)))
    return (g.select("grade_id", tuser.alias("teacher_user_id"), asked.alias("r"))
            .select("r.seq", "teacher_user_id", "grade_id", "r.grade", "r.feedback"))


def batch_attendance(campus, spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = _raw(spark, sf_dir, "part")
    size = F.col("p_size")
    requests = p.select(
        F.col("p_partkey").alias("seq"),
        _teacher_user(size, F.col("p_type") == "STANDARD").alias("teacher_user_id"),
        F.col("p_partkey").alias("course_id"),
        (F.col("p_type") != "SMALL").alias("records_given"))
    e = campus.enrollments
    records = e.select(
        F.col("course_id").alias("seq"), (-F.col("student_id")).alias("record_pos"), "student_id",
        F.when(F.col("progress") >= 0.09, F.lit("excused"))
         .when(F.col("enrollment_status") == "F", F.lit("present"))
         .otherwise(F.lit("absent")).alias("status"))
    return requests, records


def batch_create_assignments(spark, sf_dir) -> DataFrame:
    p = _raw(spark, sf_dir, "part")
    t, size = F.col("p_type"), F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("seq"),
        _teacher_user(size, t == "PROMO").alias("teacher_user_id"),
        F.col("p_partkey").alias("course_id"),
        F.when((t == "SMALL") & (size < 10), F.lit("")).otherwise(F.concat(F.lit("Project "), F.col("p_name")))
         .alias("title"),
        F.when(t == "LARGE", F.lit("")).otherwise(t).alias("description"),
        F.when(t == "MEDIUM", F.lit(None).cast("string")).when(t == "ECONOMY", F.lit(""))
         .when(t == "SMALL", F.lit("31/12/2025")).otherwise(F.lit("2025-03-01")).alias("due_date"),
        F.when((t == "STANDARD") & (size > 40), F.lit(0)).otherwise(size).cast("decimal(18,0)")
         .alias("total_marks"))


def batch_post_notices(spark, sf_dir) -> DataFrame:
    d = _raw(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"),
        teacher_user(F.floor(F.col("doc_id") / 20)).alias("user_id"),
        F.when(F.col("lang") == "de", F.lit("")).otherwise(F.concat(F.lit("Re: "), F.col("source")))
         .alias("title"),
        F.col("text").alias("content"))


def batch_pay_fees(spark, sf_dir) -> DataFrame:
    o = _raw(spark, sf_dir, "orders")
    pr = F.col("o_orderpriority")
    first = o.select(
        (F.col("o_orderkey") * 2).alias("seq"),
        F.when(pr == "1-URGENT", student_user(F.col("o_custkey") + 1))
         .when(pr == "5-LOW", unknown_user(F.col("o_custkey")))
         .otherwise(student_user(F.col("o_custkey"))).alias("user_id"),
        F.col("o_orderkey").alias("fee_id"))
    again = o.where(pr == "2-HIGH").select(
        (F.col("o_orderkey") * 2 + 1).alias("seq"), student_user(F.col("o_custkey")).alias("user_id"),
        F.col("o_orderkey").alias("fee_id"))
    return first.unionByName(again)


def batch_course_access(spark, sf_dir) -> DataFrame:
    """One roster request per part: the course's teacher, a wrong teacher
    (PROMO), or a non-teacher user (LARGE)."""
    p = _raw(spark, sf_dir, "part")
    t, size = F.col("p_type"), F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("seq"),
        F.when(t == "LARGE", student_user(F.col("p_partkey")))
         .otherwise(_teacher_user(size, t == "PROMO")).cast("long").alias("teacher_user_id"),
        F.col("p_partkey").alias("course_id"))


# ---------------------------------------------------------------- runners
def _c01(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.create_users(c.users, c.students, c.teachers, c.management,
                                batch_create_users(spark, sf_dir), AS_OF)


def batch_register_users(spark, sf_dir) -> DataFrame:
    """The create-users batch with the role left out for the AUTOMOBILE segment
    (registration defaults it to student)."""
    # The address of a request is its customer's segment.
    return batch_create_users(spark, sf_dir).withColumn("role", F.when(F.col("address") != "AUTOMOBILE", F.col("role")))


def _c01r(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.create_users(c.users, c.students, c.teachers, c.management,
                                batch_register_users(spark, sf_dir), AS_OF, register=True)


def _c02(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    # Every fifth manager has no role.
    users = c.users.withColumn("role", F.when((F.col("role") != "management") | (F.col("user_id") % 20 != 3), F.col("role")))
    return changes.update_users(users, c.students, c.teachers, c.management,
                                batch_update_users(spark, sf_dir))


def _c03(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.delete_users(c.users, c.students, c.teachers, c.management, batch_delete_users(spark, sf_dir))


def _c04(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.create_courses(c.courses, c.teachers, batch_create_courses(spark, sf_dir))


def _c05(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.update_courses(c.courses, c.teachers, batch_update_courses(spark, sf_dir), AS_OF)


def _c05_in_order(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.update_courses_in_order(c.courses, c.teachers, batch_course_codes(spark, sf_dir), AS_OF)


def _c06(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.delete_courses(c.courses, c.attendance, c.grades, c.assignments, c.enrollments,
                                  batch_delete_courses(spark, sf_dir))


def _c07(spark, sf_dir):
    c = load_driver(spark, sf_dir).pinned("grades")
    return changes.update_grades(c.grades, c.teachers, c.assignments, c.courses,
                                 pin(batch_update_grades(c, spark, sf_dir)), AS_OF)


def _c08(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    requests, records = batch_attendance(c, spark, sf_dir)
    return changes.take_attendance(c.attendance, c.teachers, c.courses, requests, records, AS_OF)


def _c09(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.create_assignments(c.assignments, c.teachers, c.courses,
                                      batch_create_assignments(spark, sf_dir), AS_OF)


def _c10(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.post_notices(c.notices, batch_post_notices(spark, sf_dir), AS_OF)


def _c11(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.pay_fees(c.fees, c.students, batch_pay_fees(spark, sf_dir), AS_OF.date())


def _q16(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return access.course_access(batch_course_access(spark, sf_dir), c.teachers, c.courses)


def _q17(spark, sf_dir):
    c = load_driver(spark, sf_dir).pinned("grades")
    req = pin(batch_update_grades(c, spark, sf_dir).select("seq", "teacher_user_id", "grade_id"))
    return access.grade_access(req, c.teachers, c.grades, c.assignments, c.courses)


# ---------------------------------------------------------------- stored snapshots
def _kept(spark, df: DataFrame, name: str, key: str):
    """The table as a snapshot of hash partitions in a scratch folder."""
    return create_snapshot(df, scratch_path(spark, f"stored-{name}"), name, key, 16)


def _c02_stored(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    users = c.users.withColumn("role", F.when((F.col("role") != "management") | (F.col("user_id") % 20 != 3), F.col("role")))
    tables = {n: _kept(spark, getattr(c, n), n, "user_id") for n in ("students", "teachers", "management")}
    return changes.stored_update_users(users, tables, batch_update_users(spark, sf_dir))


def _c05_stored(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.stored_update_courses(_kept(spark, c.courses, "courses", "course_id"), c.teachers, batch_update_courses(spark, sf_dir), AS_OF)


def _c06_stored(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    keys = {"courses": "course_id", "attendance": "attendance_id", "grades": "grade_id", "assignments": "course_id", "enrollments": "course_id"}
    return changes.stored_delete_courses({n: _kept(spark, getattr(c, n), n, k) for n, k in keys.items()}, batch_delete_courses(spark, sf_dir))


def _c07_stored(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    kept = _kept(spark, c.grades, "grades", "grade_id")
    batch = pin(batch_update_grades(c.with_tables(grades=kept.read()), spark, sf_dir))
    return changes.stored_update_grades(kept, c.teachers, c.assignments, c.courses, batch, AS_OF)


def _c08_stored(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    requests, records = batch_attendance(c, spark, sf_dir)
    return changes.stored_take_attendance(_kept(spark, c.attendance, "attendance", "attendance_id"), c.teachers, c.courses, requests, records, AS_OF)


def _c09_stored(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.stored_create_assignments(_kept(spark, c.assignments, "assignments", "assignment_id"), c.teachers, c.courses,
                                             batch_create_assignments(spark, sf_dir), AS_OF)


def _c10_stored(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.stored_post_notices(_kept(spark, c.notices, "notices", "notice_id"), batch_post_notices(spark, sf_dir), AS_OF)


def _c11_stored(spark, sf_dir):
    c = load_driver(spark, sf_dir)
    return changes.stored_pay_fees(_kept(spark, c.fees, "fees", "fee_id"), c.students, batch_pay_fees(spark, sf_dir), AS_OF.date())


#: Name of the plain form -> the same table from stored snapshots; the answers are the same.
STORED = {
    "c02_update_users_students": lambda s, d: _c02_stored(s, d)[0]["students"].read(),
    "c05_update_courses": lambda s, d: _c05_stored(s, d)[0].read(),
    "c06_delete_courses_grades": lambda s, d: _c06_stored(s, d)[0]["grades"].read(),
    "c06_delete_courses_enrollments": lambda s, d: _c06_stored(s, d)[0]["enrollments"].read(),
    "c07_update_grades": lambda s, d: _c07_stored(s, d)[0].read(),
    "c07_update_grades_rejects": lambda s, d: _c07_stored(s, d)[1],
    "c08_take_attendance": lambda s, d: _c08_stored(s, d)[0].read(),
    "c09_create_assignments": lambda s, d: _c09_stored(s, d)[0].read(),
    "c10_post_notices": lambda s, d: _c10_stored(s, d)[0].read(),
    "c11_pay_fees": lambda s, d: _c11_stored(s, d)[0].read(),
    "c11_pay_fees_rejects": lambda s, d: _c11_stored(s, d)[1],
}

CHANGES = {
    "q16_course_access": lambda s, d: _q16(s, d)[0].select("seq", "teacher_user_id", "course_id", "teacher_id"),
    "q16_course_access_rejects": lambda s, d: _q16(s, d)[1],
    "q17_grade_access": lambda s, d: _q17(s, d)[0].select("seq", "teacher_user_id", "grade_id", "teacher_id"),
    "q17_grade_access_rejects": lambda s, d: _q17(s, d)[1],
    "c01_create_users": lambda s, d: _c01(s, d)[0]["users"],
    "c01_create_users_students": lambda s, d: _c01(s, d)[0]["students"],
    "c01_create_users_teachers": lambda s, d: _c01(s, d)[0]["teachers"],
    "c01_create_users_management": lambda s, d: _c01(s, d)[0]["management"],
    "c01_create_users_created": lambda s, d: _c01(s, d)[0]["created"],
    "c01_create_users_rejects": lambda s, d: _c01(s, d)[1],
    "c01_register_users": lambda s, d: _c01r(s, d)[0]["users"],
    "c01_register_users_students": lambda s, d: _c01r(s, d)[0]["students"],
    "c01_register_users_teachers": lambda s, d: _c01r(s, d)[0]["teachers"],
    "c01_register_users_management": lambda s, d: _c01r(s, d)[0]["management"],
    "c01_register_users_created": lambda s, d: _c01r(s, d)[0]["created"],
    "c01_register_users_rejects": lambda s, d: _c01r(s, d)[1],
    "c02_update_users_students": lambda s, d: _c02(s, d)[0]["students"],
    "c02_update_users_teachers": lambda s, d: _c02(s, d)[0]["teachers"],
    "c02_update_users_management": lambda s, d: _c02(s, d)[0]["management"],
    "c02_update_users_updated": lambda s, d: _c02(s, d)[0]["updated"],
    "c02_update_users_rejects": lambda s, d: _c02(s, d)[1],
    "c03_delete_users": lambda s, d: _c03(s, d)[0]["users"],
    "c03_delete_users_students": lambda s, d: _c03(s, d)[0]["students"],
    "c03_delete_users_teachers": lambda s, d: _c03(s, d)[0]["teachers"],
    "c03_delete_users_management": lambda s, d: _c03(s, d)[0]["management"],
    "c03_delete_users_rejects": lambda s, d: _c03(s, d)[1],
    "c04_create_courses": lambda s, d: _c04(s, d)[0]["courses"],
    "c04_create_courses_created": lambda s, d: _c04(s, d)[0]["created"],
    "c04_create_courses_rejects": lambda s, d: _c04(s, d)[1],
    "c05_update_courses": lambda s, d: _c05(s, d)[0],
    "c05_update_courses_updated": lambda s, d: _c05(s, d)[1],
    "c05_update_courses_rejects": lambda s, d: _c05(s, d)[2],
    "c05_update_courses_in_order": lambda s, d: _c05_in_order(s, d)[0],
    "c05_update_courses_in_order_rejects": lambda s, d: _c05_in_order(s, d)[2],
    "c06_delete_courses": lambda s, d: _c06(s, d)[0]["courses"],
    "c06_delete_courses_grades": lambda s, d: _c06(s, d)[0]["grades"],
    "c06_delete_courses_attendance": lambda s, d: _c06(s, d)[0]["attendance"],
    "c06_delete_courses_enrollments": lambda s, d: _c06(s, d)[0]["enrollments"],
    "c06_delete_courses_assignments": lambda s, d: _c06(s, d)[0]["assignments"],
    "c06_delete_courses_rejects": lambda s, d: _c06(s, d)[1],
    "c07_update_grades": lambda s, d: _c07(s, d)[0],
    "c07_update_grades_rejects": lambda s, d: _c07(s, d)[1],
    "c08_take_attendance": lambda s, d: _c08(s, d)[0]["attendance"],
    "c08_take_attendance_rejects": lambda s, d: _c08(s, d)[1],
    "c09_create_assignments": lambda s, d: _c09(s, d)[0]["assignments"],
    "c09_create_assignments_created": lambda s, d: _c09(s, d)[0]["created"],
    "c09_create_assignments_rejects": lambda s, d: _c09(s, d)[1],
    "c10_post_notices": lambda s, d: _c10(s, d)[0]["notices"],
    "c10_post_notices_created": lambda s, d: _c10(s, d)[0]["created"],
    "c10_post_notices_rejects": lambda s, d: _c10(s, d)[1],
    "c11_pay_fees": lambda s, d: _c11(s, d)[0],
    "c11_pay_fees_rejects": lambda s, d: _c11(s, d)[1],
}
CHANGES |= {f"{n}_stored": q for n, q in STORED.items()}

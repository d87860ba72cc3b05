"""The campus tables, either read from canonical snapshots or derived from
the driver's TPC-H-style tables (role mapping).

Role mapping (every derived table covers its whole source table):

* students    <- customer     (user ids interleaved by role: ``student_user`` etc.)
* teachers    <- supplier (+ nation for the department)
* management  <- nation
* users       <- union of the three role tables; a student's created_at is
                 the date of the customer's first order
* courses     <- part; teacher_id is p_size, NULL when p_size is a multiple of 10
* enrollments <- lineitem joined to orders (one enrollment per line)
* attendance  <- events; course from the event's JSON ``k`` property,
                 status from the event type (signup -> 'late', a status no
                 statistic counts)
* fees        <- orders; status from o_orderstatus
* assignments <- distinct (part, line number) of lineitem
* grades      <- lineitem joined to orders, one grade per
                 (order, line number, part, customer)
* notices     <- documents (whole text as content)
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.schema import MARKS, TABLES
from rollbook.sources.io import conform, read_table

# Fixed values of the mapping.
ASSIGNMENT_MARKS = 50
ATTENDANCE_STATUS = {"click": "present", "view": "present", "error": "absent",
                     "purchase": "excused", "signup": "late"}
FEE_STATUS = {"F": "paid", "P": "pending", "O": "unpaid"}


def student_user(key: Column) -> Column:
    """User ids interleave the roles (key * 4 + role), so they cannot meet
    however large the role tables grow; multiples of 4 are nobody's."""
    return key.cast("long") * 4 + 1


def teacher_user(key: Column) -> Column:
    return key.cast("long") * 4 + 2


def management_user(key: Column) -> Column:
    return key.cast("long") * 4 + 3


def unknown_user(key: Column) -> Column:
    return key.cast("long") * 4


@dataclass(frozen=True)
class Campus:
    users: DataFrame
    students: DataFrame
    teachers: DataFrame
    management: DataFrame
    courses: DataFrame
    enrollments: DataFrame
    attendance: DataFrame
    assignments: DataFrame
    grades: DataFrame
    notices: DataFrame
    fees: DataFrame

    def with_tables(self, **tables: DataFrame) -> "Campus":
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def pin(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once as a table in the shared checkpoint folder: whole
    tables and batches with keys of text, so compressed well."""
    from rollbook.plans.materialize import materialize
    return materialize(df, "pin", "zstd")


def load_snapshots(spark: SparkSession, root: str) -> Campus:
    """Read the eleven canonical tables from ``root/<name>``."""
    return Campus(**{name: read_table(spark, root, name) for name in TABLES})


_DRIVER_READS: dict[tuple[int, str], tuple[SparkSession, DataFrame]] = {}


def driver_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the driver's (read-only) input tables.

    The DataFrame handle is reused within a session, so its file listing
    and footers are read once rather than by every query; the inputs never
    change while a session runs.
    """
    path = f"{root.rstrip('/')}/{name}.parquet"
    hit = _DRIVER_READS.get((id(spark), path))
    if hit is not None and hit[0] is spark:
        return hit[1]
    df = spark.read.parquet(path)
    _DRIVER_READS[(id(spark), path)] = (spark, df)
    return df


_driver = driver_table


def _case_map(c: str, mapping: dict[str, str]):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(c) == k, F.lit(v)) if expr is None
                else expr.when(F.col(c) == k, F.lit(v)))
    return expr


class _DriverTables:
    """The driver's raw tables, each read on first use."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root, self._cache = spark, root, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = _driver(self._spark, self._root, name)
        return self._cache[name]


class LazyCampus(Campus):
    """A Campus whose tables are derived only when first accessed, so a query
    that needs two tables does not read or analyze the other nine."""

    def __init__(self, builders: dict):  # noqa: D107 - dataclass fields are filled lazily
        object.__setattr__(self, "_builders", builders)
        object.__setattr__(self, "_built", {})

    def __getattribute__(self, name: str):
        builders = object.__getattribute__(self, "_builders")
        if name in builders:
            built = object.__getattribute__(self, "_built")
            if name not in built:
                built[name] = builders[name]()
            return built[name]
        return object.__getattribute__(self, name)

    def with_tables(self, **tables: DataFrame) -> Campus:
        builders = object.__getattribute__(self, "_builders")
        return LazyCampus(builders | {n: (lambda d=df: d) for n, df in tables.items()})

    def pinned(self, *names: str) -> "LazyCampus":
        """The same campus with the named derived tables materialized once
        (reliable checkpoint): for jobs that read a derived table several
        times, so its derivation runs once."""
        builders = dict(object.__getattribute__(self, "_builders"))
        for n in names:
            df = getattr(self, n)
            builders[n] = (lambda d=pin(df): d)
        return LazyCampus(builders)


def load_driver(spark: SparkSession, root: str) -> Campus:
    """Derive the campus tables from the driver's tables under ``root``.

    Tables are built lazily (on first access) and shared within the Campus.
    """
    raw = _DriverTables(spark, root)

    def get(name):
        return getattr(lazy, name)

    builders = {name: (lambda n=name: _BUILDERS[n](raw, get)) for name in TABLES}
    lazy = LazyCampus(builders)
    return lazy


def _null_s():
    return F.lit(None).cast("string")


def _students(raw, get):
    return conform(raw.customer.select(
        F.col("c_custkey").alias("student_id"),
        student_user(F.col("c_custkey")).alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("roll_number"),
        F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"),
                 F.lit("@example.org")).alias("email"),
        _null_s().alias("phone_number"),
        F.col("c_mktsegment").alias("address")), "students")


def _teachers(raw, get):
    supplier, nation = raw.supplier, raw.nation
    return conform(
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select(
            F.col("s_suppkey").alias("teacher_id"),
            teacher_user(F.col("s_suppkey")).alias("user_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("t"), F.col("s_suppkey").cast("string"), F.lit("@example.org")).alias("email"),
            _null_s().alias("phone_number"),
            F.col("n_name").alias("department")), "teachers")


def _management(raw, get):
    return conform(raw.nation.select(
        F.col("n_nationkey").cast("long").alias("management_id"),
        management_user(F.col("n_nationkey")).alias("user_id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("m"), F.col("n_nationkey").cast("string"), F.lit("@example.org")).alias("email"),
        _null_s().alias("phone_number")), "management")


def _users(raw, get):
    # First order per customer, aggregated before the join (partial aggregation).
    first_order = raw.orders.groupBy(F.col("o_custkey").alias("student_id")).agg(
        F.min("o_orderdate").alias("created_at"))
    students, teachers, management = get("students"), get("teachers"), get("management")
    return conform(
        students.join(first_order, "student_id", "left").select(
            "user_id",
            F.concat(F.lit("stu_"), F.col("student_id").cast("string")).alias("domain_id"),
            F.lit("student").alias("role"), "created_at")
        .unionByName(teachers.select(
            "user_id", F.concat(F.lit("tea_"), F.col("teacher_id").cast("string")).alias("domain_id"),
            F.lit("teacher").alias("role"), F.lit(None).cast("timestamp_ntz").alias("created_at")))
        .unionByName(management.select(
            "user_id", F.concat(F.lit("mgt_"), F.col("management_id").cast("string")).alias("domain_id"),
            F.lit("management").alias("role"), F.lit(None).cast("timestamp_ntz").alias("created_at"))),
        "users")


def _courses(raw, get):
    return conform(raw.part.select(
        F.col("p_partkey").alias("course_id"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")).alias("course_code"),
        F.col("p_name").alias("course_name"),
        F.col("p_type").alias("schedule"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("long")
         .alias("teacher_id"),
        _null_s().alias("description"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at")), "courses")


def _lines(raw):
    return raw.lineitem.join(raw.orders.select("o_orderkey", "o_custkey"),
                             F.col("l_orderkey") == F.col("o_orderkey"), "inner")


def _enrollments(raw, get):
    return conform(_lines(raw).select(
        F.col("o_custkey").alias("student_id"),
        F.col("l_partkey").alias("course_id"),
        F.col("l_linestatus").alias("enrollment_status"),
        F.abs("l_discount").alias("progress"),
        F.col("l_shipdate").alias("created_at")), "enrollments")


def _attendance(raw, get):
    return conform(raw.events.select(
        F.col("event_id").alias("attendance_id"),
        F.col("user_id").alias("student_id"),
        F.get_json_object("props", "$.k").cast("long").alias("course_id"),
        F.to_date("ts").alias("attendance_date"),
        _case_map("event_type", ATTENDANCE_STATUS).alias("status")), "attendance")


def _fees(raw, get):
    return conform(raw.orders.select(
        F.col("o_orderkey").alias("fee_id"),
        F.col("o_custkey").alias("student_id"),
        F.col("o_totalprice").alias("amount"),
        _case_map("o_orderstatus", FEE_STATUS).alias("payment_status"),
        F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).alias("payment_date")), "fees")


def _assignments(raw, get):
    return conform(
        raw.lineitem.select("l_partkey", "l_linenumber").distinct().select(
            (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("assignment_id"),
            F.col("l_partkey").alias("course_id"),
            F.concat(F.lit("Assignment "), F.col("l_linenumber").cast("string")).alias("title"),
            _null_s().alias("description"),
            F.lit(None).cast("date").alias("due_date"),
            F.lit(ASSIGNMENT_MARKS).cast(MARKS).alias("total_marks"),
            F.lit(None).cast("timestamp_ntz").alias("created_at")), "assignments")


def _grades(raw, get):
    return conform(
        _lines(raw).groupBy("l_orderkey", "l_linenumber", "l_partkey", "o_custkey").agg(
            F.max(F.col("l_quantity").cast("int")).alias("q"),
            # Feedback is the largest return flag other than N.
            F.max(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("feedback"),
            F.max("l_shipdate").alias("submitted_at"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "o_custkey").alias("grade_id"),
            F.col("o_custkey").alias("student_id"),
            (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("assignment_id"),
            F.col("q").cast("string").alias("grade"),
            "feedback", "submitted_at",
            F.lit(None).cast("timestamp_ntz").alias("graded_at")), "grades")


def _notices(raw, get):
    doc = F.col("doc_id")
    # Posters grow in number with the documents; one without a user posts nothing that shows.
    poster = (F.when(doc % 3 == 0, management_user(F.floor(doc / 100)))
              .when(doc % 3 == 1, teacher_user(F.floor(doc / 20)))
              .otherwise(student_user(F.floor(doc / 3))))
    return conform(raw.documents.select(
        doc.alias("notice_id"),
        F.concat(F.lit("Notice "), doc.cast("string"), F.lit(" ("), F.col("source"), F.lit(")")).alias("title"),
        F.col("text").alias("content"),
        poster.cast("long").alias("posted_by_user_id"),
        F.lit(None).cast("timestamp_ntz").alias("created_at")), "notices")


_BUILDERS = {
    "users": _users, "students": _students, "teachers": _teachers, "management": _management,
    "courses": _courses, "enrollments": _enrollments, "attendance": _attendance,
    "assignments": _assignments, "grades": _grades, "notices": _notices, "fees": _fees,
}

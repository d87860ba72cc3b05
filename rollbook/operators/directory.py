"""User directory, profiles and user lookups (set-based)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import contains_any, where_all
from rollbook.operators.search import candidates, narrowed
from rollbook.schema import ROLE_MANAGEMENT, ROLE_STUDENT, ROLE_TEACHER


def _role_pick(role_col, s, t, m):
    """CASE role WHEN student THEN s WHEN teacher THEN t WHEN management THEN m END."""
    return (F.when(role_col == ROLE_STUDENT, s)
             .when(role_col == ROLE_TEACHER, t)
             .when(role_col == ROLE_MANAGEMENT, m))


def user_directory(users: DataFrame, students: DataFrame, teachers: DataFrame,
                   management: DataFrame, role: str | None = None, search: str | None = None,
                   user_id: int | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Q1: ``id, domain_id, role, created_at, name, email`` for every user.

    Name and e-mail come from the role table matching the user's role.
    The search tests domain id, and names and e-mails in *all three* role
    tables whatever the user's role.  All three left joins are on
    ``user_id``, so they share one partitioning of the users side.  With
    ``postings`` (``search.directory_values``) a search reads its candidates only.
    """
    ids = candidates(postings, search) if search and postings is not None else None
    if ids is not None:
        users, students, teachers, management = narrowed([(t, "user_id") for t in (users, students, teachers, management)], ids)
    u = where_all(users, [
        (F.col("user_id") == F.lit(user_id)) if user_id is not None else None,
        (F.col("role") == F.lit(role)) if role else None,
    ])
    s = students.select("user_id", F.col("name").alias("s_name"), F.col("email").alias("s_email"))
    t = teachers.select("user_id", F.col("name").alias("t_name"), F.col("email").alias("t_email"))
    m = management.select("user_id", F.col("name").alias("m_name"), F.col("email").alias("m_email"))
    j = u.join(s, "user_id", "left").join(t, "user_id", "left").join(m, "user_id", "left")
    if search:
        j = j.where(contains_any(["domain_id", "s_name", "t_name", "m_name",
                                  "s_email", "t_email", "m_email"], search))
    r = F.col("role")
    return j.select(F.col("user_id").alias("id"), "domain_id", "role", "created_at",
                    _role_pick(r, F.col("s_name"), F.col("t_name"), F.col("m_name")).alias("name"),
                    _role_pick(r, F.col("s_email"), F.col("t_email"), F.col("m_email")).alias("email"))


def student_profile(students: DataFrame, users: DataFrame, user_id: int | None = None) -> DataFrame:
    """Q2: the student profile of each user that has a Users row."""
    u = users.select("user_id")
    if user_id is not None:
        u = u.where(F.col("user_id") == F.lit(user_id))
    return (students.join(u, "user_id", "left_semi")
            .select("user_id", F.col("student_id").alias("id"), "name", "roll_number", "email",
                    "phone_number", "address"))


def teacher_profile(teachers: DataFrame, users: DataFrame, user_id: int | None = None) -> DataFrame:
    """Q3: the teacher profile of each user that has a Users row."""
    u = users.select("user_id")
    if user_id is not None:
        u = u.where(F.col("user_id") == F.lit(user_id))
    return (teachers.join(u, "user_id", "left_semi")
            .select("user_id", F.col("teacher_id").alias("id"), "name", "email", "phone_number",
                    "department"))


def contacts(students: DataFrame, teachers: DataFrame, management: DataFrame) -> DataFrame:
    """``(user_id, email)`` over the three role tables."""
    return (students.select("user_id", "email")
            .unionByName(teachers.select("user_id", "email"))
            .unionByName(management.select("user_id", "email")))


def find_users_by_email(emails: DataFrame, users: DataFrame, students: DataFrame,
                        teachers: DataFrame, management: DataFrame) -> DataFrame:
    """Q14: for each requested e-mail found in any role table, the user with
    the smallest user id among the matches, and that user's role.

    Contacts are first narrowed to the requested addresses (semi join), then
    reduced to one row per address (partial aggregation, so a popular
    address stays one row), then joined to the users for the role.
    """
    req = emails.select("email").where(F.col("email").isNotNull()).distinct()
    matched = (contacts(students, teachers, management)
               .join(req, "email", "left_semi")
               .join(users.select("user_id"), "user_id", "left_semi"))
    best = matched.groupBy("email").agg(F.min("user_id").alias("user_id"))
    return best.join(users.select("user_id", "role"), "user_id").select("email", "user_id", "role")


def find_users_by_domain_id(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Q15: ``user_id, domain_id, role`` for each requested domain id
    (smallest user id if a domain id were ever held twice)."""
    req = keys.select("domain_id").where(F.col("domain_id").isNotNull()).distinct()
    best = users.join(req, "domain_id", "left_semi").groupBy("domain_id") \
        .agg(F.min("user_id").alias("user_id"))
    return best.join(users.select("user_id", "role"), "user_id").select("user_id", "domain_id", "role")


def find_users_by_id(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Q15 (token check): ``user_id, domain_id, role`` for each requested user id.
    Ids asked for again and again go before the shuffle, so that no task sorts them."""
    return users.join(keys.select("user_id").where(F.col("user_id").isNotNull()).distinct(), "user_id", "left_semi") \
        .select("user_id", "domain_id", "role")

"""User change batches: create/register (C1), update (C2), delete."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import blank_to_null, present_str, ts_ntz
from rollbook.plans.batches import existing_keys, first_claim, flag_existing, gone_before, last_value, reason_of, split, wanted
from rollbook.plans.deferred import Deferred, once
from rollbook.plans.ids import current_max, current_maxes, number_rows, number_rows_by_group
from rollbook.plans.materialize import materialize
from rollbook.schema import (
    MSG_PROFILE_NOT_FOUND, MSG_REGISTER_FIELDS, MSG_ROLL_REQUIRED, MSG_USER_EXISTS,
    MSG_USER_FIELDS, MSG_USER_NOT_FOUND, ROLE_MANAGEMENT, ROLE_STUDENT, ROLE_TEACHER,
)
from rollbook.sources.io import conform

ROLE_TABLES = {ROLE_STUDENT: ("students", "student_id"), ROLE_TEACHER: ("teachers", "teacher_id"),
               ROLE_MANAGEMENT: ("management", "management_id")}


def create_users(users: DataFrame, students: DataFrame, teachers: DataFrame, management: DataFrame,
                 batch: DataFrame, as_of: dt.datetime, register: bool = False
                 ) -> tuple[dict[str, DataFrame], DataFrame]:
    """``batch(seq, domain_id, password, role, name, email, phone_number,
    department, address, roll_number)``.

    Checks in order: required fields (``register`` makes the role optional,
    defaulting to student); the domain id is not taken (by the table or by
    an earlier request of the batch that succeeds); a student has a roll
    number (a failure here takes no id).  The password only counts for the
    first check and is never stored.  An accepted request adds a Users row
    and, for a known role, a row in that role's table; new ids continue
    after each table's maximum in seq order.
    Returns ({users, students, teachers, management, created}, rejects);
    ``created`` is ``id, domain_id, role, name, email`` of each new user.
    """
    role = F.coalesce(blank_to_null("role"), F.lit(ROLE_STUDENT)) if register else blank_to_null("role")
    b = batch.withColumn("role_", role)
    required = ["domain_id", "password", "name", "email"] + ([] if register else ["role"])
    ok_fields = present_str(required[0])
    for c in required[1:]:
        ok_fields = ok_fields & present_str(c)
    # The password only counts for this check; it is dropped before any
    # intermediate is materialized.
    b = b.withColumn("_missing", ~ok_fields).drop("password")
    missing = F.col("_missing")
    b = flag_existing(b, users, ["domain_id"], flag="domain_taken")
    taken = F.col("domain_taken").isNotNull()
    no_roll = (F.col("role_") == F.lit(ROLE_STUDENT)) & ~present_str("roll_number")
    b = first_claim(b, ["domain_id"], ~missing & ~taken & ~no_roll)
    annotated = b.withColumn("reason", reason_of([
        (missing, MSG_REGISTER_FIELDS if register else MSG_USER_FIELDS),
        (taken | (F.col("seq") > F.col("first_seq")), MSG_USER_EXISTS),
        (no_roll, MSG_ROLL_REQUIRED),
    ]))
    ok, rejects = split(annotated, pin=False)
    tables = {"students": students, "teachers": teachers, "management": management}

    @once
    def new():
        accepted = ok.drop("role", "_missing").withColumnRenamed("role_", "role")
        return number_rows(accepted, ["seq"], "user_id", current_max(users, "user_id"))

    @once
    def numbered():
        # All three role tables are numbered in one pass: ids within each role
        # continue after that role table's maximum, in seq order.
        bases = current_maxes({r: (tables[t], k) for r, (t, k) in ROLE_TABLES.items()})
        known = new().where(F.col("role").isin(list(ROLE_TABLES)))
        return number_rows_by_group(known, "role", ["seq"], "role_id", bases)

    def role_table(r: str, tname: str, key: str) -> DataFrame:
        rows = numbered().where(F.col("role") == F.lit(r)).withColumnRenamed("role_id", key)
        cols = {
            "students": [key, "user_id", "name", "roll_number", "email",
                         blank_to_null("phone_number").alias("phone_number"),
                         blank_to_null("address").alias("address")],
            "teachers": [key, "user_id", "name", "email",
                         blank_to_null("phone_number").alias("phone_number"),
                         blank_to_null("department").alias("department")],
            "management": [key, "user_id", "name", "email",
                           blank_to_null("phone_number").alias("phone_number")],
        }[tname]
        return tables[tname].unionByName(conform(rows.select(*cols), tname))

    out = Deferred({
        "users": lambda: users.unionByName(conform(new().select(
            "user_id", "domain_id", "role", ts_ntz(as_of).alias("created_at")), "users")),
        "created": lambda: new().select(F.col("user_id").alias("id"), "domain_id", "role", "name", "email"),
        **{tname: (lambda r=r, t=tname, k=key: role_table(r, t, k))
           for r, (tname, key) in ROLE_TABLES.items()},
    })
    return out, rejects


def update_users(users: DataFrame, students: DataFrame, teachers: DataFrame, management: DataFrame,
                 batch: DataFrame) -> tuple[Deferred, DataFrame]:
    """``batch(seq, user_id, name, email, phone_number, department, address)``.

    Checks: the user exists; the user's role table has a row for it
    ("<role> profile not found").  Non-empty values replace the old ones
    (empty or NULL keeps the old value); ``address`` applies to students,
    ``department`` to teachers; per field the highest seq wins.
    Returns ({students, teachers, management, updated}, rejects); ``updated``
    is each updated user's final profile: ``id, role, name, email,
    phone_number, address, department`` (columns its role lacks are NULL).
    """
    ids = wanted(batch, ["user_id"])
    roles = users.join(ids, "user_id", "left_semi").groupBy("user_id").agg(F.min("role").alias("role")) \
        .withColumn("known", F.lit(True))
    b = batch.join(roles, "user_id", "left")
    profiles = (students.select("user_id", F.lit(ROLE_STUDENT).alias("role"))
                .unionByName(teachers.select("user_id", F.lit(ROLE_TEACHER).alias("role")))
                .unionByName(management.select("user_id", F.lit(ROLE_MANAGEMENT).alias("role"))))
    # Profiles of the requested users only, keyed by (user, role).
    held = profiles.join(ids, "user_id", "left_semi").distinct().withColumn("has_profile", F.lit(True))
    b = b.join(held, ["user_id", "role"], "left")
    annotated = b.withColumn("reason", F.when(F.col("known").isNull(), F.lit(MSG_USER_NOT_FOUND))
                             .when(F.col("has_profile").isNull(),
                                   F.concat(F.coalesce(F.col("role"), F.lit("null")),
                                            F.lit(MSG_PROFILE_NOT_FOUND.replace("{role}", "")))))
    ok, rejects = split(annotated.drop("known"))
    fields = ["name", "email", "phone_number", "address", "department"]

    @once
    def patch() -> DataFrame:
        # One patch per (user, role); a user has one role, so each table takes the patches of its
        # own role.  Read by all three role tables and the updated rows, it is written once.
        return materialize(ok.groupBy("user_id", "role").agg(*[
            last_value(blank_to_null(f), present_str(f)).alias(f"u_{f}") for f in fields]), "patch")

    parts = {"students": (students, ROLE_STUDENT, ["name", "email", "phone_number", "address"]),
             "teachers": (teachers, ROLE_TEACHER, ["name", "email", "phone_number", "department"]),
             "management": (management, ROLE_MANAGEMENT, ["name", "email", "phone_number"])}

    def patched(tname: str) -> DataFrame:
        table, role, cols = parts[tname]
        p = patch().where(F.col("role") == F.lit(role))
        j = table.join(p.select("user_id", *[f"u_{c}" for c in cols]), "user_id", "left")
        sel = [F.when(F.col(f"u_{c}").isNotNull(), F.col(f"u_{c}.v")).otherwise(F.col(c)).alias(c)
               if c in cols else F.col(c) for c in table.columns]
        return conform(j.select(*sel), tname)

    def updated() -> DataFrame:
        profile = None
        for tname, (_, role, cols) in parts.items():
            null = F.lit(None).cast("string")
            rows = patched(tname).select("user_id", F.lit(role).alias("role"), "name", "email", "phone_number", *(
                F.col(c) if c in cols else null.alias(c) for c in ("address", "department")))
            profile = rows if profile is None else profile.unionByName(rows)
        return (profile.join(patch().select("user_id", "role"), ["user_id", "role"], "left_semi")
                .withColumnRenamed("user_id", "id"))

    return Deferred({**{n: (lambda n=n: patched(n)) for n in parts}, "updated": updated}), rejects


def delete_users(users: DataFrame, students: DataFrame, teachers: DataFrame, management: DataFrame, batch: DataFrame,
                 cascade: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """``batch(seq, user_id)``.  The first request for an existing user
    deletes it (later ones find it gone); its rows in the three role tables,
    and in further ``cascade`` tables keyed by ``user_id``, go with it.
    Returns ({users, students, teachers, management, <cascade tables>}, rejects).
    """
    # Every requested user that exists goes; which request wins matters for the rejects alone.
    doomed = existing_keys(users, batch, ["user_id"]).select("user_id")
    tables = {"users": users, "students": students, "teachers": teachers, "management": management, **(cascade or {})}
    return {name: table.join(doomed, "user_id", "left_anti") for name, table in tables.items()}, gone_before(batch, users, "user_id", MSG_USER_NOT_FOUND)

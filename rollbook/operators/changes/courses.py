"""Course change batches: create (C4), update (C5), delete with cascade."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import blank_to_null, present_num, present_str, ts_ntz
from rollbook.plans.batches import existing_keys, first_claim, flag_existing, gone_before, last_value, reason_of, split, wanted
from rollbook.plans.deferred import Deferred, once
from rollbook.plans.ids import current_max, number_rows, running_last, running_sum
from rollbook.plans.materialize import materialize
from rollbook.schema import (
    MSG_COURSE_CODE_EXISTS, MSG_COURSE_CODE_IN_USE, MSG_COURSE_FIELDS, MSG_COURSE_NOT_FOUND,
    MSG_NO_FIELDS, MSG_TEACHER_NOT_FOUND,
)
from rollbook.sources.io import conform


def create_courses(courses: DataFrame, teachers: DataFrame, batch: DataFrame
                   ) -> tuple[Deferred, DataFrame]:
    """C4: ``batch(seq, course_code, course_name, schedule, teacher_id)``.

    Checks in order: code and name given; the code is not taken (by the
    table, or by an earlier request of the batch that succeeds); a given
    (non-zero) teacher exists.  Returns ({courses, created}, rejects);
    created carries ``teacher_name`` and ``enrolled_students = 0``.
    """
    b0 = batch.withColumn("code", blank_to_null("course_code")) \
              .withColumn("tid", F.when(present_num("teacher_id"), F.col("teacher_id")))
    b = flag_existing(b0, courses, ["course_code"], ["code"], "code_taken", keys_from=b0)
    b = flag_existing(b, teachers, ["teacher_id"], ["tid"], "teacher_ok", keys_from=b0)
    missing = ~(present_str("course_code") & present_str("course_name"))
    taken = F.col("code_taken").isNotNull()
    bad_teacher = F.col("tid").isNotNull() & F.col("teacher_ok").isNull()
    b = first_claim(b, ["code"], ~missing & ~taken & ~bad_teacher)
    annotated = b.withColumn("reason", reason_of([
        (missing, MSG_COURSE_FIELDS),
        (taken | (F.col("seq") > F.col("first_seq")), MSG_COURSE_CODE_EXISTS),
        (bad_teacher, MSG_TEACHER_NOT_FOUND),
    ]))
    ok, rejects = split(annotated, pin=False)

    @once
    def new() -> DataFrame:
        base = current_max(courses, "course_id")
        return conform(number_rows(ok, ["seq"], "course_id", base).select(
            "course_id", "course_code", "course_name",
            blank_to_null("schedule").alias("schedule"),
            F.col("tid").alias("teacher_id"),
            F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at")), "courses")

    def created() -> DataFrame:
        return (new().join(teachers.select("teacher_id", F.col("name").alias("teacher_name")), "teacher_id", "left")
                .select(F.col("course_id").alias("id"), F.col("course_code").alias("code"),
                        F.col("course_name").alias("name"), "schedule", "teacher_id", "teacher_name",
                        F.lit(0).cast("long").alias("enrolled_students")))

    return Deferred({"courses": lambda: courses.unionByName(new()), "created": created}), rejects


def update_courses(courses: DataFrame, teachers: DataFrame, batch: DataFrame, as_of: dt.datetime,
                   target: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``batch(seq, course_id, fields map<string,string>)``.

    Keys ``name`` and ``code`` are set when non-empty; ``description`` and
    ``teacher_id`` are set whenever the key is present (a null value clears
    the column).  Checks, all against the table before the batch: the
    course exists; a new code is not used by another course (nor claimed
    first by an accepted request for another course in the batch); a given
    teacher exists; at least one field.  Accepted requests set
    ``updated_at``; per field the highest seq wins.  Returns (courses,
    updated, rejects); ``updated`` has ``id, name, code, description,
    teacher_id`` of each changed course.  ``target`` narrows the rows to return
    to a part of the courses that holds all requested ones.
    """
    b = materialize(_checked_updates(courses, teachers, batch), "checked")  # the claims and the join back read it
    # Holders of the requested codes only (semi join before the aggregate).
    holders = (courses.join(wanted(b, ["new_code"], ["course_code"]), "course_code", "left_semi")
               .groupBy(F.col("course_code").alias("new_code"))
               .agg(F.min("course_id").alias("holder_min"), F.max("course_id").alias("holder_max")))
    b = b.join(holders, "new_code", "left")
    in_use = F.col("new_code").isNotNull() & F.col("holder_min").isNotNull() & (
        (F.col("holder_min") != F.col("course_id")) | (F.col("holder_max") != F.col("course_id")))
    candidate = ~F.col("not_found") & ~in_use & ~F.col("bad_teacher") & ~F.col("nothing")
    # Among accepted claims of one new code, the first request's course keeps it.
    claims = (b.where(candidate & F.col("new_code").isNotNull())
               .groupBy("new_code").agg(F.min_by("course_id", "seq").alias("claim_course")))
    b = b.join(claims, "new_code", "left")
    lost_claim = F.col("claim_course").isNotNull() & (F.col("claim_course") != F.col("course_id"))
    return _apply_updates(courses if target is None else target, b, in_use | lost_claim, as_of)


def update_courses_in_order(courses: DataFrame, teachers: DataFrame, batch: DataFrame, as_of: dt.datetime
                            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C5 with each request checked against the state that the requests before
    it have left, as the application does one by one: a code that an earlier
    request has freed can be taken, one that it has taken cannot.  ``seq`` is
    unique; else as ``update_courses``.

    Only codes depend on earlier requests.  Which requests get their code is
    found in rounds: assuming those of the last round (first: all), every
    course's codes over time are known, hence the number of other holders of
    each requested code at each request.  A request depends on earlier ones
    alone, so a round settles at least one more request of every chain of
    dependent ones, and the rounds end when nothing changes: claims of one
    code by many courses take two or three, a chain of n courses that each take
    the code the one before has just freed up to n.  Both running values of a
    round are taken within range partitions and carried over their borders
    by one row a partition, so that a code or course of a third of all
    requests is not one task's.
    """
    b = materialize(_checked_updates(courses, teachers, batch), "checked")
    asks = b.where(F.col("new_code").isNotNull() & ~F.col("not_found")).select(
        "seq", "course_id", F.col("new_code").alias("code"), (~F.col("bad_teacher")).alias("can"))
    asks = materialize(asks, "code-requests")
    held = courses.select("course_id", F.col("course_code").alias("code")).where(F.col("code").isNotNull())
    of_courses = held.join(wanted(asks, ["course_id"]), "course_id", "left_semi")
    of_codes = held.join(wanted(asks, ["code"]), "code", "left_semi")
    start = materialize(of_courses.select("course_id", "code").unionByName(of_codes.select("course_id", "code")).distinct(), "codes-before")
    ok = asks.withColumn("ok", F.col("can"))
    while True:
        # The code that each asking course has just before its request.
        moves = (start.select("course_id", F.lit(None).cast("long").alias("seq"), "code", F.lit(True).alias("can"), F.lit(True).alias("ok"), F.col("code").alias("has"))
                 .unionByName(ok.select("course_id", "seq", "code", "can", "ok", F.when(F.col("ok"), F.col("code")).alias("has"))))
        asked = materialize(running_last(moves, "course_id", ["seq"], "has", "had").where(F.col("seq").isNotNull()).drop("has"), "codes-then")
        # How many courses hold the requested code then: +1 where one takes it, -1 where one leaves it.
        events = (start.select("code", F.lit(None).cast("long").alias("seq"), F.lit(1).alias("kind"), F.lit(1).alias("step"))
                  .unionByName(asked.where("ok").select("code", "seq", F.lit(1).alias("kind"), F.lit(1).alias("step")))
                  .unionByName(asked.where("ok AND had IS NOT NULL").select(F.col("had").alias("code"), "seq", F.lit(1).alias("kind"), F.lit(-1).alias("step")))
                  .unionByName(asked.select("code", "seq", F.lit(0).alias("kind"), F.lit(0).alias("step"))))
        holders = running_sum(events, "code", ["seq", "kind"], "step", "holders").where("kind = 0").select("code", "seq", "holders")
        others = F.col("holders") - F.when(F.col("had") == F.col("code"), 1).otherwise(0)
        now = materialize(asked.join(holders, ["code", "seq"]).select("course_id", "seq", "code", "can", F.col("ok").alias("was"), (others > 0).alias("in_use"),
                                                                      (F.col("can") & (others <= 0)).alias("ok")), "code-round")
        if now.where("ok <> was").isEmpty():
            break
        ok = now.select("course_id", "seq", "code", "can", "ok")
    b = b.join(now.select("seq", "in_use"), "seq", "left")
    return _apply_updates(courses, b, F.coalesce("in_use", F.lit(False)), as_of)


def _checked_updates(courses: DataFrame, teachers: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch of C5 with its fields as columns and the checks that do not
    depend on other requests: ``not_found``, ``bad_teacher``, ``nothing``."""
    fld = F.col("fields")
    name = blank_to_null(fld.getItem("name"))
    code = blank_to_null(fld.getItem("code"))
    has_desc = F.coalesce(F.map_contains_key(fld, F.lit("description")), F.lit(False))
    has_teacher = F.coalesce(F.map_contains_key(fld, F.lit("teacher_id")), F.lit(False))
    b0 = batch.select("seq", "course_id",
                     name.alias("new_name"), code.alias("new_code"),
                     has_desc.alias("has_desc"), has_teacher.alias("has_teacher"),
                     fld.getItem("description").alias("new_desc"),
                     fld.getItem("teacher_id").try_cast("long").alias("new_tid"),
                     (has_teacher & F.coalesce(fld.getItem("teacher_id").isNotNull(), F.lit(False))).alias("sets_teacher"))
    b = flag_existing(b0, courses, ["course_id"], flag="course_exists", keys_from=b0)
    b = flag_existing(b, teachers, ["teacher_id"], ["new_tid"], "teacher_ok", keys_from=b0)
    return b.select("seq", "course_id", "new_name", "new_code", "has_desc", "has_teacher", "new_desc", "new_tid",
                    F.col("course_exists").isNull().alias("not_found"),
                    (F.col("sets_teacher") & F.col("teacher_ok").isNull()).alias("bad_teacher"),
                    (~(F.col("new_name").isNotNull() | F.col("new_code").isNotNull() | F.col("has_desc") | F.col("has_teacher"))).alias("nothing"))


def _apply_updates(courses: DataFrame, b: DataFrame, in_use: Column, as_of: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(courses, updated, rejects) of checked updates."""
    annotated = b.withColumn("reason", reason_of([
        (F.col("not_found"), MSG_COURSE_NOT_FOUND),
        (in_use, MSG_COURSE_CODE_IN_USE),
        (F.col("bad_teacher"), MSG_TEACHER_NOT_FOUND),
        (F.col("nothing"), MSG_NO_FIELDS),
    ]))
    ok, rejects = split(annotated, pin=False)
    upd = ok.groupBy("course_id").agg(
        last_value(F.col("new_name"), F.col("new_name").isNotNull()).alias("u_name"),
        last_value(F.col("new_code"), F.col("new_code").isNotNull()).alias("u_code"),
        last_value(F.col("new_desc"), F.col("has_desc")).alias("u_desc"),
        last_value(F.col("new_tid"), F.col("has_teacher")).alias("u_tid"))
    c = courses.join(upd.withColumn("touched", F.lit(True)), "course_id", "left")

    def pick(u: str, old: str):
        return F.when(F.col(u).isNotNull(), F.col(f"{u}.v")).otherwise(F.col(old))

    out = c.select("course_id", pick("u_code", "course_code").alias("course_code"),
                   pick("u_name", "course_name").alias("course_name"), "schedule",
                   pick("u_tid", "teacher_id").alias("teacher_id"),
                   pick("u_desc", "description").alias("description"),
                   F.when(F.col("touched").isNotNull(), ts_ntz(as_of))
                    .otherwise(F.col("updated_at")).alias("updated_at"))
    new = conform(out, "courses")
    updated = (new.join(upd.select("course_id"), "course_id", "left_semi")
                  .select(F.col("course_id").alias("id"), F.col("course_name").alias("name"),
                          F.col("course_code").alias("code"), "description", "teacher_id"))
    return new, updated, rejects


def delete_courses(courses: DataFrame, attendance: DataFrame, grades: DataFrame,
                   assignments: DataFrame, enrollments: DataFrame, batch: DataFrame
                   ) -> tuple[dict[str, DataFrame], DataFrame]:
    """``batch(seq, course_id)``.  A course that exists is deleted by the
    first request for it (later ones find it gone), together with its
    attendance, the grades of its assignments, its assignments and its
    enrollments.  Returns ({table: new table}, rejects).
    """
    # Every requested course that exists goes; which request wins matters for the rejects alone.
    doomed = existing_keys(courses, batch, ["course_id"]).select("course_id")
    # Find the doomed assignments before the assignments are dropped.
    doomed_assignments = assignments.join(doomed, "course_id", "left_semi").select("assignment_id")
    out = {
        "attendance": attendance.join(doomed, "course_id", "left_anti"),
        "grades": grades.join(doomed_assignments, "assignment_id", "left_anti"),
        "assignments": assignments.join(doomed, "course_id", "left_anti"),
        "enrollments": enrollments.join(doomed, "course_id", "left_anti"),
        "courses": courses.join(doomed, "course_id", "left_anti"),
    }
    return out, gone_before(batch, courses, "course_id", MSG_COURSE_NOT_FOUND)

"""Plan checks: no Cartesian products or Python UDFs anywhere, no single-
partition exchange, filters and projections reach the Parquet scan."""

import pytest
from conftest import SF_SMALL

from rollbook import registry
from rollbook.plans.inspect import physical_plan, plan_flags

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_no_forbidden_operators(spark, name):
    flags = plan_flags(registry.queries()[name](spark, SF_SMALL))
    assert not flags & {"CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                        "ArrowEvalPython", "SinglePartition"}, flags


def test_filter_and_projection_pushed_to_scan(spark, tmp_path):
    from pyspark.sql import functions as F
    from rollbook.sources import load_driver, read_table, write_snapshot
    c = load_driver(spark, SF_SMALL)
    path = write_snapshot(c.courses, str(tmp_path / "courses"))
    df = read_table(spark, str(tmp_path), "courses").where(F.col("teacher_id") == 5).select("course_id")
    plan = physical_plan(df)
    assert "PushedFilters: [IsNotNull(teacher_id), EqualTo(teacher_id,5)]" in plan
    assert "ReadSchema: struct<course_id:bigint,teacher_id:bigint>" in plan
    assert path.endswith("courses")


def test_counts_aggregate_before_join(spark):
    from rollbook.sources import load_driver
    from rollbook.operators import learning
    c = load_driver(spark, SF_SMALL)
    plan = physical_plan(learning.course_catalog(c.courses, c.teachers, c.enrollments))
    # The partial aggregate sits below the join with courses (pre-aggregation).
    assert plan.count("HashAggregate") >= 2
    assert "SortAggregate" not in plan


def test_bucketed_snapshots_join_without_shuffle(spark, tmp_path):
    from rollbook.operators import learning
    from rollbook.sources import load_driver, write_bucketed
    c = load_driver(spark, SF_SMALL)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = write_bucketed(c.enrollments, "enrollments_by_student", ["student_id"], 8,
                           str(tmp_path / "enrollments"))
        s = write_bucketed(c.students, "students_by_student", ["student_id"], 8, str(tmp_path / "students"))
        roster = learning.course_roster(s, e, c.courses)
        plan = physical_plan(roster)
        joined = e.join(s, "student_id")
        assert "Exchange hashpartitioning(student_id" not in physical_plan(joined)
        assert roster.count() == learning.course_roster(c.students, c.enrollments, c.courses).count()
        assert "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS enrollments_by_student")
        spark.sql("DROP TABLE IF EXISTS students_by_student")


def test_selected_keys_reach_the_facts_before_the_counts(spark):
    """With a key filter a semi join stands below the partial aggregate."""
    from rollbook import registry as R
    for query in (R.q07_attendance_stats_one, R.q10_fee_stats_one, R.q11_teacher_course_load_one, R.q13_course_catalog_teacher):
        # In the tree, what stands below a node is printed after it.
        tree = query(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in tree[tree.index("partial_"):], query.__name__


def test_rejects_of_an_attendance_batch_read_no_record(spark):
    from rollbook import registry_changes as R
    rejects = R.CHANGES["c08_take_attendance_rejects"](spark, SF_SMALL)
    assert "lineitem" not in physical_plan(rejects)

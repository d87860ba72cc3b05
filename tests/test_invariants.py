"""Invariants of change batches on the driver's sf0.001 tables."""

import pytest
from conftest import SF_SMALL

from rollbook import registry_changes as R
from rollbook.sources import load_driver


@pytest.mark.parametrize("runner,batch", [
    (R._c01, R.batch_create_users), (R._c02, R.batch_update_users), (R._c03, R.batch_delete_users),
    (R._c05, R.batch_update_courses), (R._c06, R.batch_delete_courses), (R._c10, R.batch_post_notices),
    (R._c11, R.batch_pay_fees)])
def test_rejects_are_a_subset_with_one_reason_each(spark, runner, batch):
    out = runner(spark, SF_SMALL)
    rejects = out[-1]
    b = batch(spark, SF_SMALL)
    assert rejects.select("seq").distinct().count() == rejects.count()
    assert rejects.join(b, "seq", "left_anti").count() == 0
    assert rejects.where("reason IS NULL").count() == 0


def test_updates_keep_ids_and_row_counts(spark):
    c = load_driver(spark, SF_SMALL)
    new, _, _ = R._c05(spark, SF_SMALL)
    assert new.count() == c.courses.count()
    assert new.select("course_id").subtract(c.courses.select("course_id")).count() == 0
    grades, _ = R._c07(spark, SF_SMALL)
    assert grades.count() == c.grades.count()


def test_deleted_course_leaves_catalog(spark):
    from rollbook.operators import learning
    c = load_driver(spark, SF_SMALL)
    out, rejects = R._c06(spark, SF_SMALL)
    cat = learning.course_catalog(out["courses"], c.teachers, out["enrollments"])
    promo = c.courses.where("schedule = 'PROMO'").select("course_id")
    assert cat.join(promo.withColumnRenamed("course_id", "id"), "id").count() == 0
    assert cat.count() == c.courses.count() - promo.count()


def test_inserted_ids_continue_after_max(spark):
    c = load_driver(spark, SF_SMALL)
    base = c.notices.agg({"notice_id": "max"}).first()[0]
    out, rejects = R._c10(spark, SF_SMALL)
    added = out["notices"].where(f"notice_id > {base}")
    n = added.count()
    assert n + rejects.count() == R.batch_post_notices(spark, SF_SMALL).count()
    assert added.agg({"notice_id": "max"}).first()[0] == base + n

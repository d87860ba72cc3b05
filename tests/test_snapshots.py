"""Stored snapshots: what a batch reads and writes, versions, failures."""

import datetime as dt

import pytest
from conftest import SF_SMALL, as_dicts, frame, table
from pyspark.sql import functions as F

from rollbook.operators import changes
from rollbook.sources import create_snapshot, load_driver, open_snapshot
from rollbook.sources.snapshots import part_of

AS_OF = dt.datetime(2025, 1, 15, 9, 30)


def fees(spark, n=40):
    return table(spark, "fees", [dict(fee_id=i, student_id=i % 7, amount=10.0 * i, payment_status="unpaid" if i % 2 else None) for i in range(n)])


def files(df):
    return {f.split("/data/")[1] for f in df.inputFiles()}


def parts_in(df):
    return {int(f.split("part=")[1].split("/")[0]) for f in files(df)}


def test_a_hundredth_of_the_grades_costs_a_hundredth(spark, tmp_path):
    c = load_driver(spark, SF_SMALL).pinned("grades")
    old = create_snapshot(c.grades, str(tmp_path / "grades"), "grades", "grade_id", 200)
    owners = (c.grades.join(c.assignments.select("assignment_id", "course_id"), "assignment_id")
              .join(c.courses.select("course_id", "teacher_id"), "course_id").join(c.teachers.select("teacher_id", F.col("user_id").alias("teacher_user_id")), "teacher_id"))
    asked = owners.orderBy(F.xxhash64("grade_id")).limit(2).select("grade_id", "teacher_user_id").collect()
    batch = frame(spark, "seq long, teacher_user_id long, grade_id string, grade string, feedback string",
                  [(i, r["teacher_user_id"], r["grade_id"], "A+", None) for i, r in enumerate(asked)] + [(9, 1, asked[0]["grade_id"], "F", ""), (10, asked[0]["teacher_user_id"], "none", "F", "")])
    new, rejects = changes.stored_update_grades(old, c.teachers, c.assignments, c.courses, batch, AS_OF)
    touched = old.parts_of(batch)
    assert len(touched) <= 3 and {p for p in old.held if old.held[p] != new.held[p]} <= set(touched)
    # Read: the touched partitions alone.  Written: their new files; all other files are the old ones.
    assert parts_in(old.read(touched)) == set(touched)
    before, after = files(old.read()), files(new.read())
    assert len(after - before) <= 3 and len(before - after) <= 3 and len(before & after) >= 190
    plain, plain_rejects = changes.update_grades(c.grades, c.teachers, c.assignments, c.courses, batch, AS_OF)
    assert sorted(map(str, new.read().collect())) == sorted(map(str, plain.collect()))
    assert as_dicts(rejects) == as_dicts(plain_rejects) and rejects.count() == 2


def test_scan_of_touched_partitions_in_the_plan(spark, tmp_path):
    """The scan metrics of a run: files read by the checks and the new rows."""
    old = create_snapshot(fees(spark, 2000), str(tmp_path / "fees"), "fees", "fee_id", 100)
    part = old.read(old.parts_of(frame(spark, "fee_id long", [(5,)])))
    run = part.groupBy("payment_status").count()
    run.collect()

    def scans(node):
        out = [node] if "Scan parquet" in node.nodeName() else []
        plan = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        kids = [plan] if plan is not None else [node.children().apply(i) for i in range(node.children().size())]
        return out + [s for k in kids for s in scans(k)]

    found = scans(run._jdf.queryExecution().executedPlan())
    assert sum(s.metrics().apply("numFiles").value() for s in found) == 1
    assert sum(s.metrics().apply("numOutputRows").value() for s in found) < 60


def test_versions_can_be_read_again(spark, tmp_path):
    path = str(tmp_path / "fees")
    one = create_snapshot(fees(spark), path, "fees", "fee_id", 5)
    students = table(spark, "students", [dict(student_id=i, user_id=100 + i) for i in range(7)])
    batch = frame(spark, "seq long, user_id long, fee_id long", [(1, 101, 1), (2, 101, 1), (3, 100, 3), (4, 55, 3), (5, 100, None)])
    two, rejects = changes.stored_pay_fees(one, students, batch, AS_OF.date())
    assert two.version == 2 and as_dicts(rejects, "seq") == [
        {"seq": 2, "reason": "Fee is already paid"}, {"seq": 3, "reason": "Fee not found or does not belong to this student"},
        {"seq": 4, "reason": "Student not found"}, {"seq": 5, "reason": "Fee not found or does not belong to this student"}] or rejects.count() == 4
    for got in (open_snapshot(spark, path), open_snapshot(spark, path, 2)):
        assert got.held == two.held and got.read().where("payment_status = 'paid'").count() == 1
    assert as_dicts(open_snapshot(spark, path, 1).read(), "fee_id") == as_dicts(fees(spark), "fee_id")


def test_of_two_writers_the_later_gets_an_error(spark, tmp_path):
    path = str(tmp_path / "fees")
    one = create_snapshot(fees(spark), path, "fees", "fee_id", 5)
    part = next(iter(one.held))
    one.rewrite([part], one.read([part]).where("fee_id > 5"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        one.rewrite([part], one.read([part]))
    assert open_snapshot(spark, path).version == 2


def test_a_failed_rewrite_leaves_the_version(spark, tmp_path):
    path = str(tmp_path / "fees")
    one = create_snapshot(fees(spark), path, "fees", "fee_id", 5)
    part = next(iter(one.held))
    with pytest.raises(Exception, match="stop"):
        one.rewrite([part], one.read([part]).withColumn("amount", F.when(F.col("amount") >= 0, F.raise_error(F.lit("stop")).cast("double"))))
    assert open_snapshot(spark, path).held == one.held
    with pytest.raises(ValueError, match="not rewritten"):
        one.rewrite([part], one.read())
    assert as_dicts(open_snapshot(spark, path).read(), "fee_id") == as_dicts(fees(spark), "fee_id")


def test_emptied_partitions_appended_rows_and_compaction(spark, tmp_path):
    path = str(tmp_path / "fees")
    s = create_snapshot(fees(spark), path, "fees", "fee_id", 4)
    part = next(iter(s.held))
    s = s.rewrite([part], s.read([part]).limit(0))
    assert part not in s.held and s.read().where(part_of("fee_id", 4) == part).count() == 0
    left = s.read().count()
    assert s.rewrite([], s.read()) is s
    for i in range(3):
        s = s.append(table(spark, "fees", [dict(fee_id=1000 + i), dict(fee_id=2000 + i), dict(fee_id=None)]))
    assert s.read().count() == left + 9
    small = s.compact(2)
    assert max(map(len, small.held.values())) <= 2 < max(map(len, s.held.values()))
    assert sorted(map(str, small.read().collect())) == sorted(map(str, s.read().collect()))
    assert s.append(s.read().limit(0)) is s


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "fees")
    create_snapshot(fees(spark, 0), path, "fees", "fee_id", 4)
    got = open_snapshot(spark, path)
    assert got.read().count() == 0 and got.parts_of(frame(spark, "fee_id long", [(1,)])) == []
    assert got.append(fees(spark, 3)).read().count() == 3


def test_deletion_rewrites_only_partitions_with_doomed_rows(spark, tmp_path):
    rows = {"courses": [dict(course_id=i, course_code=f"C{i}") for i in range(50)],
            "attendance": [dict(attendance_id=i, course_id=i % 50, student_id=1) for i in range(300)],
            "assignments": [dict(assignment_id=i, course_id=i % 50) for i in range(100)],
            "grades": [dict(grade_id=str(i), assignment_id=i % 100, student_id=2) for i in range(400)],
            "enrollments": [dict(student_id=i, course_id=i % 50) for i in range(200)]}
    keys = {"courses": "course_id", "attendance": "attendance_id", "assignments": "course_id", "grades": "assignment_id", "enrollments": "course_id"}
    stored = {n: create_snapshot(table(spark, n, r), str(tmp_path / n), n, keys[n], 20) for n, r in rows.items()}
    batch = frame(spark, "seq long, course_id long", [(1, 7), (2, 7), (3, 999), (None, 8), (4, None)])
    new, rejects = changes.stored_delete_courses(stored, batch)
    plain, plain_rejects = changes.delete_courses(*(table(spark, n, rows[n]) for n in ("courses", "attendance", "grades", "assignments", "enrollments")), batch)
    for n in rows:
        assert as_dicts(new[n].read()) == as_dicts(plain[n]), n
    assert as_dicts(rejects) == as_dicts(plain_rejects)
    assert sorted(r["seq"] for r in as_dicts(rejects)) == [2, 3, 4]
    for n in ("courses", "enrollments", "assignments"):
        assert len(files(new[n].read()) - files(stored[n].read())) <= 2, n
    assert len(files(new["grades"].read()) - files(stored["grades"].read())) <= 4


def test_new_rows_continue_the_ids(spark, tmp_path):
    old = table(spark, "notices", [dict(notice_id=i, title="t", content="c") for i in (3, 41)])
    kept = create_snapshot(old, str(tmp_path / "notices"), "notices", "notice_id", 4)
    batch = frame(spark, "seq long, user_id long, title string, content string", [(2, 1, "b", "y"), (1, 1, "a", "x"), (3, 1, "", "z")])
    new, rejects = changes.stored_post_notices(kept, batch, AS_OF)
    assert {(r["notice_id"], r["title"]) for r in as_dicts(new.read())} == {(3, "t"), (41, "t"), (42, "a"), (43, "b")}
    assert [r["seq"] for r in as_dicts(rejects)] == [3]
    assert files(kept.read()) < files(new.read())


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if f.endswith(".data") and "/shuffle_" in f}


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    """Tables that are read from their files from then on keep no copy of their rows in shuffle files."""
    from rollbook.plans.materialize import materialize
    rows, asked = fees(spark, 2000), frame(spark, "fee_id long", [(i,) for i in range(0, 2000, 3)])
    before = shuffle_files(spark)
    written = materialize(rows.repartition(4, "student_id"), "t")
    old = create_snapshot(rows, str(tmp_path / "fees"), "fees", "fee_id", 16)
    new = old.rewrite(range(16), old.read().join(asked.hint("merge"), "fee_id", "left_anti"))
    assert not shuffle_files(spark) - before
    assert written.count() == old.read().count() == 2000 and new.read().count() == 2000 - 667


def test_large_partitions_are_rewritten_in_groups(spark, tmp_path, monkeypatch):
    """The same grades, rejects and files a partition as by one write; partitions without requests are carried over."""
    from rollbook.sources import snapshots
    c = load_driver(spark, SF_SMALL).pinned("grades")
    old = create_snapshot(c.grades, str(tmp_path / "grades"), "grades", "grade_id", 16)
    from rollbook.registry_changes import batch_update_grades
    batch = batch_update_grades(c, spark, SF_SMALL).where(part_of("grade_id", 16) < 13)
    batch = batch.unionByName(frame(spark, "seq string, teacher_user_id long, grade_id string, grade string, feedback string", [("x", 6, None, "A", None), ("y", 6, "none", "", "F")]))
    plain, plain_rejects = changes.update_grades(c.grades, c.teachers, c.assignments, c.courses, batch, AS_OF)
    monkeypatch.setattr(snapshots, "GROUP_BYTES", 1)
    monkeypatch.setattr(snapshots, "GROUPS", 4)
    assert sorted(len(g) for g in old.groups(range(13))) == [3, 3, 3, 4] and old.groups([]) == [[]]
    new, rejects = changes.stored_update_grades(old, c.teachers, c.assignments, c.courses, batch, AS_OF)
    assert sorted(map(str, new.read().collect())) == sorted(map(str, plain.collect()))
    assert as_dicts(rejects) == as_dicts(plain_rejects) and rejects.count() > 2
    assert new.version == old.version + 1 and {w for p in range(13) for w in new.held[p]}.isdisjoint(w for x in old.held.values() for w in x)
    assert len({w for p in range(13) for w in new.held[p]}) == 4 and all(new.held[p] == old.held[p] for p in range(13, 16))

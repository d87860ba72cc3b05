"""The trigram table against the plain search; running counts against new counts."""

import datetime as dt
import random

import pytest
from conftest import as_dicts, frame, table

from rollbook.operators import billing, changes, declared, directory, learning, running, search
from rollbook.operators.keys import only_keys
from rollbook.sources import create_snapshot

AS_OF = dt.datetime(2025, 1, 15, 9, 30)


@pytest.fixture(scope="module")
def people(spark):
    r = random.Random(5)
    words = ["Ada", "ADAMS", "Łukasz", "k_t", "50%", "a\\b", "Kelvin K", "İnci", "mary-ann", "", None, "aa", "aaaa"]

    def some():
        w = [r.choice(words) for _ in range(2)]
        return None if None in w and r.random() < 0.7 else " ".join(x or "" for x in w)

    users = table(spark, "users", [dict(user_id=i, domain_id=some() if i % 3 else f"stu_{i}", role=r.choice(["student", "teacher", "management", None])) for i in range(90)])
    tables = [table(spark, n, [dict(user_id=u, name=some(), email=some()) for u in r.sample(range(95), 50)]) for n in ("students", "teachers", "management")]
    return users, *tables


TERMS = ["ada", "ADAM", "dam", "k_t", "_da", "%", "", "a%m", "ary-", "mary%ann", "50%", "a\\b", "aaa", "aaaa", "łuk", "UKASZ", "kelvin k", "inci", "nci", "stu_1", "zzz", "ada ada", "Kelvin", "x" * 100]


def test_index_finds_what_the_scan_finds(spark, people, tmp_path):
    postings = search.write_postings(search.directory_values(*people), str(tmp_path / "p"))
    for term in TERMS:
        plain, indexed = (as_dicts(directory.user_directory(*people, search=term, postings=p)) for p in (None, postings))
        assert plain == indexed, term
        ids = search.candidates(postings, term)
        assert (ids is None) == (not search.literal_grams(term))
        if ids is not None:
            assert {r["id"] for r in plain} <= {r["id"] for r in as_dicts(ids)}, term


@pytest.mark.parametrize("listed", [1000, 2])
def test_candidates_reach_the_scan(spark, people, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(search, "LISTED", listed)
    users = people[0]
    users.write.parquet(str(tmp_path / "users"))
    stored = spark.read.parquet(str(tmp_path / "users"))
    postings = search.write_postings(search.directory_values(*people), str(tmp_path / "p"))
    got = directory.user_directory(stored, *people[1:], role="student", search="dam", postings=postings)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("In(user_id" in plan) == (listed == 1000)
    assert as_dicts(got) == as_dicts(directory.user_directory(*people, role="student", search="dam"))


def test_long_terms_and_many_grams(spark, tmp_path):
    text = "".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) for i in range(200))
    courses = table(spark, "courses", [dict(course_id=1, course_name=text), dict(course_id=2, course_name=text[:150]), dict(course_id=3, course_name=None), dict(course_id=4, course_code=text[10:])])
    postings = search.write_postings(search.course_values(courses), str(tmp_path / "p"))
    for term in (text, text[20:190], text[5:100] + "%" + text[120:130]):
        found = [as_dicts(learning.course_catalog(courses, table(spark, "teachers", []), table(spark, "enrollments", []), search=term, postings=p)) for p in (None, postings)]
        assert found[0] == found[1] and found[0]


def test_postings_of_odd_values(spark):
    rows = search.postings_of(frame(spark, "id long, field string, value string", [(1, "a", "aAaa"), (2, "a", "ab"), (3, "a", None), (None, "a", "abc"), (4, "b", "")])).collect()
    assert [tuple(r) for r in rows] == [("aaa", "a", 1)]


def test_running_counts_after_a_chain_of_batches(spark, tmp_path):
    r = random.Random(11)
    students = table(spark, "students", [dict(student_id=i, user_id=100 + i) for i in range(12)])
    teachers = table(spark, "teachers", [dict(teacher_id=1, user_id=901, name="T")])
    rows = {"courses": [dict(course_id=i, course_code=f"C{i}", teacher_id=1) for i in range(8)],
            "enrollments": [dict(student_id=r.choice([None, *range(12)]), course_id=r.choice([None, 99, *range(8)]), enrollment_status="active") for _ in range(60)],
            "attendance": [dict(attendance_id=i, student_id=r.choice([None, *range(14)]), course_id=r.choice([99, *range(8)]), status=r.choice(["present", "absent", "excused", "late", None])) for i in range(80)],
            "assignments": [dict(assignment_id=i, course_id=i % 9) for i in range(20)],
            "grades": [dict(grade_id=str(i), assignment_id=i % 20, student_id=1) for i in range(30)],
            "fees": [dict(fee_id=i, student_id=r.choice([None, *range(12)]), amount=r.choice([None, 0.1, 0.2, 99.99, -5.0]), payment_status=r.choice(["paid", "pending", "unpaid", None, "late"])) for i in range(50)]}
    keys = {"courses": "course_id", "enrollments": "course_id", "attendance": "attendance_id", "assignments": "course_id", "grades": "grade_id", "fees": "fee_id"}
    now = {n: create_snapshot(table(spark, n, x), str(tmp_path / n), n, keys[n], 6) for n, x in rows.items()}

    def known(rows, _):
        return only_keys(rows, now["courses"].read(), "course_id")

    sums = {"enrollments": running.ENROLLED.of(now["enrollments"].read()), "attendance": running.CLASSES.of(known(now["attendance"].read(), None)), "fees": running.FEES.of(now["fees"].read())}

    def check():
        # Written after each batch, as a caller would.
        for n in sums:
            sums[n] = spark.createDataFrame(sums[n].collect(), sums[n].schema)
        c, e, a, f = (now[n].read() for n in ("courses", "enrollments", "attendance", "fees"))
        assert as_dicts(learning.course_catalog(c, teachers, None, counts=sums["enrollments"])) == as_dicts(learning.course_catalog(c, teachers, e))
        assert as_dicts(learning.teacher_course_load(teachers, c, None, counts=sums["enrollments"])) == as_dicts(learning.teacher_course_load(teachers, c, e))
        assert as_dicts(learning.attendance_stats(students, None, None, counts=sums["attendance"])) == as_dicts(learning.attendance_stats(students, a, c))
        assert as_dicts(billing.fee_stats(students, None, counts=sums["fees"])) == as_dicts(billing.fee_stats(students, f))
        assert as_dicts(sums["enrollments"].drop("n_rows")) == as_dicts(learning.enrollment_counts(e))

    check()
    old = now["enrollments"]
    now["enrollments"], _ = declared.stored_enroll(old, students, now["courses"].read(), frame(spark, "seq long, user_id long, course_id long", [(i, 100 + r.randrange(13), r.randrange(9)) for i in range(40)]), AS_OF)
    added, gone = now["enrollments"].difference(old)
    assert gone.count() == 0 and 0 < added.count() < 40
    sums["enrollments"] = running.ENROLLED.after(sums["enrollments"], old, now["enrollments"])
    check()
    old = now["attendance"]
    requests = frame(spark, "seq long, teacher_user_id long, course_id long, records_given boolean", [(1, 901, 2, True), (2, 901, 77, True), (3, 1, 2, True), (4, 901, 3, False)])
    records = frame(spark, "seq long, record_pos int, student_id long, status string", [(s, i, i, "present") for s in (1, 2, 3) for i in range(13)])
    now["attendance"], _ = changes.stored_take_attendance(old, teachers, now["courses"].read(), requests, records, AS_OF)
    sums["attendance"] = running.CLASSES.after(sums["attendance"], old, now["attendance"], known)
    check()
    old = dict(now)
    done, _ = changes.stored_delete_courses({n: now[n] for n in ("courses", "attendance", "grades", "assignments", "enrollments")}, frame(spark, "seq long, course_id long", [(1, 2), (2, 5), (3, 5), (4, 1000)]))
    # Rows that go counted with the courses of their version.
    before = lambda rows, version: only_keys(rows, (done if version is done["attendance"] else old)["courses"].read(), "course_id")
    sums["attendance"] = running.CLASSES.after(sums["attendance"], old["attendance"], done["attendance"], before)
    sums["enrollments"] = running.ENROLLED.after(sums["enrollments"], old["enrollments"], done["enrollments"])
    now.update(done)
    check()
    old = now["fees"]
    now["fees"], rejects = changes.stored_pay_fees(old, students, frame(spark, "seq long, user_id long, fee_id long", [(i, 100 + x["student_id"], x["fee_id"]) for i, x in enumerate(rows["fees"][:25]) if x["student_id"] is not None]), AS_OF.date())
    assert rejects.count() < 25 and now["fees"].difference(old)[0].count() <= 50
    sums["fees"] = running.FEES.after(sums["fees"], old, now["fees"])
    check()

"""Requests that are not as they should be: JSON lines, sequence numbers; number texts; deletions without scratch tables."""

import datetime as dt
import decimal
import random

import pytest
from conftest import SF_SMALL, as_dicts, frame, table
from pyspark.sql import types as T

from rollbook.functions import number_text, one_decimal
from rollbook.operators import changes, declared, learning
from rollbook.plans import materialize
from rollbook.sources import read_requests

SHAPE = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("due", T.DateType()), T.StructField("marks", T.DecimalType(18, 0)), T.StructField("ok", T.BooleanType()),
    T.StructField("title", T.StringType()),
    T.StructField("records", T.ArrayType(T.StructType([T.StructField("student_id", T.LongType()), T.StructField("status", T.StringType())]))),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
GOOD = [
    ('{"seq": 1, "title": "x"}', dict(seq=1, title="x")),
    ('{"seq": "12", "title": 5, "marks": "7"}', dict(seq=12, title="5", marks=decimal.Decimal(7))),
    ('{"seq": 3.0, "due": "2025-01-02", "ok": true}', dict(seq=3, due=dt.date(2025, 1, 2), ok=True)),
    ('  {"seq": 4, "title": null, "records": null, "fields": null, "unknown": [1]}  ', dict(seq=4)),
    ('{"seq": 5, "records": [{"student_id": 1, "status": "present"}, {"student_id": 2}]}', dict(seq=5, records=[dict(student_id=1, status="present"), dict(student_id=2, status=None)])),
    ('{"seq": 6, "records": []}', dict(seq=6, records=[])),
    ('{"seq": 7, "fields": {"name": null, "code": "c", "teacher_id": 9}}', dict(seq=7, fields={"name": None, "code": "c", "teacher_id": "9"})),
    ("{}", {}),
]
BAD = [
    ("{oops", "Request body is not JSON"), ("", "Request body is not JSON"), ('{"seq": 1} trailing', "Request body is not JSON"), ('{"seq": 1}, {"seq": 2}', "Request body is not JSON"),
    ('{"seq": 1}} {"seq": 2}', "Request body is not JSON"), ('{"seq": 1}]', "Request body is not JSON"),
    ('[{"seq": 1}]', "Request body must be an object"), ('"seq"', "Request body must be an object"), ("17", "Request body must be an object"), ("null", "Request body must be an object"),
    ('{"seq": "abc", "title": "x"}', "Wrong type: seq"), ('{"seq": 1.5}', "Wrong type: seq"), ('{"seq": 99999999999999999999999}', "Wrong type: seq"),
    ('{"seq": true, "ok": "yes"}', "Wrong type: seq, ok"), ('{"seq": 1, "due": "soon"}', "Wrong type: due"), ('{"title": {"a": 1}}', "Wrong type: title"),
    ('{"title": ["a"]}', "Wrong type: title"), ('{"records": {"student_id": 1}}', "Wrong type: records"), ('{"records": "all"}', "Wrong type: records"),
    ('{"records": [{"student_id": "x"}]}', "Wrong type: records"), ('{"fields": ["name"]}', "Wrong type: fields"), ('{"fields": 3, "records": 4}', "Wrong type: records, fields"),
]


def test_every_line_is_a_request_or_a_reject(spark, tmp_path):
    lines = [x for x, _ in GOOD + BAD]
    random.Random(1).shuffle(lines)
    for i in range(3):
        (tmp_path / f"part-{i}.json").write_text("\n".join(lines[i::3]) + "\n")
    requests, rejects = read_requests(spark, str(tmp_path), SHAPE, "fields")
    assert requests.schema.simpleString() == SHAPE.simpleString()
    assert requests.count() + rejects.count() == len(lines)
    want = [{f.name: row.get(f.name) for f in SHAPE.fields} for _, row in GOOD]
    assert as_dicts(requests) == sorted(want, key=lambda r: str(sorted(r.items())))
    assert sorted((r["line"], r["reason"]) for r in as_dicts(rejects)) == sorted(BAD)
    assert all(r["file"].endswith(".json") for r in as_dicts(rejects))


def test_no_lines(spark, tmp_path):
    (tmp_path / "none.json").write_text("")
    requests, rejects = read_requests(spark, str(tmp_path), T.StructType([T.StructField("seq", T.LongType())]))
    assert requests.count() == rejects.count() == 0


@pytest.mark.parametrize("seqs", [[1, None, 1], [None, None, None], [3, 2, 1], [5, 5, 5]])
def test_each_notice_is_posted_once(spark, seqs):
    batch = frame(spark, "seq long, user_id long, title string, content string",
                  [(s, i, f"t{i}", "c") for i, s in enumerate(seqs)] + [(s, 9, None, "c") for s in seqs]).repartition(3)
    old = table(spark, "notices", [dict(notice_id=10, title="old", content="c")])
    new, rejects = changes.post_notices(old, batch, dt.datetime(2025, 1, 1))
    rows = as_dicts(new["notices"])
    assert sorted(r["notice_id"] for r in rows) == [10, 11, 12, 13] and {r["title"] for r in rows} == {"old", "t0", "t1", "t2"}
    ids = {r["title"]: r["notice_id"] for r in rows}
    order = sorted(range(3), key=lambda i: (seqs[i] is not None, seqs[i] or 0, ids[f"t{i}"]))
    assert [ids[f"t{i}"] for i in order] == [11, 12, 13]
    assert new["created"].count() + rejects.count() == batch.count()


TEXTS = {0.0: "0", -0.0: "0", 1.0: "1", 50.0: "50", 1e-5: "0.00001", 0.05: "0.05", 123.456: "123.456", 1e-6: "0.000001", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 1e20: "100000000000000000000",
         1e21: "1e+21", 1.5e21: "1.5e+21", 123456789.0: "123456789", 0.1 + 0.2: "0.30000000000000004", 12345678.9: "12345678.9", -2.5: "-2.5", 7.000000000000001e-06: "0.000007000000000000001",
         float("inf"): "Infinity", float("-inf"): "-Infinity", 1.7976931348623157e308: "1.7976931348623157e+308", 1e7: "10000000", 0.001: "0.001", 9.99e-4: "0.000999"}


def test_number_texts(spark):
    got = frame(spark, "x double", [(x,) for x in TEXTS] + [(None,), (float("nan"),)]).select(number_text("x").alias("t")).collect()
    assert [r.t for r in got] == [*TEXTS.values(), None, "NaN"]


def test_one_decimal_by_the_exact_value(spark):
    r = random.Random(3)
    xs = [a / b * 100 for b in range(1, 90) for a in range(b + 1)] + [k / 20 for k in range(2001)] + [0.35, 12.25, 0.05, 99.95] + [r.random() * 100 for _ in range(1000)]
    got = frame(spark, "x double", [(x,) for x in xs]).select(one_decimal("x").alias("t")).collect()
    exact = [str(decimal.Decimal(x).quantize(decimal.Decimal("0.1"), rounding=decimal.ROUND_HALF_UP)) for x in xs]
    assert [g.t for g in got] == exact


def test_display_of_numbers(spark):
    courses = frame(spark, "student_id long, id long, name string, code string, status string, progress double",
                    [(1, i, "n", "c", "s", p) for i, p in enumerate((0.0, 1.0, 50.0, 1e-5, None, float("nan"), 33.3))])
    assert [r.progress_text for r in learning.display_rows(courses, "courses").orderBy("id").collect()] == ["0%", "1", "50", "0.00001", "0%", "0%", "33.3"]
    stats = learning.attendance_stats(table(spark, "students", [dict(student_id=1, user_id=1), dict(student_id=2, user_id=2)]),
                                      table(spark, "attendance", [dict(attendance_id=i, student_id=2, course_id=1, status=s) for i, s in enumerate(["present", "absent", "absent"])]),
                                      table(spark, "courses", [dict(course_id=1)]))
    assert [tuple(r) for r in learning.display_rows(stats, "stats").orderBy("student_id").collect()] == [(1, "0.0%", "0.0%", "0"), (2, "33.3%", "66.7%", "3")]


def test_deletions_and_rejects_write_no_scratch_table(spark):
    from rollbook import registry_changes as R
    for name in ("c06_delete_courses_grades", "c06_delete_courses_rejects", "c03_delete_users"):
        before = len(materialize._WRITTEN)
        R.CHANGES[name](spark, SF_SMALL).count()
        # What the registry itself writes to derive its tables is not the operator's.
        assert not [p for p in materialize._WRITTEN[before:] if "/claims-" in p or "/checked-" in p], name
    before = len(materialize._WRITTEN)
    R.CHANGES["c02_update_users_rejects"](spark, SF_SMALL).count()
    assert not [p for p in materialize._WRITTEN[before:] if "/patch-" in p]


def brute_available(students, courses, enrollments):
    taken = set(enrollments)
    return sorted((s, c) for s in set(students) if s is not None for c in courses if (s, c) not in taken)


@pytest.mark.parametrize("n, block", [(0, 32_768), (1, 32_768), (8, 32_768), (77, 32_768), (33_000, 32_768)])
def test_available_courses_of_a_set(spark, n, block):
    r = random.Random(n)
    courses = r.sample(range(10, 10 + 3 * n), n)
    enrolled = [(s, c) for s in (1, 2, 3) for c in courses if r.random() < s / 3 or n > 1000] + [(1, -5), (2, None), (None, 3)]
    if n > 1000:
        enrolled = [e for e in enrolled if r.random() < 0.999]
    asked = [1, 2, 2, 3, 4, None] if n < 1000 else [1, 2]
    got = declared.available_courses_of(frame(spark, "student_id long", [(s,) for s in asked]),
                                        table(spark, "courses", [dict(course_id=c, course_code=f"C{c}", course_name="n") for c in courses]),
                                        table(spark, "enrollments", [dict(student_id=s, course_id=c) for s, c in enrolled + enrolled[:5]])).collect()
    assert sorted((x.student_id, x.id) for x in got) == brute_available(asked, courses, enrolled)
    assert all(x.code == f"C{x.id}" for x in got)


def shuffled_rows(df):
    """Rows that each exchange of an executed plan has written."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_available_courses_shuffle_no_pairs(spark):
    """What is dealt out grows with students and courses, not with their pairs."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = declared.available_courses_of(spark.range(100).toDF("student_id"),
                                            table(spark, "courses", [dict(course_id=c, course_code=f"C{c}", course_name="n") for c in range(400)]),
                                            table(spark, "enrollments", [dict(student_id=s, course_id=s) for s in range(100)]))
        assert len(got.collect()) == 100 * 399
        written = shuffled_rows(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert written and max(written) < 4 * (100 + 400)


def test_available_courses_are_written_small(spark, tmp_path):
    """The answer has students x courses rows; as they come, files take less than two bytes for each."""
    n = 20_000
    courses = spark.range(n).selectExpr("id * 7 as course_id", "concat('C', id * 7) as course_code", "concat('name ', hash(id)) as course_name", "cast(null as bigint) as teacher_id",
                                        "cast(null as string) as schedule", "cast(null as string) as description", "cast(null as timestamp_ntz) as updated_at")
    enrolled = table(spark, "enrollments", [dict(student_id=s, course_id=7 * c) for s in range(60) for c in range(s, n, 997)])
    got = declared.available_courses_of(spark.range(60).toDF("student_id"), courses, enrolled)
    got.write.parquet(str(tmp_path / "answer"))
    assert spark.read.parquet(str(tmp_path / "answer")).count() == 60 * n - enrolled.count()
    assert sum(f.stat().st_size for f in (tmp_path / "answer").glob("*.parquet")) < 60 * n * 2


def test_grade_requests_come_from_one_join(spark):
    from rollbook.plans.inspect import physical_plan
    from rollbook.registry_changes import batch_update_grades
    from rollbook.sources.campus import load_driver
    assert "Union" not in physical_plan(batch_update_grades(load_driver(spark, SF_SMALL), spark, SF_SMALL))


@pytest.mark.parametrize("few, many", [(10 ** 6, 10 ** 7), (0, 10 ** 7), (0, 0)])
def test_grade_access_however_many_ask(spark, monkeypatch, few, many):
    from rollbook.operators import access
    for name, n in (("FILTER_FROM", few), ("FILTER_TO", many)):
        monkeypatch.setattr(access, name, n, raising=False)
    requests = frame(spark, "seq string, teacher_user_id long, grade_id string",
                     [(f"{i}", None if i % 7 == 0 else 100 + i % 4, None if i % 11 == 0 else f"g{i % 300}") for i in range(400)])
    ok, rejects = access.grade_access(
        requests, table(spark, "teachers", [dict(teacher_id=t, user_id=100 + t) for t in range(3)]),
        table(spark, "grades", [dict(grade_id=f"g{g}", assignment_id=g % 50) for g in range(250)]),
        table(spark, "assignments", [dict(assignment_id=a, course_id=a % 9) for a in range(45)]),
        table(spark, "courses", [dict(course_id=c, teacher_id=c % 3) for c in range(8)]))

    def reason(i):
        if i % 7 == 0 or i % 4 == 3:
            return "Teacher not found"
        g = i % 300
        owner = g % 50 % 9 % 3 if i % 11 and g < 250 and g % 50 < 45 and g % 50 % 9 < 8 else None
        return None if owner == i % 4 else "You do not have permission to update this grade"
    assert {r.seq: r.reason for r in rejects.collect()} == {f"{i}": reason(i) for i in range(400) if reason(i)}
    assert sorted(int(r.seq) for r in ok.collect()) == [i for i in range(400) if not reason(i)]
    assert ("bitmap_construct_agg" in ok._jdf.queryExecution().toString()) == (few == 0 and many > 0)


def test_display_numbers_reads_its_lines_once(spark):
    from rollbook.plans.inspect import physical_plan
    from rollbook.registry import q19_display_numbers
    assert "Union" not in physical_plan(q19_display_numbers(spark, SF_SMALL))


def test_number_text_at_the_ends_of_its_ranges(spark):
    ends = {1e-3: "0.001", 9.999e-4: "0.0009999", 1e-4: "0.0001", 1e-5: "0.00001", 9.99e-6: "0.00000999", 1e-6: "0.000001", 9.5e-7: "9.5e-7",
            9999999.0: "9999999", 9999999.5: "9999999.5", 1e7: "10000000", 100.0: "100", 0.5: "0.5", 1e21: "1e+21", 1e20: "1" + "0" * 20}
    rows = list(ends.items()) + [(-x, "-" + t) for x, t in ends.items()] + [(0.0, "0"), (-0.0, "0"), (float("-inf"), "-Infinity"), (float("nan"), "NaN"), (None, None)]
    got = frame(spark, "x double, t string", rows).select("t", number_text("x").alias("got")).collect()
    assert [r.got for r in got] == [r.t for r in got]


def test_repeated_ids_are_not_shuffled(spark):
    from rollbook.operators import directory
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(20_000, numPartitions=2).selectExpr("if(id % 7 = 0, null, id % 50) AS user_id")
        found = directory.find_users_by_id(keys, table(spark, "users", [dict(user_id=u, domain_id=f"d{u}", role="student") for u in range(40, 90)]))
        assert sorted(r.user_id for r in found.collect()) == list(range(40, 50))
        assert max(shuffled_rows(found)) <= 2 * 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("few, many", [(10 ** 6, 10 ** 7), (0, 10 ** 7), (0, 0)])
def test_stored_deletions_however_many_keys(spark, monkeypatch, tmp_path, few, many):
    from rollbook.plans import batches
    from rollbook.sources.snapshots import create_snapshot
    monkeypatch.setattr(batches, "FILTER_FROM", few)
    monkeypatch.setattr(batches, "FILTER_TO", many)
    rows = table(spark, "fees", [dict(fee_id=i, student_id=None if i % 10 == 0 else i % 97) for i in range(500)])
    old = create_snapshot(rows, str(tmp_path / "fees"), "fees", "fee_id", 4)
    gone = materialize.materialize(frame(spark, "student_id long", [(s,) for s in range(0, 97, 3)]))
    touched = old.parts_with(gone, "student_id")
    stay, rest = batches.without_keys(old.read(touched), "student_id", gone)
    assert (stay is None, rest is None) == (many == 0, few > 0)
    new = old.rewrite(touched, rest, stay)
    assert sorted(r.fee_id for r in new.read().collect()) == [i for i in range(500) if i % 10 == 0 or i % 97 % 3]
    assert all(new.parts_of(new.read([p])) == [p] for p in new.held)

"""Course updates one after another against a sequential replay."""

import datetime as dt
import random

import pytest
from conftest import as_dicts, frame, table

from rollbook.operators import changes
from rollbook.plans.ids import running_last, running_sum

AS_OF = dt.datetime(2025, 1, 15)


def replay(courses, teachers, batch):
    state = {c["course_id"]: dict(c) for c in courses}
    rejects = []
    for seq, cid, fields in sorted(batch, key=lambda r: r[0]):
        fields = fields or {}
        code, name = fields.get("code") or None, fields.get("name") or None
        c = state.get(cid)
        if c is None:
            rejects.append((seq, "Course not found"))
        elif code and any(o["course_code"] == code for i, o in state.items() if i != cid):
            rejects.append((seq, "Course code already in use"))
        elif fields.get("teacher_id") is not None and int(fields["teacher_id"]) not in teachers:
            rejects.append((seq, "Teacher not found"))
        elif not (code or name or "description" in fields or "teacher_id" in fields):
            rejects.append((seq, "No fields to update"))
        else:
            c["course_code"], c["course_name"] = code or c["course_code"], name or c.get("course_name")
            for k in ("description", "teacher_id"):
                if k in fields:
                    c[k] = fields[k] if k == "description" or fields[k] is None else int(fields[k])
            c["updated_at"] = AS_OF
    return sorted((c["course_id"], c["course_code"], c.get("course_name"), c.get("description"), c.get("teacher_id"), c.get("updated_at")) for c in state.values()), sorted(rejects)


def run(spark, courses, teachers, batch):
    new, updated, rejects = changes.update_courses_in_order(
        table(spark, "courses", courses), table(spark, "teachers", [dict(teacher_id=t) for t in teachers]),
        frame(spark, "seq long, course_id long, fields map<string,string>", batch).repartition(3), AS_OF)
    rows = sorted((r["course_id"], r["course_code"], r["course_name"], r["description"], r["teacher_id"], r["updated_at"]) for r in as_dicts(new))
    assert updated.count() == sum(r[5] is not None for r in rows)
    return rows, sorted((r["seq"], r["reason"]) for r in as_dicts(rejects))


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_sequential_replay(spark, seed):
    r = random.Random(seed)
    courses = [dict(course_id=i, course_code=f"C{i}", course_name=f"n{i}", teacher_id=1) for i in range(7)] + [dict(course_id=7, course_code=None), dict(course_id=8, course_code="C0")]
    batch = []
    for seq in r.sample(range(1000), 60):
        fields = {}
        if r.random() < 0.85:
            fields["code"] = r.choice([f"C{r.randrange(9)}", f"N{r.randrange(3)}", ""])
        if r.random() < 0.2:
            fields["teacher_id"] = r.choice(["1", "2", "55", None])
        if r.random() < 0.2:
            fields["name"] = r.choice(["new", ""])
        if r.random() < 0.1:
            fields["description"] = r.choice(["d", None])
        batch.append((seq, r.choice([*range(9), 99]), fields))
    assert run(spark, courses, {1, 2}, batch) == replay(courses, {1, 2}, batch)


def test_a_freed_code_can_be_taken(spark):
    courses = [dict(course_id=i, course_code=f"C{i}") for i in range(4)]
    chain = [(10 - i, i, {"code": f"C{i + 1}"}) for i in range(3)] + [(1, 3, {"code": "X"})]  # the last course moves first
    rows, rejects = run(spark, courses, {1}, chain)
    assert [r[1] for r in rows] == ["C1", "C2", "C3", "X"] and rejects == []
    swapped, rejects = run(spark, courses[:2], {1}, [(1, 0, {"code": "C1"}), (2, 1, {"code": "C0"})])
    assert [r[1] for r in swapped] == ["C0", "C1"] and [s for s, _ in rejects] == [1, 2]


def test_one_code_for_all(spark):
    courses = [dict(course_id=i, course_code=f"C{i}") for i in range(60)]
    batch = [(i + 1, i, {"code": "HOT"}) for i in range(60)]
    rows, rejects = run(spark, courses, {1}, batch)
    assert [r[0] for r in rows if r[1] == "HOT"] == [0] and len(rejects) == 59


def test_no_requests(spark):
    courses = [dict(course_id=1, course_code="A")]
    assert run(spark, courses, set(), []) == replay(courses, set(), [])
    assert run(spark, courses, set(), [(1, 1, None)]) == replay(courses, set(), [(1, 1, None)])


def test_running_values(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.6 else f"g{r.randrange(5)}", r.choice([None, i]), r.randrange(-3, 4), r.choice([None, f"v{i}"])) for i in range(300)]
    rows = [(g, s if s is not None or all(x[1] is not None for x in rows if x[0] == g) else i, n, v) for i, (g, s, n, v) in enumerate(rows)]
    df = frame(spark, "g string, s long, n int, v string", rows).repartition(5)
    sums, lasts = running_sum(df, "g", ["s"], "n", "t").collect(), running_last(df, "g", ["s"], "v", "p").collect()
    assert len(sums) == len(lasts) == len(rows)
    for g in {x[0] for x in rows}:
        part = sorted((x for x in rows if x[0] == g), key=lambda x: x[1])
        total, last = {}, {}
        t, p = 0, None
        for _, s, n, v in part:
            t += n
            total[s], last[s] = t, p
            p = v if v is not None else p
        assert {x.s: x.t for x in sums if x.g == g} == total and {x.s: x.p for x in lasts if x.g == g} == last

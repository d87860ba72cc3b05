"""Oracle SQL (DuckDB) for the declared-only routes D1-D5."""

from __future__ import annotations

import re

from rollbook.oracle import READS, _pct, with_mapping
from rollbook.oracle_changes import AS_OF_TS, CHANGES

DECLARED: dict[str, str] = {}

DECLARED["d01_available_course_counts"] = with_mapping("""
SELECT s.student_id, coalesce(m.n, 0) AS enrolled_courses,
       (SELECT count(DISTINCT course_id) FROM courses) - coalesce(m.n, 0) AS available_courses
FROM students s LEFT JOIN (
  SELECT student_id, count(DISTINCT course_id) AS n FROM enrollments
  WHERE course_id IN (SELECT course_id FROM courses) GROUP BY student_id) m ON m.student_id = s.student_id
""")

DECLARED["d01_available_courses_set"] = with_mapping("""
SELECT s.c_custkey AS student_id, c.course_id AS id, c.course_name AS name, c.course_code AS code, c.description
FROM customer s, courses c
WHERE s.c_mktsegment = 'BUILDING' AND s.c_nationkey = 7
  AND NOT EXISTS (SELECT 1 FROM enrollments e WHERE e.student_id = s.c_custkey AND e.course_id = c.course_id)
""")

D2 = """
b AS (
  SELECT o_orderkey AS seq,
         CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey * 4 ELSE o_custkey * 4 + 1 END AS user_id,
         CASE WHEN o_orderstatus = 'F' THEN fp.first_part
              ELSE o_orderkey // 30 END AS course_id
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey) fp
       ON fp.l_orderkey = o_orderkey),
sk AS (SELECT user_id, min(student_id) AS student_id FROM students GROUP BY user_id),
chk AS (
  SELECT b.seq, b.course_id, sk.student_id,
         sk.student_id IS NULL AS no_student,
         b.course_id NOT IN (SELECT course_id FROM courses) OR b.course_id IS NULL AS no_course,
         EXISTS (SELECT 1 FROM enrollments e WHERE e.student_id = sk.student_id AND e.course_id = b.course_id)
           AS enrolled
  FROM b LEFT JOIN sk ON sk.user_id = b.user_id),
firsts AS (SELECT student_id, course_id, min(seq) AS first_seq FROM chk
           WHERE NOT no_student AND NOT no_course AND NOT enrolled GROUP BY student_id, course_id),
ann AS (
  SELECT chk.*,
         CASE WHEN no_student THEN 'Student not found' WHEN no_course THEN 'Course not found'
              WHEN enrolled OR coalesce(chk.seq > f.first_seq, false) THEN 'Already enrolled' END AS reason
  FROM chk LEFT JOIN firsts f ON f.student_id = chk.student_id AND f.course_id = chk.course_id)
"""
DECLARED["d02_enroll"] = with_mapping(f"""
SELECT * FROM enrollments
UNION ALL
SELECT student_id, course_id, 'active', CAST(NULL AS DOUBLE), {AS_OF_TS} FROM ann WHERE reason IS NULL
""", D2)
DECLARED["d02_enroll_rejects"] = with_mapping("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", D2)

DECLARED["d03_course_assignments"] = with_mapping("""
SELECT a.course_id, a.assignment_id AS id, a.title, a.description, a.due_date, a.total_marks, a.created_at
FROM assignments a WHERE a.course_id IN (SELECT course_id FROM courses)
""")

DECLARED["d04_course_attendance"] = with_mapping(f"""
SELECT course_id, date, total, present, absent, excused,
       {_pct('present', 'total')} AS present_percentage,
       {_pct('absent', 'total')} AS absent_percentage,
       {_pct('excused', 'total')} AS excused_percentage
FROM (
  SELECT course_id, attendance_date AS date, count(attendance_id) AS total,
         count(CASE WHEN status = 'present' THEN 1 END) AS present,
         count(CASE WHEN status = 'absent' THEN 1 END) AS absent,
         count(CASE WHEN status = 'excused' THEN 1 END) AS excused
  FROM attendance WHERE course_id IN (SELECT course_id FROM courses)
  GROUP BY course_id, attendance_date) x
""")

DECLARED["d05_student_progress"] = with_mapping(f"""
SELECT p.student_id, p.course_id,
       coalesce(a.n, 0) AS assignments, coalesce(g.n, 0) AS graded,
       coalesce(t.classes, 0) AS classes, coalesce(t.present, 0) AS present,
       {_pct('coalesce(t.present, 0)', 'coalesce(t.classes, 0)')} AS present_percentage
FROM (SELECT DISTINCT student_id, course_id FROM enrollments) p
LEFT JOIN (SELECT course_id, count(assignment_id) AS n FROM assignments GROUP BY course_id) a
       ON a.course_id = p.course_id
LEFT JOIN (SELECT g.student_id, a.course_id, count(g.assignment_id) AS n
           FROM grades g JOIN assignments a ON a.assignment_id = g.assignment_id
           WHERE coalesce(g.grade <> '', false) GROUP BY g.student_id, a.course_id) g
       ON g.student_id = p.student_id AND g.course_id = p.course_id
LEFT JOIN (SELECT student_id, course_id, count(attendance_id) AS classes,
                  count(CASE WHEN status = 'present' THEN 1 END) AS present
           FROM attendance GROUP BY student_id, course_id) t
       ON t.student_id = p.student_id AND t.course_id = p.course_id
""")

# Running counts: the plain answers over the table as the batch leaves it.
DECLARED["d02_enroll_stored"] = DECLARED["d02_enroll_key_filter"] = DECLARED["d02_enroll"]
for _name, _table, _after in (("q13_course_catalog", "enrollments", DECLARED["d02_enroll"]), ("q11_teacher_course_load", "enrollments", DECLARED["d02_enroll"]),
                              ("q07_attendance_stats", "attendance", CHANGES["c08_take_attendance"]), ("q10_fee_stats", "fees", CHANGES["c11_pay_fees"])):
    DECLARED[f"{_name}_running"] = re.sub(rf"\b(FROM|JOIN) {_table}\b", lambda m, after=_after: f"{m[1]} ({after})", READS[_name])

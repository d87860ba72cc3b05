"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the DataFrame code: the role mapping is spelled
out again as CTEs over the driver's raw tables, and each query is plain
SQL from the operator definitions.
"""

from __future__ import annotations

MAPPING = """
students AS (
  SELECT c_custkey AS student_id, c_custkey * 4 + 1 AS user_id, c_name AS name,
         'R' || CAST(c_custkey AS VARCHAR) AS roll_number,
         lower(c_mktsegment) || '.' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email,
         CAST(NULL AS VARCHAR) AS phone_number, c_mktsegment AS address
  FROM customer),
teachers AS (
  SELECT s_suppkey AS teacher_id, s_suppkey * 4 + 2 AS user_id, s_name AS name,
         't' || CAST(s_suppkey AS VARCHAR) || '@example.org' AS email,
         CAST(NULL AS VARCHAR) AS phone_number, n_name AS department
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
management AS (
  SELECT CAST(n_nationkey AS BIGINT) AS management_id, CAST(n_nationkey AS BIGINT) * 4 + 3 AS user_id,
         n_name AS name, 'm' || CAST(n_nationkey AS VARCHAR) || '@example.org' AS email,
         CAST(NULL AS VARCHAR) AS phone_number
  FROM nation),
users AS (
  SELECT s.user_id, 'stu_' || CAST(s.student_id AS VARCHAR) AS domain_id, 'student' AS role,
         fo.created_at
  FROM students s
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) fo
         ON fo.o_custkey = s.student_id
  UNION ALL
  SELECT user_id, 'tea_' || CAST(teacher_id AS VARCHAR), 'teacher', CAST(NULL AS TIMESTAMP) FROM teachers
  UNION ALL
  SELECT user_id, 'mgt_' || CAST(management_id AS VARCHAR), 'management', CAST(NULL AS TIMESTAMP)
  FROM management),
courses AS (
  SELECT p_partkey AS course_id, p_brand || '-' || CAST(p_partkey AS VARCHAR) AS course_code,
         p_name AS course_name, p_type AS schedule,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS teacher_id,
         CAST(NULL AS VARCHAR) AS description, CAST(NULL AS TIMESTAMP) AS updated_at
  FROM part),
enrollments AS (
  SELECT o_custkey AS student_id, l_partkey AS course_id, l_linestatus AS enrollment_status,
         abs(l_discount) AS progress, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
attendance AS (
  SELECT event_id AS attendance_id, user_id AS student_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS course_id,
         CAST(ts AS DATE) AS attendance_date,
         CASE event_type WHEN 'click' THEN 'present' WHEN 'view' THEN 'present'
                         WHEN 'error' THEN 'absent' WHEN 'purchase' THEN 'excused'
                         WHEN 'signup' THEN 'late' END AS status
  FROM events),
fees AS (
  SELECT o_orderkey AS fee_id, o_custkey AS student_id, o_totalprice AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'pending' WHEN 'O' THEN 'unpaid' END
           AS payment_status,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS payment_date
  FROM orders),
assignments AS (
  SELECT DISTINCT l_partkey * 10 + l_linenumber AS assignment_id, l_partkey AS course_id,
         'Assignment ' || CAST(l_linenumber AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS description,
         CAST(NULL AS DATE) AS due_date, CAST(50 AS DECIMAL(18,0)) AS total_marks,
         CAST(NULL AS TIMESTAMP) AS created_at
  FROM lineitem),
grades AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, o_custkey) AS grade_id, o_custkey AS student_id,
         l_partkey * 10 + l_linenumber AS assignment_id,
         CAST(max(CAST(trunc(l_quantity) AS INTEGER)) AS VARCHAR) AS grade,
         max(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS feedback,
         max(l_shipdate) AS submitted_at, CAST(NULL AS TIMESTAMP) AS graded_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY l_orderkey, l_linenumber, l_partkey, o_custkey),
notices AS (
  SELECT doc_id AS notice_id, 'Notice ' || CAST(doc_id AS VARCHAR) || ' (' || source || ')' AS title,
         text AS content,
         CAST(CASE doc_id % 3 WHEN 0 THEN (doc_id // 100) * 4 + 3
                              WHEN 1 THEN (doc_id // 20) * 4 + 2
                              ELSE (doc_id // 3) * 4 + 1 END AS BIGINT) AS posted_by_user_id,
         CAST(NULL AS TIMESTAMP) AS created_at
  FROM documents)
"""


def with_mapping(body: str, extra_ctes: str = "") -> str:
    ctes = MAPPING.strip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"


def _pct(part: str, total: str) -> str:
    return (f"CASE WHEN {total} > 0 THEN (CAST({part} AS DOUBLE) / CAST({total} AS DOUBLE)) * 100.0 "
            f"ELSE 0.0 END")


ENROLL_COUNTS = "SELECT course_id, count(student_id) AS enrolled_students FROM enrollments GROUP BY course_id"

READS: dict[str, str] = {}

# Q1: one tagged union of the three role tables.  The name and e-mail of a
# user are those tagged with the user's own role; the search looks at all tags.
PROFILES = """
profiles AS (
  SELECT user_id, 'student' AS tag, name, email FROM students
  UNION ALL SELECT user_id, 'teacher', name, email FROM teachers
  UNION ALL SELECT user_id, 'management', name, email FROM management)
"""

READS["q01_user_directory"] = with_mapping("""
SELECT users.user_id AS id, domain_id, role, created_at, own.name, own.email
FROM users LEFT JOIN profiles own ON (own.user_id, own.tag) = (users.user_id, users.role)
""", PROFILES)

READS["q01_user_directory_search"] = with_mapping("""
SELECT users.user_id AS id, domain_id, role, created_at, own.name, own.email
FROM users LEFT JOIN profiles own ON (own.user_id, own.tag) = (users.user_id, users.role)
WHERE role = 'student'
  AND (domain_id ILIKE '%1_0%'
       OR users.user_id IN (SELECT user_id FROM profiles WHERE name ILIKE '%1_0%' OR email ILIKE '%1_0%'))
""", PROFILES)

for _name, _term in (("", "mer#%7_1"), ("_short", "1_0")):
    READS[f"q01_user_directory_search_indexed{_name}"] = with_mapping(f"""
SELECT users.user_id AS id, domain_id, role, created_at, own.name, own.email
FROM users LEFT JOIN profiles own ON (own.user_id, own.tag) = (users.user_id, users.role)
WHERE domain_id ILIKE '%{_term}%'
   OR users.user_id IN (SELECT user_id FROM profiles WHERE name ILIKE '%{_term}%' OR email ILIKE '%{_term}%')
""", PROFILES)

READS["q02_student_profile"] = with_mapping("""
SELECT s.user_id, s.student_id AS id, s.name, s.roll_number, s.email, s.phone_number, s.address
FROM students s JOIN users u ON s.user_id = u.user_id
""")

READS["q03_teacher_profile"] = with_mapping("""
SELECT t.user_id, t.teacher_id AS id, t.name, t.email, t.phone_number, t.department
FROM teachers t JOIN users u ON t.user_id = u.user_id
""")

READS["q04_student_courses"] = with_mapping("""
SELECT e.student_id, c.course_id AS id, c.course_name AS name, c.course_code AS code, c.description,
       e.progress, e.enrollment_status AS status
FROM courses c JOIN enrollments e ON c.course_id = e.course_id
""")

READS["q05_student_grades"] = with_mapping("""
SELECT g.student_id, g.grade_id AS id, g.grade, g.feedback, g.submitted_at,
       a.title AS assignment_title, c.course_name, c.course_code
FROM grades g JOIN assignments a ON g.assignment_id = a.assignment_id
JOIN courses c ON a.course_id = c.course_id
""")

READS["q06_student_attendance"] = with_mapping("""
SELECT a.student_id, a.attendance_id AS id, a.attendance_date AS date, a.status,
       c.course_name, c.course_code
FROM attendance a JOIN courses c ON a.course_id = c.course_id
""")

READS["q07_attendance_stats"] = with_mapping(f"""
SELECT student_id, total_classes, present, absent, excused,
       {_pct('present', 'total_classes')} AS present_percentage,
       {_pct('absent', 'total_classes')} AS absent_percentage,
       {_pct('excused', 'total_classes')} AS excused_percentage
FROM (
  SELECT s.student_id, count(a.attendance_id) AS total_classes,
         count(CASE WHEN a.status = 'present' THEN 1 END) AS present,
         count(CASE WHEN a.status = 'absent' THEN 1 END) AS absent,
         count(CASE WHEN a.status = 'excused' THEN 1 END) AS excused
  FROM students s
  LEFT JOIN (SELECT a.* FROM attendance a JOIN courses c ON a.course_id = c.course_id) a
         ON a.student_id = s.student_id
  GROUP BY s.student_id) x
""")

# Q8: posters are users; teachers and managers show the name tagged with their role.
READS["q08_notice_board"] = with_mapping("""
, shown AS (
  SELECT user_id, CASE WHEN role IN ('teacher', 'management') THEN own.name ELSE domain_id END AS posted_by
  FROM users LEFT JOIN profiles own USING (user_id)
  WHERE own.tag IS NULL OR own.tag = role
     OR NOT EXISTS (SELECT 1 FROM profiles p WHERE p.user_id = users.user_id AND p.tag = role))
SELECT notice_id AS id, title, content, created_at, posted_by
FROM notices JOIN shown ON user_id = posted_by_user_id
""", PROFILES)

READS["q09_fee_detail"] = with_mapping("""
SELECT f.student_id, f.fee_id AS id, f.amount, f.payment_status, f.payment_date
FROM fees f WHERE f.student_id IN (SELECT student_id FROM students)
""")

READS["q10_fee_stats"] = with_mapping(f"""
SELECT student_id, total_fees, paid_fees, pending_fees, unpaid_fees,
       {_pct('paid_fees', 'total_fees')} AS paid_percentage
FROM (
  SELECT s.student_id,
         CAST(coalesce(sum(CAST(f.amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_fees,
         CAST(coalesce(sum(CASE WHEN f.payment_status = 'paid' THEN CAST(f.amount AS DECIMAL(18,2)) END), 0)
              AS DOUBLE) AS paid_fees,
         CAST(coalesce(sum(CASE WHEN f.payment_status = 'pending' THEN CAST(f.amount AS DECIMAL(18,2)) END), 0)
              AS DOUBLE) AS pending_fees,
         CAST(coalesce(sum(CASE WHEN f.payment_status = 'unpaid' THEN CAST(f.amount AS DECIMAL(18,2)) END), 0)
              AS DOUBLE) AS unpaid_fees
  FROM students s LEFT JOIN fees f ON f.student_id = s.student_id
  GROUP BY s.student_id) x
""")

READS["q11_teacher_course_load"] = with_mapping("""
SELECT c.teacher_id, c.course_id AS id, c.course_code AS code, c.course_name AS name, c.schedule,
       count(e.student_id) AS enrolled_students
FROM courses c LEFT JOIN enrollments e ON c.course_id = e.course_id
WHERE c.teacher_id IN (SELECT teacher_id FROM teachers)
GROUP BY c.teacher_id, c.course_id, c.course_code, c.course_name, c.schedule
""")

READS["q12_course_roster"] = with_mapping("""
SELECT e.course_id, s.student_id AS id, s.name, s.email, s.roll_number,
       e.enrollment_status AS status, e.created_at AS enrolled_at
FROM students s JOIN enrollments e ON s.student_id = e.student_id
WHERE e.course_id IN (SELECT course_id FROM courses)
""")

# Q13: counts per course first, then one row per course.
CATALOG = f"""
SELECT course_id AS id, course_code AS code, course_name AS name, schedule, teacher_id,
       (SELECT any_value(t.name) FROM teachers t WHERE t.teacher_id = courses.teacher_id) AS teacher_name,
       coalesce(n.enrolled_students, 0) AS enrolled_students
FROM courses LEFT JOIN ({ENROLL_COUNTS}) n USING (course_id)
"""

READS["q13_course_catalog"] = READS["q13_course_catalog_sorted"] = with_mapping(CATALOG)
READS["q13_course_catalog_teacher"] = with_mapping(CATALOG + "WHERE teacher_id = 4")
READS["q13_course_catalog_search"] = with_mapping(
    CATALOG + "WHERE concat_ws(chr(10), course_code, course_name) ILIKE '%#1_-%'")

READS["q13_course_catalog_search_indexed"] = with_mapping(
    CATALOG + "WHERE course_code ILIKE '%and#1_-%' OR course_name ILIKE '%and#1_-%'")

READS["q14_find_users_by_email"] = with_mapping("""
SELECT email, user_id, role FROM (
  SELECT r.email, u.user_id, u.role,
         row_number() OVER (PARTITION BY r.email ORDER BY u.user_id, u.role) AS rn
  FROM (SELECT DISTINCT email FROM requested) r
  JOIN (SELECT user_id, email FROM students UNION ALL SELECT user_id, email FROM teachers
        UNION ALL SELECT user_id, email FROM management) x ON x.email = r.email
  JOIN users u ON u.user_id = x.user_id) y
WHERE rn = 1
""", extra_ctes="""
requested AS (
  SELECT lower(c_mktsegment) || '.' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email FROM customer
  UNION ALL SELECT 't' || CAST(s_suppkey AS VARCHAR) || '@example.org' FROM supplier
  UNION ALL SELECT 'nobody.' || CAST(n_nationkey AS VARCHAR) || '@example.org' FROM nation)
""")

READS["q15_find_users_by_domain_id"] = with_mapping("""
SELECT u.user_id, u.domain_id, u.role
FROM users u WHERE u.domain_id IN (SELECT domain_id FROM requested)
""", extra_ctes="""
requested AS (
  SELECT 'stu_' || CAST(o_custkey AS VARCHAR) AS domain_id FROM orders
  UNION ALL SELECT 'tea_' || CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'ghost_' || CAST(n_nationkey AS VARCHAR) FROM nation)
""")

READS["q15_find_users_by_id"] = with_mapping("""
SELECT u.user_id, u.domain_id, u.role FROM users u
WHERE u.user_id IN (SELECT o_custkey * 4 + 1 FROM orders
                    UNION ALL SELECT s_suppkey * 4 + 2 FROM supplier
                    UNION ALL SELECT s_suppkey * 4 FROM supplier)
""")

READS["q18_attendance_sheet"] = with_mapping("""
SELECT r.course_id, r.student_id,
       coalesce(nullif(o.status, ''), 'present') AS status
FROM (SELECT e.course_id, e.student_id FROM enrollments e) r
LEFT JOIN (
  SELECT course_id, student_id, arg_max(status, attendance_id) AS status
  FROM attendance GROUP BY course_id, student_id) o
  ON o.course_id = r.course_id AND o.student_id = r.student_id
""")

READS["q19_display_grades"] = with_mapping("""
SELECT g.student_id, g.grade_id AS id,
       c.course_name || ' (' || c.course_code || ')' AS course_text,
       a.title AS assignment_title,
       coalesce(nullif(g.grade, ''), 'Not graded') AS grade_text,
       coalesce(nullif(g.feedback, ''), '-') AS feedback_text,
       strftime(g.submitted_at, '%-m/%-d/%Y') AS submitted_text
FROM grades g JOIN assignments a ON g.assignment_id = a.assignment_id
JOIN courses c ON a.course_id = c.course_id
""")

READS["q19_display_courses"] = with_mapping("""
SELECT e.student_id, c.course_id AS id, c.course_name AS name, c.course_code AS code,
       e.enrollment_status AS status,
       CASE WHEN e.progress IS NULL OR e.progress = 0 THEN '0%'
            WHEN e.progress = floor(e.progress) THEN CAST(CAST(e.progress AS BIGINT) AS VARCHAR)
            ELSE CAST(e.progress AS VARCHAR) END AS progress_text
FROM courses c JOIN enrollments e ON c.course_id = e.course_id
""")

READS["q19_display_attendance"] = with_mapping("""
SELECT a.student_id, a.attendance_id AS id, c.course_name || ' (' || c.course_code || ')' AS course_text,
       strftime(a.attendance_date, '%-m/%-d/%Y') AS date_text, a.status, lower(a.status) AS status_class
FROM attendance a JOIN courses c ON a.course_id = c.course_id
""")

READS["q19_display_roster"] = with_mapping("""
SELECT e.course_id, s.student_id AS id, s.name, s.email,
       strftime(e.created_at, '%-m/%-d/%Y') AS enrolled_text, '0%' AS progress_text
FROM students s JOIN enrollments e ON s.student_id = e.student_id
WHERE e.course_id IN (SELECT course_id FROM courses)
""")

READS["q19_display_catalog"] = with_mapping("""
SELECT c.course_id AS id, c.course_name AS name, c.course_code AS code,
       coalesce(nullif(t.name, ''), 'Not assigned') AS teacher_text
FROM courses c LEFT JOIN teachers t ON c.teacher_id = t.teacher_id
""")


# toFixed(1): printf rounds the exact value and exact ties to even; ties are multiples of 1/4 that are none of 1/2, and go up.
_FIXED = """CASE WHEN {0} * 4 = floor({0} * 4) AND {0} * 2 <> floor({0} * 2) THEN printf('%.1f', {0} + 0.05) ELSE printf('%.1f', {0}) END || '%'"""
READS["q19_display_stats"] = f"""
SELECT student_id, {_FIXED.format("present_percentage")} AS present_text, {_FIXED.format("absent_percentage")} AS absent_text,
       CAST(total_classes AS VARCHAR) AS total_text
FROM ({READS["q07_attendance_stats"]}) q
"""

READS["q19_display_numbers"] = with_mapping("""
SELECT l.student_id, c.course_id AS id, c.course_name AS name, c.course_code AS code, l.status, l.progress_text
FROM (
  SELECT l_orderkey AS student_id, l_partkey AS course_id, 'whole' AS status, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS progress_text FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_partkey, 'price', CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR)
                                              ELSE CAST(CAST(l_extendedprice AS DOUBLE) AS VARCHAR) END FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, 'small', '0.0000' || CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, 'none', '0%' FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, 'missing', '0%' FROM lineitem) l
JOIN courses c ON c.course_id = l.course_id
""")

READS["q19_display_teacher_courses"] = f"""
SELECT teacher_id, id, name, 'Code: ' || coalesce(code, '') AS code_text,
       'Students: ' || CAST(enrolled_students AS VARCHAR) AS students_text
FROM ({READS["q11_teacher_course_load"]}) q
"""

READS["q05_student_grades_sorted"] = READS["q05_student_grades"]
READS["s01_snapshot_round_trip"] = with_mapping("SELECT * FROM users")
READS["s03_requests_or_rejects"] = """
SELECT CASE WHEN fine THEN c_custkey END AS seq, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN c_custkey END AS user_id,
       CASE WHEN fine AND c_mktsegment <> 'AUTOMOBILE' THEN c_name END AS title,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '7' WHEN fine THEN 'x' END AS code, CASE WHEN fine THEN c_mktsegment = 'AUTOMOBILE' END AS clears_name,
       CASE c_mktsegment WHEN 'MACHINERY' THEN '{"seq": ' || k || ', "title"' WHEN 'HOUSEHOLD' THEN '{"seq": "no' || k || '", "user_id": true}'
                         WHEN 'FURNITURE' THEN '[{"seq": ' || k || '}]' END AS line,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'Request body is not JSON' WHEN 'HOUSEHOLD' THEN 'Wrong type: seq, user_id'
                         WHEN 'FURNITURE' THEN 'Request body must be an object' END AS reason
FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k, c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE') AS fine FROM customer) c
"""
READS["s03_changes_from_json"] = """
SELECT o_orderkey * 2 AS seq,
       CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey * 4 + 5 WHEN '5-LOW' THEN o_custkey * 4
            ELSE o_custkey * 4 + 1 END AS user_id, o_orderkey AS fee_id
FROM orders
UNION ALL
SELECT o_orderkey * 2 + 1, o_custkey * 4 + 1, o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'
"""

REQUESTS = """
SELECT c_custkey * 2 AS seq, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey * 4 ELSE c_custkey * 4 + 1 END AS user_id
FROM customer
UNION ALL
SELECT s_suppkey * 2 + 1, CASE WHEN s_acctbal < 0 THEN s_suppkey * 4 ELSE s_suppkey * 4 + 2 END FROM supplier
"""
READS["q01_user_by_id"] = f"SELECT id AS user_id, * EXCLUDE (id) FROM ({READS['q01_user_directory']}) q"
# Requests name users; the answer's key (a user id, or a role table's id) is a user id times 1, or follows from it.
for _name, _key, _to_user, _message in (
        ("q01_user_by_id", "user_id", "{}", "User not found"),
        ("q02_student_profile", "user_id", "{}", "Student profile not found"),
        ("q03_teacher_profile", "user_id", "{}", "Teacher profile not found"),
        ("q09_fee_detail", "student_id", "{} * 4 + 1", "Student not found"),
        ("q10_fee_stats", "student_id", "{} * 4 + 1", "Student not found"),
        ("q11_teacher_course_load", "teacher_id", "{} * 4 + 2", "Teacher not found")):
    _users = {"student_id": "SELECT c_custkey * 4 + 1 FROM customer", "teacher_id": "SELECT s_suppkey * 4 + 2 FROM supplier"}.get(
        _key, f"SELECT user_id FROM ({READS[_name]}) k")
    READS[f"{_name}_requests"] = f"SELECT r.seq, q.* FROM ({REQUESTS}) r JOIN ({READS[_name]}) q ON {_to_user.format('q.' + _key)} = r.user_id"
    READS[f"{_name}_requests_rejects"] = f"SELECT seq, '{_message}' AS reason FROM ({REQUESTS}) r WHERE user_id NOT IN ({_users})"
del READS["q01_user_by_id"]

# The key-filtered forms: the unfiltered answer restricted to student 7, teacher 4, course 12.
for _name, _key in (("q04_student_courses", "student_id = 7"), ("q05_student_grades", "student_id = 7"),
                    ("q07_attendance_stats", "student_id = 7"), ("q09_fee_detail", "student_id = 7"),
                    ("q10_fee_stats", "student_id = 7"), ("q11_teacher_course_load", "teacher_id = 4"),
                    ("q12_course_roster", "course_id = 12")):
    READS[f"{_name}_one"] = f"SELECT * FROM ({READS[_name]}) q WHERE {_key}"


def oracle_sql() -> dict[str, str]:
    from rollbook.oracle_changes import CHANGES
    from rollbook.oracle_declared import DECLARED
    out = dict(READS)
    out.update(CHANGES)
    out.update(DECLARED)
    return out

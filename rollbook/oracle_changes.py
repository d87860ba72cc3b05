"""Oracle SQL (DuckDB) for the change batches and the access checks.

Each batch recipe is restated in SQL; checks are CASE chains in the
application's order; "first valid wins" is a grouped min(seq); new ids are
max(id) + row_number() in seq order.
"""

from __future__ import annotations

from rollbook.oracle import with_mapping

AS_OF_TS = "TIMESTAMP '2025-01-15 09:30:00'"
AS_OF_DATE = "DATE '2025-01-15'"


def ps(x: str) -> str:
    """SQL for a truthy string."""
    return f"coalesce({x} <> '', false)"


def _run(body: str, ctes: str) -> str:
    return with_mapping(body, ctes)


def tu(size: str, wrong: str) -> str:
    """Teacher user id of a part's course (or the next teacher when ``wrong``)."""
    return f"CAST(CASE WHEN {wrong} THEN {size} + 1 ELSE {size} END AS BIGINT) * 4 + 2"


CHANGES: dict[str, str] = {}

# ------------------------------------------------------------- Q16 / Q17
Q16 = f"""
req AS (
  SELECT p_partkey AS seq,
         CAST(CASE WHEN p_type = 'LARGE' THEN p_partkey * 4 + 1
                   ELSE {tu('p_size', "p_type = 'PROMO'")} END AS BIGINT) AS teacher_user_id,
         p_partkey AS course_id
  FROM part),
tk AS (SELECT user_id, min(teacher_id) AS teacher_id FROM teachers GROUP BY user_id),
ann AS (
  SELECT r.seq, r.teacher_user_id, r.course_id, tk.teacher_id,
         CASE WHEN tk.teacher_id IS NULL THEN 'Teacher not found'
              WHEN NOT coalesce(c.teacher_id = tk.teacher_id, false)
                THEN 'You do not have permission to access this course' END AS reason
  FROM req r LEFT JOIN tk ON tk.user_id = r.teacher_user_id
  LEFT JOIN courses c ON c.course_id = r.course_id)
"""
CHANGES["q16_course_access"] = _run(
    "SELECT seq, teacher_user_id, course_id, teacher_id FROM ann WHERE reason IS NULL", Q16)
CHANGES["q16_course_access_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", Q16)

GRADE_REQ = """
gq AS (
  SELECT g.grade_id, g.grade, g.feedback, c.teacher_id AS course_teacher
  FROM grades g LEFT JOIN courses c ON c.course_id = CAST(floor(g.assignment_id / 10) AS BIGINT)),
greq AS (
  SELECT grade_id || '#1' AS seq,
         CASE WHEN feedback = 'A' THEN course_teacher * 4 + 6 ELSE course_teacher * 4 + 2 END
           AS teacher_user_id,
         grade_id,
         CASE WHEN grade = '1' THEN '' ELSE grade || '/50' END AS grade,
         CASE WHEN feedback IS NOT NULL THEN 'Reviewed ' || feedback END AS feedback
  FROM gq
  UNION ALL
  SELECT grade_id || '#2',
         CASE WHEN feedback = 'A' THEN course_teacher * 4 + 6 ELSE course_teacher * 4 + 2 END,
         grade_id, 'A+', CAST(NULL AS VARCHAR)
  FROM gq WHERE feedback = 'R'),
tk AS (SELECT user_id, min(teacher_id) AS teacher_id FROM teachers GROUP BY user_id),
owner AS (
  SELECT g.grade_id, c.teacher_id AS owner_id
  FROM grades g JOIN assignments a ON g.assignment_id = a.assignment_id
  JOIN courses c ON a.course_id = c.course_id),
gann AS (
  SELECT r.*, tk.teacher_id,
         CASE WHEN tk.teacher_id IS NULL THEN 'Teacher not found'
              WHEN NOT coalesce(o.owner_id = tk.teacher_id, false)
                THEN 'You do not have permission to update this grade' END AS access_reason
  FROM greq r LEFT JOIN tk ON tk.user_id = r.teacher_user_id
  LEFT JOIN owner o ON o.grade_id = r.grade_id)
"""
CHANGES["q17_grade_access"] = _run(
    "SELECT seq, teacher_user_id, grade_id, teacher_id FROM gann WHERE access_reason IS NULL", GRADE_REQ)
CHANGES["q17_grade_access_rejects"] = _run(
    "SELECT seq, access_reason AS reason FROM gann WHERE access_reason IS NOT NULL", GRADE_REQ)

# ------------------------------------------------------------- C1 create users
def c1_ctes(register: bool) -> str:
    """Create-users CTEs; ``register`` leaves AUTOMOBILE roles empty (default student)."""
    auto_role = "NULL" if register else "'guest'"
    role_expr = "coalesce(nullif(role, ''), 'student')" if register else "role"
    role_check = "" if register else f" AND {ps('role')}"
    msg = ("Please provide domain_id, password, name, and email" if register
           else "Please provide domain_id, password, role, name, and email")
    return f"""
b0 AS (
  SELECT c_custkey AS seq,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'stu_' || CAST(c_custkey AS VARCHAR)
                           WHEN 'MACHINERY' THEN 'new_' || CAST(c_nationkey AS VARCHAR)
                           ELSE 'cust_' || CAST(c_custkey AS VARCHAR) END AS domain_id,
         CASE WHEN c_acctbal < 0 THEN '' ELSE 'pw' || CAST(c_custkey AS VARCHAR) END AS password,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'teacher' WHEN c_mktsegment = 'AUTOMOBILE' THEN {auto_role}
              WHEN c_mktsegment = 'FURNITURE' AND c_acctbal > 8000 THEN 'management'
              ELSE 'student' END AS role,
         c_name AS name,
         lower(c_mktsegment) || '.new' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email,
         CASE WHEN c_acctbal > 5000 THEN '' ELSE '555-' || CAST(c_custkey AS VARCHAR) END AS phone_number,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Dept ' || CAST(c_nationkey AS VARCHAR) END AS department,
         c_mktsegment AS address,
         CASE WHEN c_acctbal BETWEEN 0 AND 1500 THEN NULL ELSE 'N' || CAST(c_custkey AS VARCHAR) END
           AS roll_number
  FROM customer),
b AS (
  SELECT seq, domain_id, password, {role_expr} AS role, name, email, phone_number, department, address,
         roll_number
  FROM b0),
chk AS (
  SELECT b.*,
         NOT ({ps('domain_id')} AND {ps('password')} AND {ps('name')} AND {ps('email')}{role_check})
           AS missing,
         domain_id IN (SELECT domain_id FROM users WHERE domain_id IS NOT NULL) AS taken,
         coalesce(role = 'student', false) AND NOT {ps('roll_number')} AS no_roll
  FROM b),
firsts AS (
  SELECT domain_id, min(seq) AS first_seq FROM chk
  WHERE NOT missing AND NOT coalesce(taken, false) AND NOT no_roll GROUP BY domain_id),
ann AS (
  SELECT chk.*,
         CASE WHEN missing THEN '{msg}'
              WHEN coalesce(taken, false) OR coalesce(chk.seq > f.first_seq, false) THEN 'User already exists'
              WHEN no_roll THEN 'Roll number is required for students' END AS reason
  FROM chk LEFT JOIN firsts f ON f.domain_id = chk.domain_id),
acc AS (
  SELECT ann.*, (SELECT coalesce(max(user_id), 0) FROM users) + row_number() OVER (ORDER BY seq) AS new_user_id
  FROM ann WHERE reason IS NULL)
"""


C1_USERS = f"""
SELECT user_id, domain_id, role, created_at FROM users
UNION ALL SELECT new_user_id, domain_id, role, {AS_OF_TS} FROM acc
"""
C1_STUDENTS = """
SELECT * FROM students
UNION ALL
SELECT (SELECT coalesce(max(student_id), 0) FROM students) + row_number() OVER (ORDER BY seq),
       new_user_id, name, roll_number, email, nullif(phone_number, ''), nullif(address, '')
FROM acc WHERE role = 'student'
"""
C1_REJECTS = "SELECT seq, reason FROM ann WHERE reason IS NOT NULL"
C1 = c1_ctes(register=False)
C1R = c1_ctes(register=True)

CHANGES["c01_create_users"] = _run(C1_USERS, C1)
CHANGES["c01_create_users_students"] = _run(C1_STUDENTS, C1)
CHANGES["c01_create_users_teachers"] = _run("""
SELECT * FROM teachers
UNION ALL
SELECT (SELECT coalesce(max(teacher_id), 0) FROM teachers) + row_number() OVER (ORDER BY seq),
       new_user_id, name, email, nullif(phone_number, ''), nullif(department, '')
FROM acc WHERE role = 'teacher'
""", C1)
CHANGES["c01_create_users_management"] = _run("""
SELECT * FROM management
UNION ALL
SELECT (SELECT coalesce(max(management_id), 0) FROM management) + row_number() OVER (ORDER BY seq),
       new_user_id, name, email, nullif(phone_number, '')
FROM acc WHERE role = 'management'
""", C1)
CHANGES["c01_create_users_rejects"] = _run(C1_REJECTS, C1)
CHANGES["c01_create_users_created"] = _run("SELECT new_user_id AS id, domain_id, role, name, email FROM acc", C1)
CHANGES["c01_register_users"] = _run(C1_USERS, C1R)
CHANGES["c01_register_users_students"] = _run(C1_STUDENTS, C1R)
CHANGES["c01_register_users_teachers"] = _run("""
SELECT * FROM teachers
UNION ALL
SELECT (SELECT coalesce(max(teacher_id), 0) FROM teachers) + row_number() OVER (ORDER BY seq),
       new_user_id, name, email, nullif(phone_number, ''), nullif(department, '')
FROM acc WHERE role = 'teacher'
""", C1R)
CHANGES["c01_register_users_management"] = _run("""
SELECT * FROM management
UNION ALL
SELECT (SELECT coalesce(max(management_id), 0) FROM management) + row_number() OVER (ORDER BY seq),
       new_user_id, name, email, nullif(phone_number, '')
FROM acc WHERE role = 'management'
""", C1R)
CHANGES["c01_register_users_created"] = _run("SELECT new_user_id AS id, domain_id, role, name, email FROM acc", C1R)
CHANGES["c01_register_users_rejects"] = _run(C1_REJECTS, C1R)

# ------------------------------------------------------------- C2 update users
C2 = f"""
b AS (
  SELECT c_custkey * 5 AS seq, c_custkey * 4 + 1 AS user_id,
         CASE WHEN c_acctbal > 5000 THEN upper(c_name) ELSE '' END AS name,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'new.' || CAST(c_custkey AS VARCHAR) || '@example.org' END
           AS email,
         '+1-555-' || CAST(c_custkey AS VARCHAR) AS phone_number,
         'ignored' AS department,
         CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment || ' Hall' END AS address
  FROM customer
  UNION ALL
  SELECT c_custkey * 5 + 1, c_custkey * 4 + 1, c_name || ' II', NULL, NULL, NULL, NULL
  FROM customer WHERE c_mktsegment = 'FURNITURE'
  UNION ALL
  SELECT s_suppkey * 5 + 2, s_suppkey * 4 + 2, NULL, '', NULL,
         'Dept ' || CAST(s_nationkey AS VARCHAR), 'nowhere'
  FROM supplier
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT) * 5 + 3, CAST(n_nationkey AS BIGINT) * 4 + 3, lower(n_name),
         NULL, '', 'x', 'y'
  FROM nation
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT) * 5 + 4, CAST(n_nationkey AS BIGINT) * 4, 'Ghost',
         NULL, NULL, NULL, NULL
  FROM nation),
roles AS (
  SELECT user_id, min(CASE WHEN role <> 'management' OR user_id % 20 <> 3 THEN role END) AS role, true AS known
  FROM users GROUP BY user_id),
prof AS (
  SELECT DISTINCT user_id, 'student' AS role FROM students
  UNION SELECT DISTINCT user_id, 'teacher' FROM teachers
  UNION SELECT DISTINCT user_id, 'management' FROM management),
ann AS (
  SELECT b.*, r.role,
         CASE WHEN r.known IS NULL THEN 'User not found'
              WHEN p.user_id IS NULL THEN coalesce(r.role, 'null') || ' profile not found' END AS reason
  FROM b LEFT JOIN roles r ON r.user_id = b.user_id
  LEFT JOIN prof p ON p.user_id = b.user_id AND p.role = r.role),
acc AS (SELECT * FROM ann WHERE reason IS NULL),
patch AS (
  SELECT user_id, role,
         arg_max(name, seq) FILTER (WHERE {ps('name')}) AS u_name,
         arg_max(email, seq) FILTER (WHERE {ps('email')}) AS u_email,
         arg_max(phone_number, seq) FILTER (WHERE {ps('phone_number')}) AS u_phone,
         arg_max(address, seq) FILTER (WHERE {ps('address')}) AS u_address,
         arg_max(department, seq) FILTER (WHERE {ps('department')}) AS u_department
  FROM acc GROUP BY user_id, role)
"""
CHANGES["c02_update_users_students"] = _run("""
SELECT s.student_id, s.user_id, coalesce(p.u_name, s.name) AS name, s.roll_number,
       coalesce(p.u_email, s.email) AS email, coalesce(p.u_phone, s.phone_number) AS phone_number,
       coalesce(p.u_address, s.address) AS address
FROM students s LEFT JOIN patch p ON p.user_id = s.user_id AND p.role = 'student'
""", C2)
CHANGES["c02_update_users_teachers"] = _run("""
SELECT t.teacher_id, t.user_id, coalesce(p.u_name, t.name) AS name,
       coalesce(p.u_email, t.email) AS email, coalesce(p.u_phone, t.phone_number) AS phone_number,
       coalesce(p.u_department, t.department) AS department
FROM teachers t LEFT JOIN patch p ON p.user_id = t.user_id AND p.role = 'teacher'
""", C2)
CHANGES["c02_update_users_management"] = _run("""
SELECT m.management_id, m.user_id, coalesce(p.u_name, m.name) AS name,
       coalesce(p.u_email, m.email) AS email, coalesce(p.u_phone, m.phone_number) AS phone_number
FROM management m LEFT JOIN patch p ON p.user_id = m.user_id AND p.role = 'management'
""", C2)
CHANGES["c02_update_users_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C2)
CHANGES["c02_update_users_updated"] = _run("""
SELECT s.user_id AS id, 'student' AS role, coalesce(p.u_name, s.name) AS name,
       coalesce(p.u_email, s.email) AS email, coalesce(p.u_phone, s.phone_number) AS phone_number,
       coalesce(p.u_address, s.address) AS address, CAST(NULL AS VARCHAR) AS department
FROM students s JOIN patch p ON p.user_id = s.user_id AND p.role = 'student'
UNION ALL
SELECT t.user_id, 'teacher', coalesce(p.u_name, t.name), coalesce(p.u_email, t.email),
       coalesce(p.u_phone, t.phone_number), CAST(NULL AS VARCHAR), coalesce(p.u_department, t.department)
FROM teachers t JOIN patch p ON p.user_id = t.user_id AND p.role = 'teacher'
UNION ALL
SELECT m.user_id, 'management', coalesce(p.u_name, m.name), coalesce(p.u_email, m.email),
       coalesce(p.u_phone, m.phone_number), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
FROM management m JOIN patch p ON p.user_id = m.user_id AND p.role = 'management'
""", C2)

# ------------------------------------------------------------- C3 delete users
C3 = f"""
b AS (
  SELECT c_custkey * 5 AS seq,
         CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey * 4 + 1 ELSE c_custkey * 4 END AS user_id
  FROM customer
  UNION ALL
  SELECT c_custkey * 5 + 1, c_custkey * 4 + 1 FROM customer
  WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000
  UNION ALL
  SELECT s_suppkey * 5 + 2, s_suppkey * 4 + 2 FROM supplier WHERE s_acctbal < 0),
firsts AS (SELECT user_id, min(seq) AS first_seq FROM b WHERE user_id IN (SELECT user_id FROM users)
           GROUP BY user_id),
ann AS (
  SELECT b.seq, b.user_id,
         CASE WHEN f.first_seq IS NULL OR b.seq > f.first_seq THEN 'User not found' END AS reason
  FROM b LEFT JOIN firsts f ON f.user_id = b.user_id),
doomed AS (SELECT DISTINCT user_id FROM ann WHERE reason IS NULL)
"""
CHANGES["c03_delete_users"] = _run(
    "SELECT * FROM users WHERE user_id NOT IN (SELECT user_id FROM doomed)", C3)
CHANGES["c03_delete_users_students"] = _run(
    "SELECT * FROM students WHERE user_id NOT IN (SELECT user_id FROM doomed)", C3)
CHANGES["c03_delete_users_teachers"] = _run(
    "SELECT * FROM teachers WHERE user_id NOT IN (SELECT user_id FROM doomed)", C3)
CHANGES["c03_delete_users_management"] = _run(
    "SELECT * FROM management WHERE user_id NOT IN (SELECT user_id FROM doomed)", C3)
CHANGES["c03_delete_users_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C3)

# ------------------------------------------------------------- C4 create courses
C4 = f"""
b AS (
  SELECT p_partkey AS seq,
         CASE p_type WHEN 'PROMO' THEN p_brand || '-' || CAST(p_partkey AS VARCHAR)
                     WHEN 'SMALL' THEN 'NEW-' || p_brand
                     WHEN 'LARGE' THEN ''
                     ELSE 'X-' || CAST(p_partkey AS VARCHAR) END AS course_code,
         'Advanced ' || p_name AS course_name,
         CASE WHEN p_type = 'MEDIUM' THEN '' ELSE 'Mon 9:00' END AS schedule,
         CAST(CASE WHEN p_type = 'ECONOMY' THEN -p_size WHEN p_type = 'STANDARD' THEN 0
                   ELSE p_size END AS BIGINT) AS teacher_id
  FROM part),
chk AS (
  SELECT b.*,
         NOT ({ps('course_code')} AND {ps('course_name')}) AS missing,
         coalesce(course_code IN (SELECT course_code FROM courses WHERE course_code IS NOT NULL), false) AS taken,
         CASE WHEN teacher_id IS NOT NULL AND teacher_id <> 0 THEN teacher_id END AS tid
  FROM b),
chk2 AS (
  SELECT chk.*, tid IS NOT NULL AND tid NOT IN (SELECT teacher_id FROM teachers WHERE teacher_id IS NOT NULL)
           AS bad_teacher
  FROM chk),
firsts AS (SELECT course_code, min(seq) AS first_seq FROM chk2
           WHERE NOT missing AND NOT taken AND NOT bad_teacher GROUP BY course_code),
ann AS (
  SELECT chk2.*,
         CASE WHEN missing THEN 'Please provide course code and name'
              WHEN taken OR coalesce(chk2.seq > f.first_seq, false) THEN 'Course code already exists'
              WHEN bad_teacher THEN 'Teacher not found' END AS reason
  FROM chk2 LEFT JOIN firsts f ON f.course_code = chk2.course_code),
new AS (
  SELECT (SELECT coalesce(max(course_id), 0) FROM courses) + row_number() OVER (ORDER BY seq) AS course_id,
         course_code, course_name, nullif(schedule, '') AS schedule, tid AS teacher_id,
         CAST(NULL AS VARCHAR) AS description, CAST(NULL AS TIMESTAMP) AS updated_at
  FROM ann WHERE reason IS NULL)
"""
CHANGES["c04_create_courses"] = _run("SELECT * FROM courses UNION ALL SELECT * FROM new", C4)
CHANGES["c04_create_courses_created"] = _run("""
SELECT n.course_id AS id, n.course_code AS code, n.course_name AS name, n.schedule, n.teacher_id,
       t.name AS teacher_name, CAST(0 AS BIGINT) AS enrolled_students
FROM new n LEFT JOIN teachers t ON t.teacher_id = n.teacher_id
""", C4)
CHANGES["c04_create_courses_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C4)

# ------------------------------------------------------------- C5 update courses
C5 = f"""
b AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_type = 'MEDIUM' AND p_size > 45 THEN -p_partkey - 1 ELSE p_partkey END AS course_id,
         CASE p_type WHEN 'ECONOMY' THEN upper(p_name) WHEN 'PROMO' THEN '' END AS f_name,
         CASE p_type WHEN 'SMALL' THEN 'NEW-' || p_brand
                     WHEN 'STANDARD' THEN p_brand || '-' || CAST(p_partkey AS VARCHAR) END AS f_code,
         p_type = 'STANDARD' AS has_desc,
         CASE WHEN p_type = 'STANDARD' THEN p_name END AS f_desc,
         p_type IN ('MEDIUM', 'LARGE') AS has_teacher,
         CASE WHEN p_type = 'LARGE' THEN CAST(p_size + 95 AS BIGINT) END AS f_tid
  FROM part),
chk AS (
  SELECT b.*, nullif(f_name, '') AS new_name, nullif(f_code, '') AS new_code,
         b.course_id IN (SELECT course_id FROM courses) AS course_exists,
         EXISTS (SELECT 1 FROM courses c WHERE c.course_code = nullif(b.f_code, '')
                 AND c.course_id <> b.course_id) AS in_use,
         f_tid IS NOT NULL AND f_tid NOT IN (SELECT teacher_id FROM teachers WHERE teacher_id IS NOT NULL)
           AS bad_teacher
  FROM b),
chk2 AS (
  SELECT chk.*, NOT (new_name IS NOT NULL OR new_code IS NOT NULL OR has_desc OR has_teacher) AS nothing
  FROM chk),
claims AS (
  SELECT new_code, arg_min(course_id, seq) AS claim_course FROM chk2
  WHERE course_exists AND NOT in_use AND NOT bad_teacher AND NOT nothing AND new_code IS NOT NULL
  GROUP BY new_code),
ann AS (
  SELECT chk2.*,
         CASE WHEN NOT course_exists THEN 'Course not found'
              WHEN in_use OR coalesce(cl.claim_course <> chk2.course_id, false) THEN 'Course code already in use'
              WHEN bad_teacher THEN 'Teacher not found'
              WHEN nothing THEN 'No fields to update' END AS reason
  FROM chk2 LEFT JOIN claims cl ON cl.new_code = chk2.new_code),
upd AS (
  SELECT course_id,
         arg_max(new_name, seq) FILTER (WHERE new_name IS NOT NULL) AS u_name,
         arg_max(new_code, seq) FILTER (WHERE new_code IS NOT NULL) AS u_code,
         bool_or(has_desc) AS set_desc,
         arg_max(f_desc, seq) FILTER (WHERE has_desc) AS u_desc,
         bool_or(has_teacher) AS set_tid,
         arg_max(f_tid, seq) FILTER (WHERE has_teacher) AS u_tid
  FROM ann WHERE reason IS NULL GROUP BY course_id)
"""
CHANGES["c05_update_courses"] = _run(f"""
SELECT c.course_id, coalesce(u.u_code, c.course_code) AS course_code,
       coalesce(u.u_name, c.course_name) AS course_name, c.schedule,
       CASE WHEN coalesce(u.set_tid, false) THEN u.u_tid ELSE c.teacher_id END AS teacher_id,
       CASE WHEN coalesce(u.set_desc, false) THEN u.u_desc ELSE c.description END AS description,
       CASE WHEN u.course_id IS NOT NULL THEN {AS_OF_TS} ELSE c.updated_at END AS updated_at
FROM courses c LEFT JOIN upd u ON u.course_id = c.course_id
""", C5)
CHANGES["c05_update_courses_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C5)
CHANGES["c05_update_courses_updated"] = _run("""
SELECT c.course_id AS id, coalesce(u.u_name, c.course_name) AS name, coalesce(u.u_code, c.course_code) AS code,
       CASE WHEN coalesce(u.set_desc, false) THEN u.u_desc ELSE c.description END AS description,
       CASE WHEN coalesce(u.set_tid, false) THEN u.u_tid ELSE c.teacher_id END AS teacher_id
FROM courses c JOIN upd u ON u.course_id = c.course_id
""", C5)

# ------------------------------------------------------------- C6 delete courses
C6 = """
b AS (
  SELECT p_partkey * 2 AS seq,
         CASE WHEN p_type = 'PROMO' THEN p_partkey ELSE -p_partkey - 1 END AS course_id
  FROM part
  UNION ALL
  SELECT p_partkey * 2 + 1, p_partkey FROM part WHERE p_type = 'PROMO' AND p_size > 25),
firsts AS (SELECT course_id, min(seq) AS first_seq FROM b WHERE course_id IN (SELECT course_id FROM courses)
           GROUP BY course_id),
ann AS (
  SELECT b.seq, b.course_id,
         CASE WHEN f.first_seq IS NULL OR b.seq > f.first_seq THEN 'Course not found' END AS reason
  FROM b LEFT JOIN firsts f ON f.course_id = b.course_id),
doomed AS (SELECT DISTINCT course_id FROM ann WHERE reason IS NULL)
"""
CHANGES["c06_delete_courses"] = _run(
    "SELECT * FROM courses WHERE course_id NOT IN (SELECT course_id FROM doomed)", C6)
CHANGES["c06_delete_courses_grades"] = _run("""
SELECT * FROM grades
WHERE assignment_id IS NULL OR assignment_id NOT IN (
  SELECT assignment_id FROM assignments WHERE course_id IN (SELECT course_id FROM doomed)
  AND assignment_id IS NOT NULL)
""", C6)
CHANGES["c06_delete_courses_attendance"] = _run(
    "SELECT * FROM attendance WHERE course_id IS NULL OR course_id NOT IN (SELECT course_id FROM doomed)", C6)
CHANGES["c06_delete_courses_enrollments"] = _run(
    "SELECT * FROM enrollments WHERE course_id IS NULL OR course_id NOT IN (SELECT course_id FROM doomed)", C6)
CHANGES["c06_delete_courses_assignments"] = _run(
    "SELECT * FROM assignments WHERE course_id IS NULL OR course_id NOT IN (SELECT course_id FROM doomed)", C6)
CHANGES["c06_delete_courses_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C6)

# ------------------------------------------------------------- C7 update grades
C7 = GRADE_REQ + f""",
ann AS (
  SELECT gann.*,
         CASE WHEN NOT {ps('grade')} THEN 'Please provide a grade' ELSE access_reason END AS reason
  FROM gann),
latest AS (
  SELECT grade_id, arg_max(grade, seq) AS u_grade, arg_max(coalesce(nullif(feedback, ''), ''), seq) AS u_feedback
  FROM ann WHERE reason IS NULL GROUP BY grade_id)
"""
CHANGES["c07_update_grades"] = _run(f"""
SELECT g.grade_id, g.student_id, g.assignment_id,
       CASE WHEN l.grade_id IS NOT NULL THEN l.u_grade ELSE g.grade END AS grade,
       CASE WHEN l.grade_id IS NOT NULL THEN l.u_feedback ELSE g.feedback END AS feedback,
       g.submitted_at,
       CASE WHEN l.grade_id IS NOT NULL THEN {AS_OF_TS} ELSE g.graded_at END AS graded_at
FROM grades g LEFT JOIN latest l ON l.grade_id = g.grade_id
""", C7)
CHANGES["c07_update_grades_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C7)

# ------------------------------------------------------------- C8 take attendance
C8 = f"""
req AS (
  SELECT p_partkey AS seq, {tu('p_size', "p_type = 'STANDARD'")} AS teacher_user_id, p_partkey AS course_id,
         p_type <> 'SMALL' AS records_given
  FROM part),
rec AS (
  SELECT course_id AS seq, -student_id AS pos, student_id,
         CASE WHEN progress >= 0.09 THEN 'excused' WHEN enrollment_status = 'F' THEN 'present'
              ELSE 'absent' END AS status
  FROM enrollments),
tk AS (SELECT user_id, min(teacher_id) AS teacher_id FROM teachers GROUP BY user_id),
ann AS (
  SELECT r.seq, r.course_id,
         CASE WHEN NOT r.records_given THEN 'Please provide attendance records'
              WHEN tk.teacher_id IS NULL THEN 'Teacher not found'
              WHEN NOT coalesce(c.teacher_id = tk.teacher_id, false)
                THEN 'You do not have permission to take attendance for this course' END AS reason
  FROM req r LEFT JOIN tk ON tk.user_id = r.teacher_user_id
  LEFT JOIN courses c ON c.course_id = r.course_id)
"""
CHANGES["c08_take_attendance"] = _run(f"""
SELECT * FROM attendance
UNION ALL
SELECT (SELECT coalesce(max(attendance_id), 0) FROM attendance)
         + row_number() OVER (ORDER BY rec.seq, rec.pos, rec.student_id, rec.status),
       rec.student_id, a.course_id, {AS_OF_DATE}, rec.status
FROM rec JOIN ann a ON a.seq = rec.seq AND a.reason IS NULL
""", C8)
CHANGES["c08_take_attendance_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C8)

# ------------------------------------------------------------- C9 create assignments
C9 = f"""
b AS (
  SELECT p_partkey AS seq, {tu('p_size', "p_type = 'PROMO'")} AS teacher_user_id, p_partkey AS course_id,
         CASE WHEN p_type = 'SMALL' AND p_size < 10 THEN '' ELSE 'Project ' || p_name END AS title,
         CASE WHEN p_type = 'LARGE' THEN '' ELSE p_type END AS description,
         CASE WHEN p_type = 'MEDIUM' THEN NULL WHEN p_type = 'ECONOMY' THEN ''
              WHEN p_type = 'SMALL' THEN '31/12/2025' ELSE '2025-03-01' END AS due_date,
         CAST(CASE WHEN p_type = 'STANDARD' AND p_size > 40 THEN 0 ELSE p_size END AS DECIMAL(18,0))
           AS total_marks
  FROM part),
tk AS (SELECT user_id, min(teacher_id) AS teacher_id FROM teachers GROUP BY user_id),
ann AS (
  SELECT b.*,
         CASE WHEN NOT ({ps('title')} AND coalesce(total_marks <> 0, false))
                THEN 'Please provide title and total marks'
              WHEN tk.teacher_id IS NULL THEN 'Teacher not found'
              WHEN NOT coalesce(c.teacher_id = tk.teacher_id, false)
                THEN 'You do not have permission to create assignments for this course'
              WHEN b.due_date <> '' AND TRY_CAST(b.due_date AS DATE) IS NULL
                THEN 'Please provide a valid due date' END AS reason
  FROM b LEFT JOIN tk ON tk.user_id = b.teacher_user_id
  LEFT JOIN courses c ON c.course_id = b.course_id),
new AS (
  SELECT (SELECT coalesce(max(assignment_id), 0) FROM assignments) + row_number() OVER (ORDER BY seq)
           AS assignment_id,
         course_id, title, nullif(description, '') AS description,
         CASE WHEN {ps('due_date')} THEN TRY_CAST(due_date AS DATE) END AS due_date,
         total_marks, {AS_OF_TS} AS created_at
  FROM ann WHERE reason IS NULL)
"""
CHANGES["c09_create_assignments"] = _run("SELECT * FROM assignments UNION ALL SELECT * FROM new", C9)
CHANGES["c09_create_assignments_created"] = _run(
    "SELECT assignment_id AS id, title, description, due_date, total_marks FROM new", C9)
CHANGES["c09_create_assignments_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C9)

# ------------------------------------------------------------- C10 post notices
C10 = f"""
b AS (
  SELECT doc_id AS seq, (doc_id // 20) * 4 + 2 AS user_id,
         CASE WHEN lang = 'de' THEN '' ELSE 'Re: ' || source END AS title, text AS content
  FROM documents),
ann AS (
  SELECT b.*, CASE WHEN NOT ({ps('title')} AND {ps('content')}) THEN 'Please provide title and content' END
                AS reason
  FROM b)
"""
CHANGES["c10_post_notices"] = _run(f"""
SELECT * FROM notices
UNION ALL
SELECT (SELECT coalesce(max(notice_id), 0) FROM notices) + row_number() OVER (ORDER BY seq),
       title, content, user_id, {AS_OF_TS}
FROM ann WHERE reason IS NULL
""", C10)
CHANGES["c10_post_notices_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C10)
CHANGES["c10_post_notices_created"] = _run(f"""
SELECT (SELECT coalesce(max(notice_id), 0) FROM notices) + row_number() OVER (ORDER BY seq) AS id,
       title, content, {AS_OF_TS} AS created_at
FROM ann WHERE reason IS NULL
""", C10)

# ------------------------------------------------------------- C11 pay fees
C11 = """
b AS (
  SELECT o_orderkey * 2 AS seq,
         CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey * 4 + 5 WHEN '5-LOW' THEN o_custkey * 4
              ELSE o_custkey * 4 + 1 END AS user_id,
         o_orderkey AS fee_id
  FROM orders
  UNION ALL
  SELECT o_orderkey * 2 + 1, o_custkey * 4 + 1, o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'),
sk AS (SELECT user_id, min(student_id) AS student_id FROM students GROUP BY user_id),
chk AS (
  SELECT b.*, sk.student_id, f.student_id AS owner_id, f.payment_status AS status_before
  FROM b LEFT JOIN sk ON sk.user_id = b.user_id LEFT JOIN fees f ON f.fee_id = b.fee_id),
chk2 AS (
  SELECT chk.*, student_id IS NULL AS no_student,
         NOT coalesce(owner_id = student_id, false) AS not_theirs,
         coalesce(status_before = 'paid', false) AS paid_before
  FROM chk),
firsts AS (SELECT fee_id, min(seq) AS first_seq FROM chk2
           WHERE NOT no_student AND NOT not_theirs AND NOT paid_before GROUP BY fee_id),
ann AS (
  SELECT chk2.*,
         CASE WHEN no_student THEN 'Student not found'
              WHEN not_theirs THEN 'Fee not found or does not belong to student'
              WHEN paid_before OR coalesce(chk2.seq > f.first_seq, false) THEN 'Fee is already paid' END AS reason
  FROM chk2 LEFT JOIN firsts f ON f.fee_id = chk2.fee_id),
paid_now AS (SELECT DISTINCT fee_id FROM ann WHERE reason IS NULL)
"""
CHANGES["c11_pay_fees"] = _run(f"""
SELECT f.fee_id, f.student_id, f.amount,
       CASE WHEN p.fee_id IS NOT NULL THEN 'paid' ELSE f.payment_status END AS payment_status,
       CASE WHEN p.fee_id IS NOT NULL THEN {AS_OF_DATE} ELSE f.payment_date END AS payment_date
FROM fees f LEFT JOIN paid_now p ON p.fee_id = f.fee_id
""", C11)
CHANGES["c11_pay_fees_rejects"] = _run("SELECT seq, reason FROM ann WHERE reason IS NOT NULL", C11)

# Of a shared code's first askers the first gets it; if that is a LARGE course it leaves the
# code, and the first of the later askers gets it.
C5_ORDER = """
p AS (SELECT p_partkey AS id, p_type AS t, p_partkey // 10 AS pool FROM part),
early AS (SELECT pool, min(id) AS id, arg_min(t, id) AS t FROM p WHERE t IN ('SMALL', 'LARGE', 'ECONOMY') GROUP BY pool),
late AS (SELECT pool, min(id) AS id FROM p WHERE t IN ('PROMO', 'STANDARD')
         AND pool NOT IN (SELECT pool FROM early WHERE t <> 'LARGE') GROUP BY pool)
"""
CHANGES["c05_update_courses_in_order"] = _run(f"""
SELECT c.course_id, CASE WHEN p.t = 'LARGE' THEN 'FREE-' || CAST(p.id AS VARCHAR)
                         WHEN p.id IN (SELECT id FROM early) OR p.id IN (SELECT id FROM late) THEN 'POOL-' || CAST(p.pool AS VARCHAR)
                         ELSE c.course_code END AS course_code,
       c.course_name, c.schedule, c.teacher_id, c.description,
       CASE WHEN p.t = 'LARGE' OR p.id IN (SELECT id FROM early) OR p.id IN (SELECT id FROM late) THEN {AS_OF_TS} ELSE c.updated_at END AS updated_at
FROM courses c JOIN p ON p.id = c.course_id
""", C5_ORDER)
CHANGES["c05_update_courses_in_order_rejects"] = _run("""
SELECT id AS seq, 'Course code already in use' AS reason FROM p
WHERE t IN ('SMALL', 'LARGE', 'ECONOMY') AND id NOT IN (SELECT id FROM early)
UNION ALL
SELECT 2000000000000 + id, 'Course code already in use' FROM p WHERE t IN ('PROMO', 'STANDARD') AND id NOT IN (SELECT id FROM late)
""", C5_ORDER)

# Stored snapshots give the answers of the plain forms.
for _name in ("c02_update_users_students", "c05_update_courses", "c06_delete_courses_grades", "c06_delete_courses_enrollments",
              "c07_update_grades", "c07_update_grades_rejects", "c08_take_attendance", "c09_create_assignments", "c10_post_notices",
              "c11_pay_fees", "c11_pay_fees_rejects"):
    CHANGES[f"{_name}_stored"] = CHANGES[_name]

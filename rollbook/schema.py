"""Canonical table schemas and the fixed values the operators must reproduce."""

from __future__ import annotations

from pyspark.sql import types as T

L = T.LongType()
S = T.StringType()
D = T.DateType()
TS = T.TimestampNTZType()
DBL = T.DoubleType()
MARKS = T.DecimalType(18, 0)   # decimal bound without precision
MONEY = T.DecimalType(18, 2)   # money is summed in this type


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


USERS = _struct(("user_id", L), ("domain_id", S), ("role", S), ("created_at", TS))
STUDENTS = _struct(("student_id", L), ("user_id", L), ("name", S), ("roll_number", S),
                   ("email", S), ("phone_number", S), ("address", S))
TEACHERS = _struct(("teacher_id", L), ("user_id", L), ("name", S), ("email", S),
                   ("phone_number", S), ("department", S))
MANAGEMENT = _struct(("management_id", L), ("user_id", L), ("name", S), ("email", S),
                     ("phone_number", S))
COURSES = _struct(("course_id", L), ("course_code", S), ("course_name", S), ("schedule", S),
                  ("teacher_id", L), ("description", S), ("updated_at", TS))
ENROLLMENTS = _struct(("student_id", L), ("course_id", L), ("enrollment_status", S),
                      ("progress", DBL), ("created_at", TS))
ATTENDANCE = _struct(("attendance_id", L), ("student_id", L), ("course_id", L),
                     ("attendance_date", D), ("status", S))
ASSIGNMENTS = _struct(("assignment_id", L), ("course_id", L), ("title", S), ("description", S),
                      ("due_date", D), ("total_marks", MARKS), ("created_at", TS))
GRADES = _struct(("grade_id", S), ("student_id", L), ("assignment_id", L), ("grade", S),
                 ("feedback", S), ("submitted_at", TS), ("graded_at", TS))
NOTICES = _struct(("notice_id", L), ("title", S), ("content", S), ("posted_by_user_id", L),
                  ("created_at", TS))
FEES = _struct(("fee_id", L), ("student_id", L), ("amount", DBL), ("payment_status", S),
               ("payment_date", D))

TABLES: dict[str, T.StructType] = {
    "users": USERS, "students": STUDENTS, "teachers": TEACHERS, "management": MANAGEMENT,
    "courses": COURSES, "enrollments": ENROLLMENTS, "attendance": ATTENDANCE,
    "assignments": ASSIGNMENTS, "grades": GRADES, "notices": NOTICES, "fees": FEES,
}

# Key column of each table (one row per key).
KEYS = {
    "users": "user_id", "students": "student_id", "teachers": "teacher_id",
    "management": "management_id", "courses": "course_id", "attendance": "attendance_id",
    "assignments": "assignment_id", "grades": "grade_id", "notices": "notice_id", "fees": "fee_id",
}

REJECTS = _struct(("seq", L), ("reason", S))

# --- Fixed values: these must equal the application's strings exactly. ---
ROLE_STUDENT = "student"
ROLE_TEACHER = "teacher"
ROLE_MANAGEMENT = "management"

ATTENDANCE_PRESENT = "present"
ATTENDANCE_ABSENT = "absent"
ATTENDANCE_EXCUSED = "excused"

FEE_PAID = "paid"
FEE_PENDING = "pending"
FEE_UNPAID = "unpaid"

MSG_USER_FIELDS = "Please provide domain_id, password, role, name, and email"
MSG_REGISTER_FIELDS = "Please provide domain_id, password, name, and email"
MSG_USER_EXISTS = "User already exists"
MSG_ROLL_REQUIRED = "Roll number is required for students"
MSG_USER_NOT_FOUND = "User not found"
MSG_PROFILE_NOT_FOUND = "{role} profile not found"
MSG_COURSE_FIELDS = "Please provide course code and name"
MSG_COURSE_CODE_EXISTS = "Course code already exists"
MSG_TEACHER_NOT_FOUND = "Teacher not found"
MSG_COURSE_NOT_FOUND = "Course not found"
MSG_COURSE_CODE_IN_USE = "Course code already in use"
MSG_NO_FIELDS = "No fields to update"
MSG_GRADE_REQUIRED = "Please provide a grade"
MSG_GRADE_PERMISSION = "You do not have permission to update this grade"
MSG_RECORDS_REQUIRED = "Please provide attendance records"
MSG_ACCESS_COURSE = "You do not have permission to access this course"
MSG_ATTENDANCE_PERMISSION = "You do not have permission to take attendance for this course"
MSG_ASSIGNMENT_PERMISSION = "You do not have permission to create assignments for this course"
MSG_ASSIGNMENT_FIELDS = "Please provide title and total marks"
MSG_ASSIGNMENT_DATE = "Please provide a valid due date"  # our own: the application leaves the date to the database
MSG_NOTICE_FIELDS = "Please provide title and content"
MSG_STUDENT_NOT_FOUND = "Student not found"
MSG_FEE_NOT_FOUND = "Fee not found or does not belong to student"
MSG_FEE_ALREADY_PAID = "Fee is already paid"

# Display defaults of the dashboards.
SHOW_NO_PROGRESS = "0%"
SHOW_NOT_GRADED = "Not graded"
SHOW_NO_FEEDBACK = "-"
SHOW_NO_TEACHER = "Not assigned"
# --- end of fixed values ---

# Our own constants for routes that are declared without a body.
ENROLLMENT_ACTIVE = "active"
MSG_ENROLL_STUDENT = "Student not found"
MSG_ENROLL_COURSE = "Course not found"
MSG_ENROLL_EXISTS = "Already enrolled"

# --- Refused request bodies (our wording). ---
MSG_BAD_JSON = "Request body is not JSON"
MSG_BAD_BODY = "Request body must be an object"
MSG_BAD_FIELDS = "Wrong type: "

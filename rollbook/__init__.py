"""rollbook: campus-records analytics as Spark DataFrame jobs.

Tables (users, students, teachers, management, courses, enrollments,
attendance, assignments, grades, notices, fees) are Parquet-backed
DataFrames with explicit schemas.  Read operators answer set-based
questions for every entity at once; change operators apply a batch of
requests to a table snapshot and return the new snapshot plus a table of
rejected requests with their reasons.
"""

from rollbook.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

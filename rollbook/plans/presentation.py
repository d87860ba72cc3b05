"""Presentation order (applied at the edge, never inside an operator).

The application sorts some answers; operators return unsorted frames and
``present`` adds the order, with the row key as tie-break so the order is
total.  Spark's NULL placement (first ascending, last descending) equals
the database's.  ``orderBy`` is a distributed range sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The application's ORDER BY of each answer, then our tie-break.
SORT_SPECS: dict[str, list[tuple[str, str]]] = {
    "user_directory": [("created_at", "desc"), ("id", "asc")],
    "student_grades": [("submitted_at", "desc"), ("id", "asc")],
    "student_attendance": [("date", "desc"), ("id", "asc")],
    "notice_board": [("created_at", "desc"), ("id", "asc")],
    "fee_detail": [("payment_date", "desc"), ("id", "asc")],
    "course_roster": [("name", "asc"), ("course_id", "asc"), ("id", "asc")],
    "course_catalog": [("code", "asc"), ("id", "asc")],
}


def present(df: DataFrame, operator: str) -> DataFrame:
    spec = SORT_SPECS.get(operator)
    if not spec:
        return df
    cols = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in spec]
    return df.orderBy(*cols)

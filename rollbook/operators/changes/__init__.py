"""Change batches: a DataFrame of requests (with a unique ``seq``) applied to
table snapshots, giving new tables plus ``rejects(seq, reason)``.

Requests are checked in the application's order (the first failing check
gives the reason); uniqueness claims go to the first request that would
succeed; updates take the highest ``seq`` per field.  Nothing is written in
place: callers persist the returned tables with ``write_snapshot``; the
``stored_*`` forms write new versions of partitioned snapshots, of which they
read and write only the partitions that a batch touches.
"""

from rollbook.operators.changes.courses import create_courses, delete_courses, update_courses, update_courses_in_order  # noqa: F401
from rollbook.operators.changes.fees import pay_fees  # noqa: F401
from rollbook.operators.changes.teaching import (  # noqa: F401
    create_assignments, nested_attendance, post_notices, take_attendance, update_grades,
)
from rollbook.operators.changes.users import create_users, delete_users, update_users  # noqa: F401
from rollbook.operators.changes.stored import (  # noqa: F401
    stored_create_assignments, stored_delete_courses, stored_pay_fees, stored_post_notices, stored_take_attendance,
    stored_update_courses, stored_update_grades, stored_update_users,
)

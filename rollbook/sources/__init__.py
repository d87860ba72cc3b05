"""Sources and sinks: Parquet table scans, snapshot writes, JSON change requests,
result emission, and the role mapping from the driver's tables."""

from rollbook.sources.io import (  # noqa: F401
    conform, explode_records, read_changes, read_requests, read_table, write_bucketed, write_result, write_snapshot,
)
from rollbook.sources.snapshots import Snapshot, create_snapshot, open_snapshot  # noqa: F401
from rollbook.sources.campus import Campus, load_driver, load_snapshots  # noqa: F401

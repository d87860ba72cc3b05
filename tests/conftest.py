import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rollbook.session import get_session
    s = get_session("local[4]", shuffle_partitions=8, app_name="rollbook-tests")
    yield s
    s.stop()


def table(spark, name, rows):
    """A canonical table from dicts (missing columns are NULL)."""
    from rollbook.schema import TABLES
    schema = TABLES[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def frame(spark, schema: str, rows):
    return spark.createDataFrame(rows, schema)


def as_dicts(df, key=None):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=(lambda r: r[key]) if key else (lambda r: str(sorted(r.items()))))

"""Every registered query against its DuckDB oracle on sf0.001."""

import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from rollbook import registry
from oracle_check import compare


@pytest.fixture(scope="module")
def report(spark):
    return compare(spark, SF_SMALL, sorted(registry.queries()), verbose=False)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_oracle(report, name):
    info = report[name]
    assert info["status"] == "match", info


def test_every_query_has_an_oracle():
    assert set(registry.queries()) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "code", "name", "schedule", "teacher_id", "teacher_name", "enrolled_students"]

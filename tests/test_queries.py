"""Every registered query of the engine against its SQL, and the fixtures that SQL cannot express."""

import compare
import pytest

from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert compare.spark_rows(registry.queries()[name](spark, SF)) == compare.duck_rows(registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    """What has no SQL: run to the end, twice with one result, and hold to what must be true of its rows."""
    names, rows = compare.spark_rows(registry.queries()[name](spark, SF))
    assert rows and (names, rows) == compare.spark_rows(registry.queries()[name](spark, SF))
    assert all(len(r) == len(names) and any(v is not None for v in r) for r in rows)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0

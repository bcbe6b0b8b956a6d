import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import of_duckdb, of_spark

from palimpsest.plans.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, data, name):
    assert of_spark(QUERIES[name](spark, data)) == of_duckdb(ORACLE[name], data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_gives_rows(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

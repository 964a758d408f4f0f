"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from tests.compare import compare, views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
CON = views(FOLDER) if os.path.isdir(FOLDER) else None
TWINS = sorted(n for n in entry.oracle_sql() if not re.match(r"p\d+_", n))


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, name):
    n, m, differing, sample, types = compare(entry.queries()[name](spark, FOLDER), CON, entry.oracle_sql()[name])
    assert differing == 0, (name, n, m, sample, types)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rows_only_queries_run(spark):
    for name, plan in entry.queries().items():
        if name not in entry.oracle_sql() and not re.match(r"p\d+_", name):
            assert plan(spark, FOLDER).count() >= 0, name

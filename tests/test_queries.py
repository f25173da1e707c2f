"""Every registered query against its checking SQL on the smallest tables."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from harness import compare, database

# the queries of the optional part have their own tests
own = lambda found: {n: x for n, x in found.items() if not re.match(r"op\d+_|pipeline$", n)}
QUERIES, CHECKS = own(queries()), own(oracle_sql())


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, small, name):
    problem, rows, _ = compare(spark, con, name, QUERIES[name], CHECKS.get(name), small)
    assert problem is None, problem
    assert rows >= 0


def test_entry_has_rows(spark, small):
    assert entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)

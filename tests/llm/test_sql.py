"""Queries that SQL can express against their SQL on the smallest tables, and the rows of the others."""

import pytest

from attesta.llm import catalog
from harness import compare, database

CHECKS = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_its_sql(spark, small, name):
    problem, rows, _ = compare(spark, database(small), name, catalog.queries()[name], CHECKS[name], small)
    assert problem is None, problem
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(CHECKS)))
def test_query_has_a_row_for_every_document(spark, small, name):
    rows = catalog.queries()[name](spark, small)
    if "piece" in rows.columns:
        rows = rows.where("piece = 0")
    assert rows.count() == spark.read.parquet(f"{small}/documents.parquet").count()

"""Every registered query gives the rows its SQL states."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from weftline.queries import catalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_every_query_of_the_catalogue_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[0] == "segment"
    assert result.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

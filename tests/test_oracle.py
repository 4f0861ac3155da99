"""Every registered query against its SQL, whole results."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point
from odflow_checks.catalog import QUERIES
from odflow_checks.compare import connect, difference
from odflow_checks.oracle import SQL as ORACLE

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLE) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert difference(df, con, ORACLE[name]) is None

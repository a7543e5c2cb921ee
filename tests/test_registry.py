"""Every query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from litscore import registry
from tests.check import connect, differences

SF_DIR = os.environ.get("LITSCORE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query beside its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, oracle_connection  # noqa: E402

from millrace.plans import all_queries  # noqa: E402


@pytest.fixture(scope="module")
def connection(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, connection, small, name):
    status, detail = compare(spark, connection, name, small)
    assert status == "ok", detail

"""Every registered query against its SQL on the smallest data."""

import re

import pytest

from oracle import compare, connect
from pictorium.checks import ENTRIES


@pytest.fixture(scope="session")
def duck(data):
    return connect(data)


def test_entry_functions(spark):
    import __spark_entry__ as entry

    more = {n for n in entry.queries() if re.match(r"op\d", n) or n == "pipeline"}
    assert set(entry.queries()) == set(ENTRIES) | more
    assert not set(ENTRIES) & more
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query_equals_sql(spark, duck, data, name):
    problem, *_ = compare(spark, duck, data, ENTRIES[name].run, ENTRIES[name].sql)
    assert not problem

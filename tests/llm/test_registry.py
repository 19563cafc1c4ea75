"""Every dealt operator has its query, and those with SQL match it."""

import re

import pytest

from cohortframe.llm import queries
from compare import compare, connect


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, folder, name):
    assert compare(spark, connect(folder), queries.queries()[name], queries.oracle_sql()[name], folder) is None

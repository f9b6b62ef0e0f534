"""Every registered query with expected SQL gives the same rows."""

from __future__ import annotations

import pytest
from compare import database, differences
from conftest import SMALL

from smudgelab.expected import EXPECTED
from smudgelab.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


def test_expected_names_are_registered():
    assert set(EXPECTED) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), EXPECTED[name], con) is None

"""Every registered query against its check SQL, on the smallest data."""

import pytest

import compare
from consentry.queries import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    good, note, _ = compare.check_one(spark, con, name, SMALL)
    assert good, note


def test_checks_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)

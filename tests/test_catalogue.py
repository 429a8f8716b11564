"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
import check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, connection, name):
    assert check.compare(spark, connection, name, FOLDER) == ""


def test_entry(spark):
    flagship = contract.entry(spark)
    assert flagship.columns[:3] == ["column_id", "label", "role"] and flagship.count() == 6


def test_every_expected_result_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

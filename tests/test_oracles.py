"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry
from loadcast.catalog.registry import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not available")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    result = compare(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["location", "scenario", "time"]
    assert df.limit(1).count() == 1

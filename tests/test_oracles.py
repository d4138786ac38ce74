"""Every registered query against its oracle, over the smallest tables."""

import pytest

from quillspan import catalogue
from tests.oracle import assert_equal, connection

SF = "/root/testdata/sf0.001"
DUCK = connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    assert_equal(catalogue.QUERIES[name](spark, SF), DUCK, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).columns
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

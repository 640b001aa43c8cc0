"""Every query with SQL gives the rows of its SQL."""

from pathlib import Path

import pytest

from lodegraph import registry
from tests import oracle

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.compare(df, ORACLES[name], con) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

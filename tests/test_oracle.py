"""Every registered query against its DuckDB oracle at sf0.01; a query without one fails."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from sensorlake.oracle_queries import SQL
from sensorlake.queries import QUERIES as QS



@pytest.fixture(scope="module")
def con(sf001):
    return duck(sf001)


@pytest.mark.parametrize("key", sorted(QS))
def test_query_matches_oracle(spark, sf001, con, key):
    sp = QS[key](spark, sf001).toPandas()
    od = con.execute(SQL[key]).df()
    ok, msg = compare(sp, od)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["channel", "ts", "value", "family", "unit"]

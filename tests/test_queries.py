"""Every registered query of the linear-algebra part against its SQL in DuckDB, at the smallest scale."""

import pytest
from compare import connect, differs

from rowloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert differs(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_size_estimate_is_near_the_count(spark):
    row = QUERIES["estimate_size"](spark, SF).first()
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert abs(row.estimated - n) < 0.2 * n

"""Every registered query of the engine against DuckDB on the smallest tables; those without SQL must run."""

import pytest
from oracle import difference

from brindle.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, name, SMALL, catalog.QUERIES, catalog.ORACLES) == ""


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["chunk_filters"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan and "text" not in plan.split("ReadSchema")[1]

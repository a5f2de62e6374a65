"""Every registered query against its SQL; those without SQL must run with a stable schema."""

import pytest
from parity import compare

from silvaflow.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0
    assert df.schema == QUERIES[name](spark, FOLDER).schema


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["quality_filter_static", "spectral_indices", "biomass_cube", "max_composite", "ols_trend", "pct_composite", "zonal_stats", "analytic_uncertainty", "mc_zonal", "mc_change"])
def test_stays_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_pushdown_reaches_the_scan(spark):
    plan = QUERIES["job_left_join"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,200000.0)" in plan
    assert "o_orderpriority" not in plan

"""Every query against its SQL; plans that should push down do."""

import pytest
from conftest import SF, same_rows

from stripelore.plans.orc import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_project_reads_two_columns(spark):
    plan = QUERIES["project"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in plan


def test_aggregates_from_footers(spark):
    """With the second version of the source and push-down on, counts and bounds come from the footers."""
    spark.conf.set("spark.sql.orc.aggregatePushdown", "true")
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    try:
        plan = QUERIES["agg_pushdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.orc.aggregatePushdown")
        spark.conf.unset("spark.sql.sources.useV1SourceList")
    assert "PushedAggregation: [COUNT(*), MIN(l_orderkey), MAX(l_orderkey)]" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries())

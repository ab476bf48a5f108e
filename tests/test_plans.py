"""Plan-shape checks: the scale rules hold in the physical plans."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Text operators are an optional part with tests of their own.
CORE = sorted(k for k in E.queries() if k not in E.LLM_QUERIES)


@pytest.mark.parametrize("name", CORE)
def test_no_python_udf_no_cross_join(spark, name):
    plan = physical(E.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
                "FlatMapGroupsInPandas"):
        assert bad not in plan, f"{name}: {bad}"


def test_demand_scan_prunes_and_pushes(spark):
    from headroom.sources.driver import DriverCatalog
    from headroom.operators.projection import demand_by_period
    df = demand_by_period(DriverCatalog(spark, SF, materialize=False).production_demand)
    plan = physical(df)
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    # only the four needed columns of lineitem are read
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    formatted = df._jdf.queryExecution().explainString(mode)
    lineitem_schema = [m for m in re.findall(r"ReadSchema: struct<([^>]*)>", formatted) if "l_suppkey" in m][0]
    assert sorted(c.split(":")[0] for c in lineitem_schema.split(",")) == \
        ["l_partkey", "l_quantity", "l_shipdate", "l_suppkey"]
    # partial aggregation happens before the shuffle on (site, period)
    assert re.search(r"partial_sum", formatted)


def test_materialized_scorecard_reads_each_fact_table_once_per_pipeline(spark):
    df = E.queries()["kpi_scorecard"](spark, SF)
    plan = physical(df)
    scans = re.findall(r"FileScan parquet \[[^\]]*\][^\n]*?lineitem\.parquet", plan)
    assert len(scans) <= 1                           # only the demand pipeline, read once
    assert "headroom-tables" in plan                 # reused aggregates were written once

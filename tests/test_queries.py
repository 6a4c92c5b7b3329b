"""Every query against its oracle, and the plans of some of them."""

import os

import pytest

import __spark_entry__ as driver
from compare import connect, differences
from issueloom.operators.filters import open_only, updated_since
from issueloom.plans import tables
from issueloom.plans.oracles import ORACLES
from issueloom.plans.queries import QUERIES, SINCE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "issues")
    tables.issues(spark, SF).write.parquet(path)
    landed = spark.read.schema(tables.issues(spark, SF).schema).parquet(path)
    plan = plan_of(open_only(updated_since(landed, SINCE)).select("number"))
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "EqualTo(state,open)" in pushed and "GreaterThanOrEqual(updated_at" in pushed
    assert "ReadSchema: struct<number:bigint,state:string,updated_at:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle_and_joins_by_keys(spark, con, name):
    result = QUERIES[name](spark, SF)
    plan = plan_of(result)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert differences(result, con, ORACLES[name]) == []


def test_small_limits_are_top_n(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_by_score"](spark, SF))

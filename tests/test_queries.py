"""Every catalogue query against its SQL, and that none without SQL is empty."""

import pytest

from cataloom import plans
from compare import in_duckdb, rows_of

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_as_by_sql(spark, name):
    df = plans.QUERIES[name](spark, AT)
    found = df.collect()
    if name not in plans.SQL:
        assert found
        return
    names, expected = in_duckdb(plans.SQL[name], AT)
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert rows_of(found, range(len(names))) == rows_of(expected, order)


def test_scan_is_pruned_and_pushed(spark):
    plan = plans.QUERIES["status_counts"](spark, AT)._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.split("ReadSchema:")[1:] if "p_name" in x.split(">")[0]]
    assert not scan, "columns that the query doesn't need are read"
    plan = plans.QUERIES["retry_or_fail"](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan


def test_flagship_stays_in_the_jvm(spark):
    plan = plans.QUERIES["score_filter_topk"](spark, AT)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "TakeOrderedAndProject" in plan

"""Plan shape of headline queries: what a 100 TB run relies on."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def Q():
    import __spark_entry__ as E
    if not os.path.isdir(SF):
        pytest.skip("driver test data not present")
    return E.queries()


@pytest.mark.parametrize("name", ["sanitize_strict", "flag_records", "project_to_schema", "invalid_cells",
                                  "lookup_city_by_postcode", "match_payer_fuzzy", "format_date", "apply_invalid_decisions"])
def test_no_single_partition_and_no_python(spark, Q, name):
    plan = _plan(Q[name](spark, SF))
    assert "SinglePartition" not in plan, name
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
    assert "Window" not in plan, name


def test_scan_is_pruned(spark, Q):
    df = Q["sanitize_strict"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_dimension_joins_broadcast(spark, Q):
    plan = _plan(Q["project_to_schema"](spark, SF))
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan


def test_rules_stay_in_codegen(spark, Q):
    plan = _plan(Q["flag_records"](spark, SF))
    assert "WholeStageCodegen" in plan or "*(" in plan

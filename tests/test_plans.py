"""Shapes of physical plans: pruned and filtered scans, no joins of all pairs, no row-at-a-time Python."""

from __future__ import annotations

import re

import pytest

from winnow.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries that run nothing before their result is asked for.
LAZY = [n for n in catalog.queries() if re.match(r"(a|b|c|e|g2|g3|h|i|l|q|r|m1|m3|m4|o|f|n2|n3|n8|d1_|d2|d3|d4|d6|d7|d8)", n)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_joins_of_all_pairs(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SF)).split("== Physical Plan ==")[1]
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(catalog.queries()["c23_pending_users"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plan
    plan = plan_of(catalog.queries()["n8_fade_transitions"](spark, SF))
    assert "PushedFilters: [IsNotNull(user_id)]" in plan and "props" not in plan.split("== Physical Plan ==")[1]

"""The operators that run on columns only: no Python in their plans, and no products."""

import os
import re

import pytest

from laborlake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no given tables")


@pytest.mark.parametrize("name", ["op1_mixing", "op5_pii", "op6_quality_rules"])
def test_native_plans(spark, name):
    plan = QUERIES[name][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups|MapInArrow", plan)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan

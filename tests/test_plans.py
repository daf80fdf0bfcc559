"""Physical plans of registered queries: no cross products and no Python in the hot path."""

import pytest

from workload import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith("stream_")))
def test_plan(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "Python" not in plan and "Arrow" not in plan
    if "NestedLoop" in plan:
        # only the five-row stage list of the fixture
        assert "stage" in plan and name in STAGE_QUERIES


STAGE_QUERIES = {"audit_rollup", "audit_summary", "stage_pass_rates", "audit_badge", "build_failure", "fraud_patterns"}

"""A small table in one file becomes pages on all cores, not in the few tasks that read it."""

import pytest

from pagemill.plans import q_flows, q_pages
from pagemill.plans.registry import Tables


@pytest.mark.parametrize(
    "pages", [
        lambda t: q_pages.part_pages(t),
        lambda t: q_flows.profile_pages(t),
        lambda t: q_flows.article_pages(t),
        lambda t: q_flows.publication_inputs(t)[0],
    ],
)
def test_pages_are_dealt_out(spark, sf, pages):
    plan = pages(Tables(spark, sf))._jdf.queryExecution().executedPlan().toString()
    # The text is made after the rows were dealt out.
    assert plan.index("concat(") < plan.index("RoundRobinPartitioning")

"""The composed analysis of a network."""

from plumbline.queries.graph import V, analysed


def test_parts_are_made_once(spark):
    """The report puts single rows together; the joins of accounts and ties that they came from are not in its plan again."""
    out = analysed(*V.network(spark, "/root/testdata/sf0.001"), 3600, None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Join Inner") <= 6
    assert out.count() == 1

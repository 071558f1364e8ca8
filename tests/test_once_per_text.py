"""Work on texts that come again, which a query's rows must not do anew."""

from test_registry import SF

from plumbline.plans import registry


def test_queries_of_parts_are_made_once(spark):
    plan = registry.queries()["u106_search_queries"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "intitle" not in plan

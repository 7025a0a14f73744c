"""What registered queries don't do at any size: gather all rows in one, or search twice."""

import pytest

from cuepoint.operators import search
from cuepoint.plans import ask, roster


@pytest.mark.parametrize("name", ["evaluate_report", "summary_lines"])
def test_means_gather_no_rows(spark, sf, name):
    """The numbers of a report need no row that holds all queries."""
    found = roster.queries()[name](spark, sf)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_means_are_those_of_the_report(spark, sf):
    rows = roster._evaluated(spark, sf)
    whole = ask.report(rows, 5).first()
    assert ask.means(rows, 5).first().asDict() == {k: v for k, v in whole.asDict().items() if k != "query_results"}
    assert whole.num_queries == len(whole.query_results) > 0
    assert ask.means(rows.filter("false"), 5).count() == 0


def test_a_response_is_of_one_search(spark, sf, monkeypatch):
    """Each index is searched once for both the candidates and the results."""
    searched, whole = [], search.candidates
    monkeypatch.setattr(search, "candidates", lambda *a, **b: searched.append(1) or whole(*a, **b))
    roster.search_response(spark, sf).collect()
    assert len(searched) == 2


@pytest.mark.parametrize("name", ["answer_fallback", "ask_video", "answer_view", "dynamic_k_fallback", "dynamic_k_threshold", "range_search", "prompt_images", "shown_images"])
def test_searches_bring_nothing_to_the_driver(spark, sf, monkeypatch, name):
    """With more queries than are sent to all tasks, no rows come to the driver while the query is planned and none are sent from it to all."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    brought, kind = [], type(spark.range(0))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: brought.append(len(rows := collect(self))) or rows)
    for other in ("toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(kind, other, lambda self, *a, **b: pytest.fail("rows come to the driver"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = roster.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in plan
    assert sum(brought) <= 2  # how many queries there are, once for each index

"""Plans: what reaches the scan and how rows are joined and pruned."""

import pytest

from storyloom.plans.catalog import load

QUERIES, _ = load()
def plan(spark, folder, key):
    return QUERIES[key](spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = QUERIES["latest_summary"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,assistant)" in text
    tags = plan(spark, folder, "story_tags")
    assert "text:string" not in tags  # the wide column is never read


@pytest.mark.parametrize("key", ["list_cap", "latest_k_summaries", "search_many"])
def test_top_k_prunes_before_the_shuffle(spark, folder, key):
    assert "WindowGroupLimit" in plan(spark, folder, key)


@pytest.mark.parametrize("key", ["updates_tail"])
def test_page_is_a_top_k(spark, folder, key):
    assert "TakeOrderedAndProject" in plan(spark, folder, key)


@pytest.mark.parametrize("key", ["feed_has_summary", "feed_tags"])
def test_exists_is_a_semi_join(spark, folder, key):
    from storyloom.operators.feed import FeedQuery, Store, filtered
    from storyloom.sources.entities import Entities

    q = FeedQuery(tags=["src1"]) if key == "feed_tags" else FeedQuery()
    text = filtered(Store.of(Entities(spark, folder)), q)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text

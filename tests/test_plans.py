"""Plans, not results: joins by equality, and Python only where it is meant."""

import pytest

import __spark_entry__ as entry

QUERIES = {name: f for m in entry.CORE for name, f in m.QUERIES.items()}
SCANNERS = {"sentence_split", "xhtml", "epub_archives"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan or "InPandas" in plan) == (name in SCANNERS)


def test_the_log_is_read_once_for_details(spark, data):
    plan = QUERIES["stage_detailed_stats"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "metric.parquet" not in plan  # it was read, and copies told apart, before


@pytest.mark.parametrize("name", ["chapter_pages_range_join", "merge_pages", "excluded_range_anti", "gap_neighbourhood", "chapter_texts", "heading_pages"])
def test_pages_and_ranges_meet_by_blocks(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert any("_block" in line and "Join" in line for line in plan.split("\n"))

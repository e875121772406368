"""Rows that take milliseconds each are dealt over all cores, whatever the bytes of their table."""

import pytest

from tallyshelf.plans import registry
from tallyshelf.sources import tables


@pytest.mark.parametrize("name", ["reply_texts", "tag_texts", "detail_flatten", "next_cursors", "ingredient_sanitised"])
def test_parts_that_become_payloads_take_many_tasks(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).rdd.getNumPartitions() >= tables.LEAST_TASKS


@pytest.mark.parametrize("name", ["dedupe_first_wins", "last_wins", "merge_wide"])
def test_names_join_the_rows_that_are_left(spark, sf, name):
    lines = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(lines) if "min_by" in x or "max_by" in x)
    below = lines[at + 1 : next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))]
    below = [x for x in below if "Relation" not in x]  # which lists all columns of its file
    assert any("l_orderkey" in x for x in below) and not any("s_name" in x or "p_name" in x for x in below)


def test_cursor_steps_shuffle_parts_once_and_no_payload(spark, sf):
    plan = registry.QUERIES["cursor_steps"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan

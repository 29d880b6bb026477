"""Physical-plan properties the design relies on (checked on sf0.001 plans)."""

import re

import pytest

from conftest import SF_SMALL
from __spark_entry__ import queries

NAMES = sorted(queries())


PLANS = {}


def _plan(spark, name):
    """The plan of a query, which is built once: many store tables on the way."""
    if name not in PLANS:
        PLANS[name] = queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    return PLANS[name]


@pytest.mark.parametrize("name", NAMES)
def test_no_row_at_a_time_python(spark, name):
    assert "BatchEvalPython" not in _plan(spark, name)


@pytest.mark.parametrize("name", ["topic_words", "representative_docs", "sample_by_polarity", "valid_page_prefix"])
def test_top_k_is_group_limited(spark, name):
    # a partial limit before the shuffle plus a final one; when the input is
    # already partitioned by the group (no shuffle), only the final one
    plan = _plan(spark, name)
    assert "WindowGroupLimit" in plan
    if re.search(r"WindowGroupLimit[^\n]*Partial", plan) is None:
        assert "Final" in plan


def test_penalties_do_not_read_text(spark):
    # metrics read the events alone: no document is joined, let alone its text
    for name in ("penalties", "polarity_counts", "aspect_radar", "playtime_sentiment", "monthly_counts"):
        text = queries()[name](spark, SF_SMALL)._jdf.queryExecution().toString()
        scans = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
        assert any("user_id" in m for m in scans) and not any("doc_id" in m or "text" in m for m in scans)


def test_topic_words_shuffle_no_text(spark):
    """Between the texts' scan and the first exchange, words are already counted."""
    plan = queries()["topic_keywords"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for exchange in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        assert "content" not in exchange and "text" not in exchange


def test_every_part_is_an_app(spark):
    parts = spark.read.parquet(f"{SF_SMALL}/part.parquet").count()
    for name in ("normalise_app_info", "is_paid", "recommend_score"):
        assert queries()[name](spark, SF_SMALL).count() == parts


def test_metrics_are_one_aggregation(spark):
    plan = _plan(spark, "playtime_sentiment")
    # one shuffle for the aggregation (the review join itself may add its own)
    assert "SortMergeJoin" not in plan or "Exchange hashpartitioning(appid" in plan
    assert plan.count("HashAggregate") == 2  # partial + final


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

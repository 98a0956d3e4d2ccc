"""Plan guardrails: no cross products, partial top-k before shuffles,
pruned scans."""

import pytest

TOPK = ["summary_prompts", "sample_quotes", "capped_mentions", "top_themes", "capped_threads"]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as ent
    from tests.conftest import SF_SMALL

    return {k: plan_text(fn(spark, SF_SMALL)) for k, fn in ent.queries().items()}


def test_no_cross_products(plans):
    bad = {k for k, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad, bad


@pytest.mark.parametrize("name", TOPK)
def test_partial_topk_before_shuffle(plans, name):
    assert "WindowGroupLimit" in plans[name] and "Partial" in plans[name]


def test_scans_are_pruned(spark):
    import __spark_entry__ as ent
    from tests.conftest import SF_SMALL

    p = ent.queries()["source_counts"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # only the key column of documents is read for a count per company and platform
    assert "ReadSchema: struct<doc_id:bigint>" in p

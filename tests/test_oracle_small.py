"""Registered queries against their SQL oracles on the smallest tables."""

import pytest

from tools.compare import digest

KEYS = ["company_scorecard", "crisis_tags", "classified_mentions", "section_employee", "section_news", "top_themes",
        "sample_quotes", "dedup_fingerprint", "dedup_semantic", "capped_threads", "snapshot_age", "src_forum_comments",
        "html_elements", "normalize_company", "pipeline_funnel", "company_report"]


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as ent
    from tests.conftest import SF_SMALL

    sdf = ent.queries()[name](spark, SF_SMALL).toPandas()
    odf = duck.execute(ent.oracle_sql()[name]).df()
    sc, sn, sh, _ = digest(sdf)
    oc, on, oh, _ = digest(odf)
    assert sc == oc and sn == on and sh == oh


def test_entry_smoke(spark):
    import __spark_entry__ as ent

    df = ent.entry(spark)
    assert df.count() > 0
    assert "overall_score" in df.columns

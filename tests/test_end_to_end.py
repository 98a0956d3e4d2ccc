"""The whole run on hand-made mentions: every stage loses a row."""

import pytest
from pyspark.sql import functions as F

from renown.operators import caps as CP
from renown.plans import end_to_end as EE
from renown.sources.canonical import METADATA_TYPE, canonical

SCHEMA = ("company string, seq struct<platform_ord:int, position:long, item:int>, source_platform string, source_url string, raw_text string, "
          f"date_raw string, rating double, reviewer_type string, metadata {METADATA_TYPE.simpleString()}")


def row(company, ord_, position, platform, text, url="https://x.lk/a"):
    return (company, (ord_, position, 0), platform, url, text, None, None, "general", None)


def test_every_stage_loses_rows(spark):
    jobs = [row("Acme", 3, i, "topjobs", f"Acme job number {i} in town", "https://jobs.com") for i in range(40)]
    rows = [row("Acme", 0, 1, "reddit", "Acme is a fine place to work"), row("Acme", 0, 2, "reddit", "nothing of the kind here"),
            row("Acme", 0, 3, "reddit", "Acme abroad, far away", "https://x.com"), row("Acme", 7, 1, "web", "ACME  is a fine place to work"),
            row("Acme", 7, 2, "web", " acme "), *jobs, row("Beta", 0, 1, "reddit", "beta beta beta beta")]
    m = spark.createDataFrame(rows, SCHEMA)
    needles = spark.createDataFrame([("Acme", ["acme"]), ("Beta", ["beta"])], "company string, needles array<string>")
    # the response of position 1 exists for both companies: keys are (company, seq)
    responses = lambda kept: kept.select("company", "seq", F.lit('{"sentiment": "positive"}').alias("response"))
    staged = EE.staged_mentions(m, needles, ["zzz"])
    f = {r.company: r.asDict() for r in EE.run_funnel(staged, m).collect()}
    assert f["Acme"] == {"company": "Acme", "extracted": 45, "raw": 35, "irrelevant": 1, "non_geo": 1, "duplicates": 1, "too_short": 1, "analyzed": 31}
    assert f["Beta"]["analyzed"] == 1
    kept = staged.where("survivor")
    from renown.operators import classify as C
    c = C.classified_mentions(kept, responses(kept), ("company", "seq"))
    assert c.count() == 32 and c.where("sentiment = 'positive'").count() == 32


def test_canonical_rejects_unknown_fields(spark):
    df = spark.createDataFrame([("Acme", "text", "5K")], "company string, raw_text string, likes string")
    r = canonical(df, "facebook", F.lit(3), F.lit(1), "page_info", likes="likes").first()
    assert (r.seq.platform_ord, r.reviewer_type, r.metadata.likes, r.metadata.pros, r.source_url) == (5, "customer", "5K", None, "")
    with pytest.raises(ValueError):
        canonical(df, "facebook", F.lit(3), F.lit(1), "page_info", colour="likes")


def test_run_caps_leave_the_soft_ones_room():
    assert EE.RUN_CAPS["reddit"] > 30 and EE.RUN_CAPS["google_maps"] == 21 and CP.lx.PLATFORM_CAPS["web"] == EE.RUN_CAPS["web"]

"""The whole run as one plan: canonical mentions -> caps -> relevance and
geography -> duplicates -> classifier responses -> sections and report.

Every mention keeps stage flags instead of being filtered early, so the
funnel is one aggregate over the rows that also feed the report; the staged
table is written once (caps bound it per company) and read by both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions.text import fingerprint
from renown.operators import classify as C
from renown.operators import relevance as R
from renown.operators import report as RP
from renown.operators import summarize as SM
from renown.operators.caps import capped_mentions
from renown.plans.strategy import materialize

# the forum's own cap is soft (a taken post brings its comments) and the maps
# listing stands beside the capped reviews
RUN_CAPS = {**lx.PLATFORM_CAPS, "reddit": lx.FORUM_SOFT_CAP + lx.FORUM_COMMENTS_PER_POST, "google_maps": lx.PLATFORM_CAPS["google_maps"] + 1}


def staged_mentions(mentions: DataFrame, needles: DataFrame, alias_keys=None) -> DataFrame:
    """Capped canonical mentions with the flags relevant, geo_ok, validated,
    survivor (first of its fingerprint among the company's validated rows,
    over all platforms) and analyzable."""
    m = R.flag_stages(capped_mentions(mentions, RUN_CAPS).drop("cap_rank"), needles, alias_keys)
    m = materialize(m.withColumn("_fp", fingerprint("raw_text")).withColumn("analyzable", R.is_analyzable()))
    first = m.where("validated").groupBy("company", "_fp").agg(F.min("seq").alias("_first"))
    return (m.join(first, ["company", "_fp"], "left")
            .withColumn("survivor", F.col("validated") & (F.col("seq") == F.col("_first"))).drop("_fp", "_first"))


def run_funnel(staged: DataFrame, landed: DataFrame) -> DataFrame:
    """Per company: rows extracted, rows after the caps, and rows lost at each stage."""
    lost = staged.groupBy("company").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(~F.col("relevant")).alias("irrelevant"),
        F.count_if(F.col("relevant") & ~F.col("validated")).alias("non_geo"),
        F.count_if(F.col("validated") & ~F.col("survivor")).alias("duplicates"),
        F.count_if(F.col("survivor") & ~F.col("analyzable")).alias("too_short"),
        F.count_if(F.col("survivor") & F.col("analyzable")).alias("analyzed"))
    return landed.groupBy("company").agg(F.count(F.lit(1)).alias("extracted")).join(lost, "company")


def run_report(mentions: DataFrame, needles: DataFrame, responses, summaries: DataFrame | None, alias_keys=None,
               generated_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(funnel, report) of a run.  ``responses`` turns the surviving mentions
    into their classifier responses (company, seq, response), e.g. a join to a
    landed table; ``summaries``: parsed summary responses per company."""
    staged = staged_mentions(mentions, needles, alias_keys)
    kept = staged.where("survivor").drop("relevant", "geo_ok", "validated", "survivor", "analyzable")
    classified = materialize(C.classified_mentions(kept, responses(kept), ("company", "seq")))
    flags = SM.company_crisis_flags(classified, summaries)
    report = RP.company_report(classified, summaries, flags, model_used="external", generated_at=generated_at)
    return run_funnel(staged, mentions), report

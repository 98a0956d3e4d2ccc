"""Company score, score band and the nested per-company report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.operators import sections as S


def score_band(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 70, F.lit("Good")).when(s >= 40, F.lit("Mixed")).otherwise(F.lit("Poor"))


def rule_score(total: Column, pos: Column, neg: Column, crisis_rows: Column) -> Column:
    """int(pos/total*100) - 5 per row with crisis flags - 10 when more than
    half negative; clamped to 0..100; 50 when there are no rows."""
    base = ((pos / total) * 100.0).cast("int")
    s = base - crisis_rows * 5 - F.when((neg / total) > 0.5, F.lit(10)).otherwise(F.lit(0))
    return F.when(total == 0, F.lit(50)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), s))).cast("int")


# the longest text prefix any report consumer reads: quotes test len > 200
# and keep 200 chars, prompts keep 200, headlines 100
REPORT_TEXT_CHARS = 201


def report_input(classified: DataFrame) -> DataFrame:
    """Classified mentions reduced to what the report reads.  Tagging has
    already run on the whole texts; afterwards every report consumer looks
    at no more than the first 201 characters (quote length tests and quote
    text, headline defaults), so the text is cut to that length before the
    stage is written once and read by all aggregates."""
    return classified.withColumn("raw_text", F.substring(F.col("raw_text"), 1, REPORT_TEXT_CHARS))


def company_scorecard(classified: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Per company: totals, sentiment counts, rows with crisis flags, rule
    score, final score (summary score when present) and band."""
    d = S.with_defaults(classified)
    g = d.groupBy("company").agg(
        F.count(F.lit(1)).alias("total_results"),
        *S.sentiment_counts(),
        F.count_if(F.size(F.coalesce("crisis_flags", S.EMPTY_())) > 0).alias("crisis_rows"),
    )
    g = g.withColumn("rule_score", rule_score(F.col("total_results"), F.col("positive"), F.col("negative"), F.col("crisis_rows")))
    if summaries is not None:
        g = g.join(summaries.select("company", F.col("overall_score").alias("_ss")), "company", "left")
        g = g.withColumn("overall_score", F.coalesce("_ss", "rule_score")).drop("_ss")
    else:
        g = g.withColumn("overall_score", F.col("rule_score"))
    return g.withColumn("score_band", score_band("overall_score"))


def company_report(classified: DataFrame, summaries: DataFrame | None, flags: DataFrame | None = None,
                   model_used: str = "", generated_at: str | None = None) -> DataFrame:
    """One nested row per company: header, by_source struct of nullable
    per-platform sections, aggregated summary.  Sections are left-joined on
    company (each is already one row per company)."""
    card = company_scorecard(classified, summaries)
    out = card.join(S.sections_by_company(classified), "company", "left")
    fields = [lx.SECTION_KEYS[p] for p in lx.PLATFORMS]
    if summaries is not None:
        out = out.join(summaries.drop("crisis_flags", "overall_score", "summary_status"), "company", "left")
    else:
        for f in ["what_employees_say", "what_customers_say", "what_press_says", "recommendation",
                  "top_5_pros", "top_5_cons"]:
            out = out.withColumn(f, F.lit(None))
    if flags is not None:
        out = out.join(flags.select("company", F.col("crisis_flags").alias("_flags")), "company", "left")
    else:
        out = out.withColumn("_flags", F.lit(None).cast("array<string>"))
    dflt = lx.REPORT_SUMMARY_DEFAULTS
    summary = F.struct(
        *[F.coalesce(F.col(f).cast("string"), F.lit(dflt[f])).alias(f) for f in ("what_employees_say", "what_customers_say", "what_press_says")],
        F.coalesce(F.col("top_5_pros").cast("array<string>"), S.EMPTY_()).alias("top_5_pros"),
        F.coalesce(F.col("top_5_cons").cast("array<string>"), S.EMPTY_()).alias("top_5_cons"),
        F.coalesce("_flags", S.EMPTY_()).alias("crisis_flags"),
        F.coalesce(F.col("recommendation").cast("string"), F.lit(dflt["recommendation"])).alias("recommendation"),
    )
    gen = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return out.select(
        "company", gen.alias("generated_at"), F.lit(model_used).alias("model_used"),
        "overall_score", "score_band", "total_results",
        F.struct(*[F.col(f) for f in fields]).alias("by_source"),
        summary.alias("aggregated_summary"),
    )

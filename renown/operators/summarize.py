"""Summary prompts (first 100 mentions per company), summary parsing and the
company-level crisis-flag union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.operators.classify import with_parsed


def condensed_line(rank="rn") -> F.Column:
    return F.concat(
        F.lit("["), F.col(rank).cast("string"), F.lit("] Source: "), F.coalesce("source_platform", F.lit("unknown")),
        F.lit(" | Sentiment: "), F.coalesce("sentiment", F.lit("unknown")),
        F.lit(" | Type: "), F.coalesce("reviewer_type", F.lit("unknown")),
        F.lit(" | Themes: "), F.array_join(F.coalesce("themes", F.array().cast("array<string>")), ", "),
        F.lit(" | Text: "), F.substring(F.coalesce("raw_text", F.lit("")), 1, lx.SUMMARY_TEXT_CHARS),
    )


def summary_prompts(classified: DataFrame, n: int = lx.SUMMARY_ROWS) -> DataFrame:
    """Per company: the first ``n`` classified mentions by seq, numbered from
    1, folded into one prompt.  The literal row limit lets Spark insert a
    partial per-partition top-n before the shuffle, so a hot company sends
    at most ``n`` rows per input partition."""
    w = Window.partitionBy("company").orderBy("seq")
    top = classified.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    lines = top.select("company", "rn", condensed_line().alias("line"))
    g = lines.groupBy("company").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("_l"))
    return g.select(
        "company", "n_lines",
        F.concat(F.lit("Summarize these "), F.col("n_lines").cast("string"), F.lit(" classified reviews:\n\n"),
                 F.array_join(F.transform("_l", lambda e: e["line"]), "\n")).alias("prompt"))


SUMMARY_TEXT_FIELDS = ["what_employees_say", "what_customers_say", "what_press_says", "recommendation"]
SUMMARY_LIST_FIELDS = ["top_5_pros", "top_5_cons", "crisis_flags"]


def parse_summaries(responses: DataFrame, response_col: str = "response") -> DataFrame:
    """Typed summary fields.  A malformed text gives the parse-failure
    defaults; a valid non-object makes the summary step fail, which gives
    the 'failed' defaults.  Absent keys stay null (report defaults apply)."""
    responses = with_parsed(responses, response_col)
    v, status = F.col("_v"), F.col("_status")
    ok = status == "ok"
    bad = status.isin("malformed", "missing")
    g = lambda path, t: F.try_variant_get(v, f"$.{path}", t)
    cols = []
    for f in SUMMARY_TEXT_FIELDS:
        cols.append(F.when(ok, g(f, "string")).when(bad, F.lit(lx.SUMMARY_PARSE_DEFAULTS[f]))
                    .otherwise(F.lit(lx.SUMMARY_FAILED_DEFAULTS[f])).alias(f))
    for f in SUMMARY_LIST_FIELDS:
        cols.append(F.when(ok, g(f, "array<string>")).otherwise(F.array().cast("array<string>")).alias(f))
    cols.append(F.when(ok, g("overall_score", "int")).otherwise(F.lit(50)).alias("overall_score"))
    cols.append(status.alias("summary_status"))
    return responses.select("company", *cols)


def company_mention_flags(classified: DataFrame) -> DataFrame:
    """Distinct flags per company: explode + partial aggregate, so only the
    distinct flag set (not every row) reaches a company's group."""
    e = classified.select("company", F.explode("crisis_flags").alias("flag")).groupBy("company", "flag").agg(F.lit(1).alias("_x"))
    return e.groupBy("company").agg(F.array_sort(F.collect_list("flag")).alias("mention_flags"))


def company_crisis_flags(classified: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Summary flags united with every mention flag (only when there is at
    least one mention flag), sorted for determinism."""
    # one pass: explode_outer keeps companies without flags (null flag row)
    e = classified.select("company", F.explode_outer("crisis_flags").alias("flag")).groupBy("company", "flag").agg(F.lit(1).alias("_x"))
    base = e.groupBy("company").agg(F.array_sort(F.collect_list("flag")).alias("mention_flags"))
    if summaries is not None:
        base = base.join(summaries.select("company", F.col("crisis_flags").alias("summary_flags")), "company", "left")
    else:
        base = base.withColumn("summary_flags", F.array().cast("array<string>"))
    sf = F.coalesce("summary_flags", F.array().cast("array<string>"))
    mfc = F.coalesce("mention_flags", F.array().cast("array<string>"))
    flags = F.when(F.size(mfc) > 0, F.array_sort(F.array_union(sf, mfc))).otherwise(sf)
    return base.select("company", flags.alias("crisis_flags"))


def summarize_with(classified: DataFrame, fn) -> DataFrame:
    """Pluggable summarizer: ``fn(pandas.DataFrame[company, prompt]) ->
    pandas.DataFrame[company, response]`` per Arrow batch over the
    per-company prompts, then the tolerant summary parse."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf[["company", "prompt"]])[["company", "response"]]

    prompts = summary_prompts(classified).select("company", "prompt")
    return parse_summaries(prompts.mapInPandas(run, "company string, response string"))

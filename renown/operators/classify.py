"""Classifier prompts, tolerant response parsing and the classification merge.

Model inference is outside the engine: prompts are emitted as a table, the
responses come back as a table ``(seq, response)`` and are joined here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions.text import col_, py_strip
from renown.operators.relevance import is_analyzable
from renown.operators.tagging import bump_severity, with_crisis_flags


def classify_prompt(text) -> Column:
    return F.concat(F.lit(lx.CLASSIFY_USER_PREFIX), F.substring(F.coalesce(col_(text), F.lit("")), 1, lx.CLASSIFY_TEXT_CHARS))


def classify_prompts(mentions: DataFrame) -> DataFrame:
    """One prompt per analyzable mention."""
    return mentions.where(is_analyzable()).select("company", "seq", classify_prompt("raw_text").alias("prompt"))


def unfence(response) -> Column:
    """Strip; when the text starts with a code fence drop its first line and
    a fence at the very end, then strip again."""
    t = py_strip(col_(response))
    fenced = t.startswith("```")
    after_first = F.when(t.contains("\n"), F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)$", 1)).otherwise(t)
    tail_cut = F.when(after_first.endswith("```"),
                      F.substring(after_first, F.lit(1), F.length(after_first) - 3)).otherwise(after_first)
    return F.when(fenced, py_strip(tail_cut)).otherwise(t)




def with_parsed(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Parse once into ``_v`` / ``_status`` columns; field extraction then
    reads the parsed value instead of re-parsing the text per field."""
    raw = F.col(response_col)
    d = df.withColumn("_v", F.try_parse_json(unfence(raw)))
    v = F.col("_v")
    return d.withColumn("_status", F.when(raw.isNull(), F.lit("missing")).when(v.isNull(), F.lit("malformed"))
                        .when(F.schema_of_variant(v).startswith("OBJECT"), F.lit("ok")).otherwise(F.lit("non_object")))


def parse_responses(responses: DataFrame, response_col: str = "response") -> DataFrame:
    """Typed classification fields; absent keys stay null (a merge keeps the
    mention's own value for them), wrong types are cast when possible."""
    d = with_parsed(responses, response_col)
    v, status = F.col("_v"), F.col("_status")
    g = lambda path, t: F.try_variant_get(v, f"$.{path}", t)
    ok = status == "ok"
    return d.select(
        *responses.columns,
        status.alias("parse_status"),
        F.when(ok, g("sentiment", "string")).alias("p_sentiment"),
        F.when(ok, g("confidence", "double")).alias("p_confidence"),
        F.when(ok, g("reviewer_type", "string")).alias("p_reviewer_type"),
        F.when(ok, g("themes", "array<string>")).alias("p_themes"),
        F.when(ok, g("severity", "string")).alias("p_severity"),
        F.when(ok, g("language_detected", "string")).alias("p_language"),
    )


def classified_mentions(mentions: DataFrame, responses: DataFrame, keys=("seq",)) -> DataFrame:
    """Analyzable mentions left-joined on ``keys`` with their parsed responses,
    merged right-wins; failures keep the row with defaults and an error column."""
    d = lx.CLASSIFY_DEFAULTS
    m = mentions.where(is_analyzable())
    keep = [c for c in m.columns if c not in ("sentiment", "confidence", "themes", "severity",
                                              "language_detected", "crisis_flags", "analysis_error")]
    p = parse_responses(responses.select(*keys, "response")).drop("response")
    j = m.select(*keep).join(p, list(keys), "left")
    st = F.coalesce(F.col("parse_status"), F.lit("missing"))
    ok = st == "ok"
    nonobj = st == "non_object"
    j = with_crisis_flags(j.withColumn("_st", st), "raw_text", "_rules", only=F.col("_st") != "non_object")
    flags = F.col("_rules")
    severity = F.when(ok, F.col("p_severity")).otherwise(F.lit(d["severity"]))
    out = j.select(
        *[F.col(c) for c in keep if c != "reviewer_type"],
        F.when(ok, F.coalesce("p_sentiment", F.lit(d["sentiment"]))).otherwise(F.lit(d["sentiment"])).alias("sentiment"),
        F.when(ok, F.coalesce("p_confidence", F.lit(d["confidence"]))).otherwise(F.lit(d["confidence"])).alias("confidence"),
        F.when(ok, F.coalesce("p_reviewer_type", "reviewer_type"))
        .when(nonobj, F.coalesce("reviewer_type", F.lit(d["reviewer_type"])))
        .otherwise(F.lit(d["reviewer_type"])).alias("reviewer_type"),
        F.when(ok, F.coalesce("p_themes", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("themes"),
        severity.alias("_sev"),
        F.when(ok, F.col("p_language")).otherwise(F.lit(d["language_detected"])).alias("language_detected"),
        flags.alias("crisis_flags"),
        F.when(st == "malformed", F.lit("parse_error")).when(st == "missing", F.lit("missing_response"))
        .when(nonobj, F.lit("non_object")).alias("analysis_error"),
    )
    return out.withColumn("severity", bump_severity("_sev", "crisis_flags")).drop("_sev", "_rules", "_st")


RESPONSE_SCHEMA = "seq long, response string"


def responses_from(prompts: DataFrame, fn) -> DataFrame:
    """Pluggable classifier: ``fn(pandas.DataFrame[seq, prompt]) ->
    pandas.DataFrame[seq, response]`` runs per Arrow batch (``mapInPandas``),
    so a user model or service client is called in parallel over
    partitions.  Its output feeds ``classified_mentions`` like a landed
    response table; a batch for which ``fn`` raises gets null responses,
    which become 'missing_response' rows rather than failing the job."""
    def run(batches):
        for pdf in batches:
            try:
                out = fn(pdf[["seq", "prompt"]])[["seq", "response"]]
            except Exception:  # a user's model: its rows stay, without a response
                out = pdf[["seq"]].assign(response=None)
            yield out

    return prompts.select("seq", "prompt").mapInPandas(run, RESPONSE_SCHEMA)


def classify_with(mentions: DataFrame, fn) -> DataFrame:
    """Prompts -> user function -> parsed and merged classification."""
    return classified_mentions(mentions, responses_from(classify_prompts(mentions), fn))

"""Sinks and export shapes: CSV rows, JSON reports, ordered report lines.

Writers produce directories of part files (one per task) rather than one
file, so no export funnels a large table through a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions.text import latin1_safe

CSV_COLUMNS = ["source_platform", "source_url", "sentiment", "confidence", "reviewer_type", "themes", "severity",
               "language_detected", "date_raw", "raw_text"]


def csv_rows(classified: DataFrame) -> DataFrame:
    """The ten export columns with their header names; themes joined by
    '; '; missing values as ''.  The raw text is written whole."""
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cols = [e(c) if c != "themes" else F.array_join(F.coalesce("themes", F.array().cast("array<string>")), "; ")
            for c in CSV_COLUMNS]
    return classified.select(*[c.alias(h) for c, h in zip(cols, lx.CSV_HEADER)])


def write_csv(classified: DataFrame, path: str, mode: str = "overwrite") -> None:
    csv_rows(classified).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def report_json(report: DataFrame) -> DataFrame:
    """One JSON document per company (non-ASCII kept as is)."""
    return report.select("company", F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("report_json"))


def write_reports(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).json(path)


def _line(section: int, item, text) -> F.Column:
    return F.struct(F.lit(section).alias("section_ord"), (F.lit(item) if isinstance(item, int) else item).alias("item_ord"),
                    text.alias("text"))


def report_lines(report: DataFrame, title: str = "Company Reputation Report") -> DataFrame:
    """The printable report as ordered lines (company, section_ord, item_ord,
    text): header, score, the three views, pros, cons, crisis flags (only
    when present), recommendation, then per source the result count, the
    sentiment line and its distinct http urls.  Text is Latin-1 safe."""
    a = "aggregated_summary"
    s = lambda f: F.coalesce(F.col(f"{a}.{f}").cast("string"), F.lit("N/A"))
    head = F.array(
        _line(0, 0, F.lit(title)),
        _line(1, 0, F.concat(F.lit("Company: "), F.col("company"))),
        _line(2, 0, F.concat(F.lit("Generated: "), F.coalesce("generated_at", F.lit("")))),
        _line(3, 0, F.concat(F.lit("Model: "), F.coalesce("model_used", F.lit("")))),
        _line(4, 0, F.concat(F.lit("Total Results: "), F.coalesce(F.col("total_results").cast("string"), F.lit("0")))),
        _line(5, 0, F.concat(F.lit("Overall Score: "), F.coalesce(F.col("overall_score").cast("string"), F.lit("0")), F.lit("/100"))),
        _line(6, 0, F.lit("What Employees Say:")), _line(6, 1, s("what_employees_say")),
        _line(7, 0, F.lit("What Customers Say:")), _line(7, 1, s("what_customers_say")),
        _line(8, 0, F.lit("What Press Says:")), _line(8, 1, s("what_press_says")),
        _line(9, 0, F.lit("Top Pros:")), _line(10, 0, F.lit("Top Cons:")),
        _line(12, 0, F.lit("Recommendation:")), _line(12, 1, s("recommendation")),
        _line(13, 0, F.lit("Results by Source & Links")),
    )
    flags = F.coalesce(F.col(f"{a}.crisis_flags"), F.array().cast("array<string>"))
    lists = F.concat(
        F.transform(F.coalesce(F.col(f"{a}.top_5_pros"), F.array().cast("array<string>")),
                    lambda x, i: _line(9, i + 1, F.concat(F.lit("  + "), x))),
        F.transform(F.coalesce(F.col(f"{a}.top_5_cons"), F.array().cast("array<string>")),
                    lambda x, i: _line(10, i + 1, F.concat(F.lit("  - "), x))),
        F.when(F.size(flags) > 0, F.array(_line(11, 0, F.lit("CRISIS FLAGS:")))).otherwise(F.array().cast(
            "array<struct<section_ord:int,item_ord:int,text:string>>")),
        F.transform(flags, lambda x, i: _line(11, i + 1, F.concat(F.lit("  ! "), x))),
    )
    per_source = []
    for i, p in enumerate(lx.PLATFORMS):
        key = lx.SECTION_KEYS[p]
        sec = F.col(f"by_source.{key}")
        ordv = 20 + i
        src_lines = F.array(_line(ordv, 0, F.concat(sec["platform"], F.lit(": "), sec["result_count"].cast("string"), F.lit(" results"))))
        if "positive" in __import__("renown.operators.sections", fromlist=["x"]).SECTION_COLUMNS[p]:
            src_lines = F.concat(src_lines, F.array(_line(ordv, 1, F.concat(
                F.lit("  Positive: "), sec["positive"].cast("string"), F.lit(" | Neutral: "), sec["neutral"].cast("string"),
                F.lit(" | Negative: "), sec["negative"].cast("string")))))
        urls = F.array_distinct(F.filter(F.coalesce(sec["urls"], F.array().cast("array<string>")), lambda u: u.startswith("http")))
        src_lines = F.concat(src_lines, F.transform(urls, lambda u, j: _line(ordv, j + 2, F.concat(F.lit("  "), u))))
        per_source.append(F.when(sec.isNotNull(), src_lines).otherwise(F.array().cast(
            "array<struct<section_ord:int,item_ord:int,text:string>>")))
    allv = F.concat(head, lists, *per_source)
    out = report.select("company", F.inline(allv))
    return out.select("company", F.col("section_ord").cast("int"), F.col("item_ord").cast("int"), latin1_safe("text").alias("text"))

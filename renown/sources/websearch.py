"""Web-search responses landed as JSON (two result layouts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renown.functions.text import safe_text

LAYOUT_A = "struct<results:array<struct<url:string, title:string, content:string, score:double>>>"
LAYOUT_B = "struct<organic_results:array<struct<link:string, title:string, snippet:string, position:int>>>"


def extract_results(landing: DataFrame) -> DataFrame:
    """Both layouts in one pass: each payload is parsed with both schemas and
    whichever array is present is exploded (position kept for ordering)."""
    a = F.from_json("payload", LAYOUT_A)["results"]
    b = F.from_json("payload", LAYOUT_B)["organic_results"]
    unified_a = F.transform(a, lambda r: F.struct(
        r["url"].alias("url"), r["title"].alias("title"), r["content"].alias("body"), r["score"].alias("score"),
        F.lit(None).cast("int").alias("position"), F.lit("engine_a").alias("search_engine")))
    unified_b = F.transform(b, lambda r: F.struct(
        r["link"].alias("url"), r["title"].alias("title"), r["snippet"].alias("body"), F.lit(None).cast("double").alias("score"),
        r["position"].alias("position"), F.lit("engine_b").alias("search_engine")))
    rows = F.coalesce(unified_a, unified_b, F.array())
    x = landing.select(*[c for c in landing.columns if c != "payload"], F.posexplode(rows).alias("result_pos", "_r"))
    r = F.col("_r")
    return x.select(
        *[c for c in landing.columns if c != "payload"], "result_pos",
        F.lit("web").alias("source_platform"),
        F.coalesce(r["url"], F.lit("")).alias("source_url"),
        safe_text(F.concat(F.coalesce(r["title"], F.lit("")), F.lit("\n\n"), F.coalesce(r["body"], F.lit("")))).alias("raw_text"),
        F.coalesce(r["title"], F.lit("")).alias("title"), r["score"].alias("score"), r["position"].alias("position"),
        r["search_engine"].alias("search_engine"), F.lit("web_result").alias("type"),
    )

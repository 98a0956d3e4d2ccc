"""Column helpers against hand-made rows (edge cases from the semantics ledger)."""

from pyspark.sql import functions as F

from renown.functions import text as tx
from renown.operators import tagging as TG


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_safe_text(spark):
    assert one(spark, tx.safe_text("v"), None) == ""
    assert one(spark, tx.safe_text("v"), "   hi \n") == "hi"
    assert one(spark, tx.safe_text("v", 3), "abcdef") == "abc..."
    assert one(spark, tx.safe_text("v", 3), "abc") == "abc"


def test_fingerprint_collapses_unicode_space(spark):
    assert one(spark, tx.fingerprint("v"), " A  b\n\nC ") == "a b c"
    assert len(one(spark, tx.fingerprint("v"), "x" * 500)) == 200


def test_title_case_matches_python(spark):
    s = "people'S bank 99x o-neil wso2"
    assert one(spark, tx.title_case("v"), s) == s.title()


def test_format_epoch(spark):
    assert one(spark, tx.format_epoch("v"), 0.0, "v double") == "1970-01-01T00:00:00"
    assert one(spark, tx.format_epoch("v"), 1.5, "v double") == "1970-01-01T00:00:01.500000"


def test_salary_and_metrics(spark):
    assert one(spark, tx.salary_info("v"), "pay Rs. 50,000 - 80,000 monthly") == "Rs. 50,000 - 80,000"
    assert one(spark, tx.salary_info("v"), "no pay") is None
    assert one(spark, tx.listing_review_count("v"), "4.5 stars 1,234 reviews") == 1234
    assert one(spark, tx.listing_review_count("v"), "nothing") == 0
    assert one(spark, tx.likes_text("v"), "12.5K likes") == "12.5K"
    assert one(spark, tx.employees_text("v"), "11-50 employees") == "11-50"


def test_pros_cons(spark):
    r = one(spark, tx.pros_cons("v"), "Great Pros team Pros pay Cons hours Cons more")
    assert (r["pros"], r["cons"]) == ("pay", "hours")
    assert r["text"] == "Pros: pay\nCons: hours"
    r = one(spark, tx.pros_cons("v"), "only Pros")
    assert (r["pros"], r["cons"], r["text"]) == ("", "", "only Pros")


def test_source_site(spark):
    assert one(spark, tx.source_site("v"), "https://www.ft.lk/x") == "ft.lk"
    assert one(spark, tx.source_site("v"), "https://example.org") == "unknown"


def test_latin1_safe(spark):
    assert one(spark, tx.latin1_safe("v"), "a—b “q” … é 日") == 'a-b "q" ... é ?'


def test_crisis_tags_substring_semantics(spark):
    flags = one(spark, TG.crisis_tags("v"), "They were SUED after the second layoff")
    # 'sec' matches inside 'second' (substring semantics are preserved)
    assert flags == sorted(["Legal case or court proceeding", "Mass layoffs or retrenchment",
                            "Regulatory body mentioned: SEC"])
    assert one(spark, TG.crisis_tags("v"), "calm text") == []


def test_regulatory_labels(spark):
    assert one(spark, TG.regulatory_tags("v"), "Central Bank of Sri Lanka and CBSL") == ["CBSL", "Central Bank Of Sri Lanka"]

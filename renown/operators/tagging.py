"""Keyword tagging: regulatory bodies and crisis signals (rule lexicons)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions.text import col_
from renown.functions.matcher import any_hit, labels_in_order, lexicon_hits


def regulatory_label(body: str) -> str:
    """Display form: short codes upper-case, names title-case."""
    return body.upper() if len(body) <= 4 else body.title()


def _empty():
    return F.array().cast("array<string>")


def crisis_lexicon(patterns=None, bodies=None):
    """Flatten the category patterns and regulatory bodies into one needle
    list: (needles, [(category, needle indexes)], [(index, body label)])."""
    patterns = patterns or lx.CRISIS_PATTERNS
    bodies = bodies or lx.REGULATORY_BODIES
    needles, cats, regs = [], [], []
    for cat, pats in patterns:
        cats.append((cat, list(range(len(needles), len(needles) + len(pats)))))
        needles.extend(pats)
    for b in bodies:
        regs.append((len(needles), regulatory_label(b)))
        needles.append(b)
    return needles, cats, regs


def regulatory_tags(text, bodies=None) -> Column:
    """Ordered list of regulatory bodies found in the text (substring match)."""
    bodies = bodies or lx.REGULATORY_BODIES
    return labels_in_order(lexicon_hits(text, bodies), [(i, regulatory_label(b)) for i, b in enumerate(bodies)])


def _crisis_from(hits: Column, reg: Column, cats) -> Column:
    tags = [F.when(any_hit(hits, idx), F.array(F.lit(cat))).otherwise(_empty()) for cat, idx in cats]
    reg_tag = F.when(F.size(reg) > 0, F.array(F.concat(F.lit(lx.REGULATORY_FLAG_PREFIX), F.array_join(reg, ", ")))).otherwise(_empty())
    # categories are distinct and the regulatory tag differs from all of them,
    # so the set is the concatenation; sort_array needs no comparator lambda
    return F.sort_array(F.concat(*tags, reg_tag))


def crisis_tags(text, patterns=None, bodies=None) -> Column:
    """One tag per crisis category with any pattern hit, plus one
    'Regulatory body mentioned: …' tag; set semantics, sorted."""
    needles, cats, regs = crisis_lexicon(patterns, bodies)
    hits = lexicon_hits(text, needles)
    return _crisis_from(hits, labels_in_order(hits, regs), cats)


def with_crisis_flags(df: DataFrame, text_col: str = "raw_text", out: str = "crisis_flags",
                      only: Column | None = None) -> DataFrame:
    """Add crisis flags from one pass over the text for all patterns and
    bodies; the hit list and the regulatory labels are projected once and
    referenced by every tag.  ``only``: rows where it is false get no flags."""
    needles, cats, regs = crisis_lexicon()
    d = df.withColumn("_hits", lexicon_hits(text_col, needles))
    d = d.withColumn("_reg", labels_in_order(F.col("_hits"), regs))
    flags = _crisis_from(F.col("_hits"), F.col("_reg"), cats)
    if only is not None:
        flags = F.when(only, flags).otherwise(_empty())
    return d.withColumn(out, flags).drop("_hits", "_reg")


def bump_severity(severity, flags) -> Column:
    """Crisis present and severity not high/critical -> 'high'."""
    s = col_(severity)
    return F.when((F.size(col_(flags)) > 0) & (s.isNull() | ~s.isin("high", "critical")), F.lit("high")).otherwise(s)

"""Multi-keyword substring matching.

``lexicon_hits`` serves the fixed lexicons (a few dozen patterns) in generated
code: one quoted alternation decides whether a text has any hit, and only
those texts are tested pattern by pattern.  It gives the sorted distinct
indexes of the needles found in the lower-cased text.  Company needles by the
thousand go through the gram index of ``entities.tag_companies``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def lexicon_hits(text, needles) -> Column:
    """Sorted distinct indexes of a fixed lexicon contained in lower(text)."""
    low = F.lower(F.coalesce(_text(text), F.lit("")))
    none = F.array().cast("array<int>")
    found = F.concat(*[F.when(low.contains(n), F.array(F.lit(i))).otherwise(none) for i, n in enumerate(needles)])
    return F.when(low.rlike("|".join(f"\\Q{n}\\E" for n in needles)), found).otherwise(none)


def any_hit(hits: Column, indexes) -> Column:
    """True when any of ``indexes`` is among the hits."""
    return F.arrays_overlap(hits, F.array(*[F.lit(int(i)) for i in indexes]))


def labels_in_order(hits: Column, items) -> Column:
    """Labels of the (index, label) items that were hit, in item order."""
    return F.concat(*[F.when(F.array_contains(hits, int(i)), F.array(F.lit(lab))).otherwise(F.array().cast("array<string>"))
                      for i, lab in items])

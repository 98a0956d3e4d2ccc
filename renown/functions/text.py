"""Column -> Column text helpers.

All helpers are built from native Spark SQL functions so they stay inside
whole-stage code generation; none of them call Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from renown.functions import lexicons as lx

# Character class equal to Python's str.isspace() set, usable in Java regex
# (and in RE2, which the SQL oracles use).
PY_SPACE = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# the same set as plain characters, for btrim (no regex, no backtracking)
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(col_(c), F.lit(PY_SPACE_CHARS))


def collapse_ws(c) -> Column:
    """Python ``" ".join(s.split())``."""
    return F.regexp_replace(py_strip(c), f"{PY_SPACE}+", " ")


def safe_text(c, max_len: int = lx.SAFE_TEXT_CHARS) -> Column:
    """null/'' -> ''; strip; over ``max_len`` chars -> first max_len + '...'."""
    t = py_strip(F.coalesce(col_(c), F.lit("")))
    return F.when(F.length(t) > max_len, F.concat(F.substring(t, 1, max_len), F.lit("..."))).otherwise(t)


def fingerprint(c, n: int = lx.FINGERPRINT_CHARS, window: int = 8 * lx.FINGERPRINT_CHARS) -> Column:
    """Exact-duplicate key: lower, collapse whitespace, first ``n`` chars.

    The collapsed form of a prefix is a prefix of the collapsed whole text,
    so when a ``window``-char prefix already yields ``n`` collapsed chars the
    key is taken from it; otherwise the whole text is collapsed.  Same
    result, without rewriting 100 KB texts to keep 200 chars."""
    t = F.coalesce(col_(c), F.lit(""))
    head = collapse_ws(F.lower(F.substring(t, 1, window)))
    return F.when(F.length(head) >= n, F.substring(head, 1, n)).otherwise(
        F.substring(collapse_ws(F.lower(t)), 1, n))


def title_case(c) -> Column:
    """Python ``str.title()``: each run of letters starts upper-case, rest lower."""
    parts = F.regexp_extract_all(F.lower(col_(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def normalize_spaces(c) -> Column:
    """strip + collapse runs of whitespace to one space (name normalisation)."""
    return collapse_ws(c)


def format_epoch(c) -> Column:
    """Epoch seconds -> ISO-8601 text in UTC (microseconds only when non-zero)."""
    x = col_(c).cast("double")
    ts = F.timestamp_micros(F.round(x * F.lit(1_000_000)).cast("long"))
    whole = F.round(x * F.lit(1_000_000)).cast("long") % F.lit(1_000_000) == 0
    return F.when(x.isNull(), F.lit(None).cast("string")).when(
        whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))




def rx_first(c, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern`` (or a group of it); null when there is none."""
    c = col_(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


# --- metric extraction (case-insensitive, first match) ---
SALARY_RX = r"(?i)(?:LKR|Rs\.?)\s*([\d,]+(?:\s*[-–]\s*[\d,]+)?)"
STARS_RX = r"(?i)(\d+\.?\d*)\s*stars?"
REVIEWS_RX = r"(?i)(\d[\d,]*)\s*reviews?"
ARIA_STAR_RX = r"(?i)(\d+)\s*star"
RATING_RX = r"(?i)(\d\.?\d?)\s*(?:out of 5|stars?|rating)"
LIKES_RX = r"(?i)([\d,]+(?:\.\d+)?[KMkm]?)\s*(?:likes?|followers?)"
FOLLOWERS_RX = r"(?i)([\d,]+)\s*followers?"
EMPLOYEES_RX = r"(?i)([\d,]+(?:\s*[-–]\s*[\d,]+)?)\s*employees?"
CLASS_RATING_RX = r'(?i)class="[^"]*rating[^"]*"[^>]*>(\d\.?\d?)'
PROFILE_URL_RX = r"linkedin\.com/company/[^/&\"']+"
PAGE_URL_RX = r"facebook\.com/[^/&\"'?]+"


def salary_info(c) -> Column:
    return rx_first(c, SALARY_RX, 0)


def listing_stars(c) -> Column:
    return rx_first(c, STARS_RX, 1).cast("double")


def listing_review_count(c) -> Column:
    return F.coalesce(F.regexp_replace(rx_first(c, REVIEWS_RX, 1), ",", "").cast("int"), F.lit(0))


def aria_stars(c) -> Column:
    return rx_first(c, ARIA_STAR_RX, 1).cast("double")


def snippet_rating(c) -> Column:
    return rx_first(c, RATING_RX, 1).cast("double")


def likes_text(c) -> Column:
    return rx_first(c, LIKES_RX, 1)


def followers_text(c) -> Column:
    return rx_first(c, FOLLOWERS_RX, 1)


def employees_text(c) -> Column:
    return rx_first(c, EMPLOYEES_RX, 1)


def class_rating(c) -> Column:
    return rx_first(c, CLASS_RATING_RX, 1).cast("double")


def profile_url(c) -> Column:
    m = rx_first(c, PROFILE_URL_RX, 0)
    return F.concat(F.lit("https://www."), m)


def page_url(c) -> Column:
    m = rx_first(c, PAGE_URL_RX, 0)
    return F.concat(F.lit("https://www."), m)


def source_site(url, sites=None) -> Column:
    """First site of the ordered list contained in the url, else 'unknown'."""
    sites = sites or lx.NEWS_SITES
    arr = F.array(*[F.lit(s) for s in sites])
    u = F.coalesce(col_(url), F.lit(""))
    return F.coalesce(F.get(F.filter(arr, lambda s: u.contains(s)), 0), F.lit("unknown"))


def pros_cons(c) -> Column:
    """Split an employee review on the 'Pros' / 'Cons' markers.

    Returns struct(pros, cons, text); pros/cons are '' unless both markers
    occur; text is re-rendered when either part is non-empty.
    """
    t = F.coalesce(col_(c), F.lit(""))
    both = t.contains("Pros") & t.contains("Cons")
    pros_part = F.substring_index(t, "Cons", 1)
    cons_raw = F.substring_index(F.substring_index(t, "Cons", 2), "Cons", -1)
    pros_raw = F.when(pros_part.contains("Pros"), F.substring_index(pros_part, "Pros", -1)).otherwise(pros_part)
    pros = F.when(both, pros_raw).otherwise(F.lit(""))
    cons = F.when(both, cons_raw).otherwise(F.lit(""))
    text = F.when(
        (pros != "") | (cons != ""),
        F.concat(F.lit("Pros: "), py_strip(pros), F.lit("\nCons: "), py_strip(cons)),
    ).otherwise(t)
    return F.struct(py_strip(pros).alias("pros"), py_strip(cons).alias("cons"), text.alias("text"))


def latin1_safe(c) -> Column:
    """Fixed replacements, then every non-Latin-1 code point -> '?'."""
    t = F.coalesce(col_(c).cast("string"), F.lit(""))
    for old, new in lx.LATIN1_REPLACEMENTS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(t, r"[^\x{0}-\x{FF}]", "?")




def url_host(url) -> Column:
    """Lower-cased network location (host[:port]) or null for unparsable urls."""
    return F.lower(F.try_parse_url(F.coalesce(col_(url), F.lit("")), F.lit("AUTHORITY")))

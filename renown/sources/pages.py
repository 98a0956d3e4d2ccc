"""Extraction jobs over landed HTML pages (listing, reviews, jobs, profiles,
social pages, news).  Each takes the element table from
``renown.sources.html.html_elements`` (plus the page table where page-level
text is needed); caps are ``row_number`` filters with literal bounds and
descendant lookups are equi-joins on the page plus a position range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from renown.functions import lexicons as lx
from renown.functions import text as tx
from renown.plans.strategy import any_of
from renown.sources.html import class_matches


def _ranked(df: DataFrame, cap: int, out: str = "item_rank", keys=("page_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("pos")
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= cap)


def _first_descendant(outer: DataFrame, inner: DataFrame, name: str, cols) -> DataFrame:
    """Attach the first (document order) inner element inside each outer one."""
    o = outer.select("page_id", F.col("pos").alias("_o_pos"), F.col("end_pos").alias("_o_end"))
    i = inner.select("page_id", F.col("pos").alias("_i_pos"), *[F.col(c).alias(f"_i_{c}") for c in cols])
    j = o.join(i, "page_id").where((F.col("_i_pos") > F.col("_o_pos")) & (F.col("_i_pos") < F.col("_o_end")))
    first = j.groupBy("page_id", "_o_pos").agg(F.min_by(F.struct(*[F.col(f"_i_{c}").alias(c) for c in cols]), "_i_pos").alias(name))
    return outer.join(first.withColumnRenamed("_o_pos", "pos"), ["page_id", "pos"], "left")


def _with_parent_text(el: DataFrame, all_el: DataFrame) -> DataFrame:
    par = all_el.select("page_id", F.col("pos").alias("parent_pos"), F.col("text").alias("parent_text"))
    return el.join(par, ["page_id", "parent_pos"], "left").withColumn("parent_text", F.coalesce("parent_text", F.lit("")))


# ------------------------------------------------------------------ maps

def map_listing(pages: DataFrame) -> DataFrame:
    """First 'N stars' and 'N reviews' in the page markup; a row only when a
    rating exists, with a synthetic sentence as text."""
    h = F.col("html")
    stars = tx.listing_stars(h)
    reviews = tx.listing_review_count(h)
    out = pages.select("page_id", "url", "company", stars.alias("star_rating"), reviews.alias("review_count"))
    out = out.where(F.col("star_rating").isNotNull())
    return out.select(
        "page_id", "company", F.lit("google_maps").alias("source_platform"), F.col("url").alias("source_url"),
        F.concat(F.col("company"), F.lit(" on Google Maps: "), F.col("star_rating").cast("string"), F.lit(" stars, "),
                 F.col("review_count").cast("string"), F.lit(" reviews")).alias("raw_text"),
        F.col("star_rating").alias("rating"), "review_count", F.lit("business_listing").alias("type"))


def map_reviews(elements: DataFrame, cap: int = lx.PLATFORM_CAPS["google_maps"]) -> DataFrame:
    """Review blocks (data-review-id), first ``cap`` per page; rating from the
    aria label 'N star'."""
    r = _ranked(elements.where(F.col("review_id").isNotNull()), cap, "review_index")
    return r.select("page_id", (F.col("review_index") - 1).alias("review_index"), F.lit("google_maps").alias("source_platform"),
                    tx.safe_text("text").alias("raw_text"), tx.aria_stars(F.coalesce("aria_label", F.lit(""))).alias("rating"),
                    F.lit("review").alias("type"))


# ------------------------------------------------------------- employees

def employee_reviews(elements: DataFrame, pages: DataFrame, cap: int = lx.PLATFORM_CAPS["glassdoor"]) -> DataFrame:
    """Primary layout: blocks whose class contains 'review' (or test id
    'review'), first ``cap``; the page-level rating is copied to each row;
    text re-rendered from the Pros/Cons markers."""
    b = elements.where(F.coalesce("cls", F.lit("")).contains("review") | (F.coalesce("test_id", F.lit("")) == "review"))
    b = _ranked(b, cap)
    rating = pages.select("page_id", tx.class_rating(F.col("html")).alias("rating"))
    pc = tx.pros_cons("text")
    return b.join(rating, "page_id", "left").select(
        "page_id", "item_rank", F.lit("glassdoor").alias("source_platform"), F.lit(0).alias("tier"),
        tx.safe_text(pc["text"]).alias("raw_text"), "rating", pc["pros"].alias("pros"), pc["cons"].alias("cons"),
        F.lit("glassdoor").alias("source_site"))


def secondary_employee_reviews(elements: DataFrame, cap: int = lx.PLATFORM_CAPS["glassdoor"]) -> DataFrame:
    """Second site: test id 'review' or class containing 'review-container'."""
    b = elements.where((F.coalesce("test_id", F.lit("")) == "review") | F.coalesce("cls", F.lit("")).contains("review-container"))
    b = _ranked(b, cap)
    return b.select("page_id", "item_rank", F.lit("glassdoor").alias("source_platform"), F.lit(1).alias("tier"),
                    tx.safe_text("text").alias("raw_text"), F.lit(None).cast("double").alias("rating"),
                    F.lit(None).cast("string").alias("pros"), F.lit(None).cast("string").alias("cons"),
                    F.lit("indeed").alias("source_site"))


def employee_review_cascade(primary: DataFrame, secondary: DataFrame, cap: int = lx.PLATFORM_CAPS["glassdoor"],
                            keys=("page_id",)) -> DataFrame:
    """The second site is read only when the first gave fewer than ``cap``;
    the combined list is cut to ``cap``."""
    n = primary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sec = secondary.join(n, list(keys), "left").where(F.coalesce("_n", F.lit(0)) < cap).drop("_n")
    both = primary.unionByName(sec)
    w = Window.partitionBy(*keys).orderBy("tier", "item_rank")
    return both.withColumn("cascade_rank", F.row_number().over(w)).where(F.col("cascade_rank") <= cap)


def news_cascade(articles: DataFrame, links: DataFrame, cap: int = lx.PLATFORM_CAPS["news"], keys=("company",)) -> DataFrame:
    """Search results first, then site links in site order (within both by
    page and place), cut to ``cap`` rows per company."""
    a = articles.select(*keys, "page_id", "tier", F.lit(-1).alias("site_ord"), F.col("item_rank").alias("pos"), "source_url",
                        "raw_text", "date_raw", "headline", "source_site")
    b = links.select(*keys, "page_id", "tier", "site_ord", "pos", "source_url", "raw_text", F.lit(None).cast("string").alias("date_raw"),
                     "headline", "source_site")
    w = Window.partitionBy(*keys).orderBy("tier", "site_ord", "page_id", "pos")
    u = a.unionByName(b)
    return u.withColumn("cascade_rank", F.row_number().over(w)).where(F.col("cascade_rank") <= cap)


# ------------------------------------------------------------------ jobs

def job_listings(elements: DataFrame, cap: int = lx.PLATFORM_CAPS["topjobs"] // 3) -> DataFrame:
    """Text nodes containing the company (case-insensitive, literal); the
    first ``cap`` per page, each giving its parent element's text."""
    e = elements.select("*", F.posexplode("own_texts").alias("node_i", "node"))
    e = e.where(F.lower("node").contains(F.lower("company")))
    w = Window.partitionBy("page_id").orderBy("pos", "node_i")
    e = e.withColumn("item_rank", F.row_number().over(w)).where(F.col("item_rank") <= cap)
    return e.select("page_id", "item_rank", F.lit("topjobs").alias("source_platform"),
                    F.lit("https://www.topjobs.lk").alias("source_url"), tx.safe_text("text").alias("raw_text"),
                    tx.salary_info("text").alias("salary_info"))


def job_cards_b(elements: DataFrame, cap: int = lx.PLATFORM_CAPS["topjobs"]) -> DataFrame:
    """li/div/a with a card-like class, first ``cap`` per page, then text of at
    least 10 chars without an ignore phrase; url from the first link inside."""
    cards = _ranked(elements.where(F.col("tag").isin("li", "div", "a") & class_matches("card|listing|item|ad")), cap, "card_rank")
    lt = F.lower("text")
    cards = cards.where((F.length("text") >= 10) & ~any_of(lt.contains(p) for p in lx.JOB_CARD_IGNORE_B))
    url = F.concat(F.lit("https://ikman.lk"), F.coalesce("first_href", F.lit("")))
    return cards.select("page_id", "card_rank", F.lit("topjobs").alias("source_platform"), url.alias("source_url"),
                        tx.safe_text("text").alias("raw_text"), tx.salary_info("text").alias("salary_info"))


def job_cards_c(elements: DataFrame, cap: int = lx.PLATFORM_CAPS["topjobs"]) -> DataFrame:
    """div/tr/li with a job-like class, first ``cap``, >= 10 chars, no ignore phrase."""
    c = elements.where(F.col("tag").isin("div", "tr", "li") & class_matches("job|listing|vacancy"))
    c = _ranked(c, cap)
    lt = F.lower("text")
    c = c.where((F.length("text") >= 10) & ~any_of(lt.contains(p) for p in lx.JOB_CARD_IGNORE_C))
    return c.select("page_id", "item_rank", F.lit("topjobs").alias("source_platform"),
                    F.lit("https://www.jobsnet.lk").alias("source_url"), tx.safe_text("text").alias("raw_text"))


def careers_text(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Body text of a careers page, kept when longer than 50 chars."""
    body = elements.where(F.col("tag") == "body").groupBy("page_id").agg(F.min_by("text", "pos").alias("body_text"))
    b = pages.select("page_id", "url").join(body, "page_id")
    return b.where(F.length("body_text") > 50).select(
        "page_id", F.lit("topjobs").alias("source_platform"), F.col("url").alias("source_url"),
        tx.safe_text("body_text").alias("raw_text"))


def careers_link(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Redirect target per careers page: the first http link whose href names
    an applicant-tracking domain; else the last http link whose text has a
    careers phrase; else the page itself.  Pages already on such a domain
    are not scanned."""
    a = elements.where((F.col("tag") == "a") & F.col("href").isNotNull())
    hl = F.lower("href")
    tl = F.lower(F.coalesce("text", F.lit("")))
    is_http = hl.startswith("http")
    ats = is_http & any_of(hl.contains(d) for d in lx.ATS_DOMAINS)
    phrase = is_http & any_of(tl.contains(p) for p in lx.CAREERS_LINK_PHRASES)
    g = a.groupBy("page_id").agg(F.min_by(F.when(ats, F.col("href")), F.when(ats, F.col("pos"))).alias("ats_href"),
                                 F.max_by(F.when(phrase, F.col("href")), F.when(phrase, F.col("pos"))).alias("phrase_href"))
    p = pages.select("page_id", "url").join(g, "page_id", "left")
    on_ats = any_of(F.lower("url").contains(d) for d in lx.ATS_DOMAINS)
    return p.select("page_id", "url", F.when(on_ats, F.col("url")).otherwise(
        F.coalesce("ats_href", "phrase_href", "url")).alias("careers_url"))


# -------------------------------------------------------------- profiles

def profile_links(elements: DataFrame, cap: int = lx.PLATFORM_CAPS["linkedin"]) -> DataFrame:
    """Links to company profiles, first ``cap`` per page; canonical url,
    snippet = parent text, followers and employees from the snippet."""
    a = elements.where((F.col("tag") == "a") & F.coalesce("href", F.lit("")).rlike(r"linkedin\.com/company"))
    a = _ranked(a, cap)
    a = _with_parent_text(a, elements).where(F.coalesce("href", F.lit("")).rlike(tx.PROFILE_URL_RX))
    return a.select("page_id", "item_rank", F.lit("linkedin").alias("source_platform"), tx.profile_url("href").alias("source_url"),
                    tx.safe_text("parent_text").alias("raw_text"), tx.followers_text("parent_text").alias("followers"),
                    tx.employees_text("parent_text").alias("employees"), F.lit("company_profile").alias("type"))


def profile_cards(elements: DataFrame, links: DataFrame, cap: int = lx.PLATFORM_CAPS["linkedin"]) -> DataFrame:
    """Search cards (class entity-result): the first ``cap - n`` per page where
    n is the number of profile-link rows, kept when text > 20 chars."""
    n = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n"))
    c = _ranked(elements.where((F.col("tag") == "div") & class_matches("entity-result")), cap)
    c = c.join(n, "page_id", "left").where(F.col("item_rank") <= cap - F.coalesce("_n", F.lit(0)))
    c = c.where(F.length(F.coalesce("text", F.lit(""))) > 20)
    return c.select("page_id", "item_rank", F.lit("linkedin").alias("source_platform"), tx.safe_text("text").alias("raw_text"),
                    F.lit("search_result").alias("type"))


def social_pages(elements: DataFrame, cap: int = lx.PLATFORM_CAPS["facebook"]) -> DataFrame:
    """Links to social pages: canonical url, distinct first-seen, first
    ``cap``; snippet = parent text; rating and likes from the snippet."""
    a = elements.where((F.col("tag") == "a") & F.coalesce("href", F.lit("")).rlike(r"facebook\.com/"))
    a = a.where(F.col("href").rlike(tx.PAGE_URL_RX)).withColumn("canon", tx.page_url("href"))
    first = a.groupBy("page_id", "canon").agg(F.min("pos").alias("pos"))
    a = a.join(first, ["page_id", "canon", "pos"], "left_semi")
    a = _with_parent_text(_ranked(a, cap), elements)
    return a.select("page_id", "item_rank", F.lit("facebook").alias("source_platform"), F.col("canon").alias("source_url"),
                    tx.safe_text("parent_text").alias("raw_text"), tx.snippet_rating("parent_text").alias("rating"),
                    tx.likes_text("parent_text").alias("likes"), F.lit("page_info").alias("type"))


# ------------------------------------------------------------------ news

def news_articles(elements: DataFrame, cap: int = lx.PLATFORM_CAPS["news"], keys=("company",)) -> DataFrame:
    """Result blocks (div, class result|article|news), first ``cap``:
    headline from the first h3/h2/a inside, snippet from the first
    p/span/div with a snippet-like class (else the block text), link, date
    text; kept when headline or snippet is non-empty."""
    art = _ranked(elements.where((F.col("tag") == "div") & class_matches("result|article|news")), cap)
    heads = elements.where(F.col("tag").isin("h3", "h2", "a"))
    snips = elements.where(F.col("tag").isin("p", "span", "div") & class_matches("snippet|desc|text"))
    links = elements.where((F.col("tag") == "a") & F.col("href").isNotNull())
    dates = elements.where(F.col("tag").isin("time", "span") & class_matches("date|time|ago"))
    a = _first_descendant(art, heads, "h", ["text"])
    a = _first_descendant(a, snips, "s", ["text"])
    a = _first_descendant(a, links, "l", ["href"])
    a = _first_descendant(a, dates, "d", ["text"])
    headline = F.coalesce(F.col("h.text"), F.lit(""))
    snippet = F.coalesce(F.col("s.text"), F.col("text"), F.lit(""))
    url = F.coalesce(F.col("l.href"), F.lit(""))
    body = F.when(headline != "", F.concat(headline, F.lit("\n\n"), snippet)).otherwise(snippet)
    out = a.where((headline != "") | (snippet != ""))
    return out.select(*keys, "page_id", "item_rank", F.lit("news").alias("source_platform"), url.alias("source_url"),
                      tx.safe_text(body).alias("raw_text"), F.col("d.text").alias("date_raw"), headline.alias("headline"),
                      tx.source_site(url).alias("source_site"), F.lit(0).alias("tier"))


def news_links(elements: DataFrame, sites=None, cap: int = lx.PLATFORM_CAPS["news"], already: DataFrame | None = None,
               keys=("company",)) -> DataFrame:
    """Per site in order, links whose href contains the site with headline
    text longer than 10 chars; sites are consulted only while the company's
    rows so far (``already`` plus those of earlier sites) are below ``cap``."""
    sites = sites or lx.NEWS_SITES[:5]
    arr = F.array(*[F.struct(F.lit(i).alias("site_ord"), F.lit(s).alias("site")) for i, s in enumerate(sites)])
    a = elements.where((F.col("tag") == "a") & F.col("href").isNotNull() & (F.length("text") > 10))
    x = a.select("*", F.inline(arr)).where(F.col("href").contains(F.col("site")))
    per_site = x.groupBy(*keys, "site_ord").agg(F.count(F.lit(1)).alias("n_site"))
    w = Window.partitionBy(*keys).orderBy("site_ord").rowsBetween(Window.unboundedPreceding, -1)
    gate = per_site.withColumn("before", F.coalesce(F.sum("n_site").over(w), F.lit(0)))
    if already is not None:
        gate = gate.join(already.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n0")), list(keys), "left")
        gate = gate.withColumn("before", F.col("before") + F.coalesce("_n0", F.lit(0)))
    x = x.join(gate.where(F.col("before") < cap).select(*keys, "site_ord"), [*keys, "site_ord"], "left_semi")
    return x.select(*keys, "page_id", "site_ord", "pos", F.lit("news").alias("source_platform"), F.col("href").alias("source_url"),
                    tx.safe_text("text").alias("raw_text"), F.col("text").alias("headline"), F.col("site").alias("source_site"),
                    F.lit(1).alias("tier"))


# ------------------------------------------------------------ web search

def web_result_blocks(elements: DataFrame) -> DataFrame:
    """Search-result blocks (div with class token 'g'): link required, title
    from the first h3, snippet from the first span/div with class st|snippet;
    kept only when title + snippet + url pass the geography test."""
    from renown.operators.relevance import geo_predicate

    g = elements.where((F.col("tag") == "div") & F.array_contains(F.split(F.coalesce("cls", F.lit("")), " "), "g")
                       & F.col("first_href").isNotNull())
    g = _first_descendant(g, elements.where(F.col("tag") == "h3"), "h", ["text"])
    g = _first_descendant(g, elements.where(F.col("tag").isin("span", "div") & class_matches("st|snippet")), "s", ["text"])
    title = F.coalesce(F.col("h.text"), F.lit(""))
    snippet = F.coalesce(F.col("s.text"), F.lit(""))
    url = F.col("first_href")
    g = g.withColumn("_combined", F.concat_ws(" ", title, snippet, url))
    g = g.where(geo_predicate("_combined", url))
    return g.select("page_id", "pos", F.lit("web").alias("source_platform"), url.alias("source_url"),
                    tx.safe_text(F.concat(title, F.lit("\n\n"), snippet)).alias("raw_text"), title.alias("title"),
                    F.lit("google").alias("search_engine"), F.lit("web_result").alias("type"))

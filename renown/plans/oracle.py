"""DuckDB oracle SQL for each registered query (same column names)."""

from __future__ import annotations

from renown.functions import lexicons as lx
from renown.operators import similarity as SIM
from renown.plans import fixtures as fx
from renown.plans.catalog import AS_OF_RECENT, SITE_POOL
from renown.plans.oracle_fixtures import arr, company_name, py_strip, q, with_views
from renown.plans.oracle_sql import (analyzable_sql, any_contains, avg_rating_sql, crisis_sql, geo_sql, join_arr,
                                     quote_sql, regulatory_sql, title_sql)
from renown.sources.html import VOID

ORACLE: dict[str, str] = {}


def oracle(name: str, *views: str, extra=None):
    def deco(fn):
        ORACLE[name] = with_views(fn(), *views, extra=extra)
        return fn
    return deco


def cnt(cond: str) -> str:
    return f"CAST(count_if({cond}) AS BIGINT)"


def safe_text_sql(t: str) -> str:
    st = py_strip(f"coalesce({t}, '')")
    return f"CASE WHEN length({st}) > {lx.SAFE_TEXT_CHARS} THEN substring({st}, 1, {lx.SAFE_TEXT_CHARS}) || '...' ELSE {st} END"


@oracle("safe_text", "mentions_fx")
def _():
    st = safe_text_sql("raw_text")
    return f"SELECT seq, length({st}) AS n_chars, md5({st}) AS text_md5, substring({st}, greatest(length({st}) - 19, 1), 20) AS tail FROM mentions_fx"


def _epoch_iso(x: str) -> str:
    us = f"CAST(round(({x}) * 1000000) AS BIGINT)"
    return (f"CASE WHEN {us} % 1000000 = 0 THEN strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%f') END")


@oracle("format_date", "mentions_fx")
def _():
    e = f"(CAST({fx.FORUM_EPOCH0} + seq * 3600 AS DOUBLE) + CASE WHEN seq % 4 = 0 THEN 0.25 ELSE 0.0 END)"
    return f"SELECT seq, {_epoch_iso(e)} AS iso_date, date_raw AS passthrough FROM mentions_fx"


def _fmt(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


METRIC_TEXT = (
    "concat_ws('; ', "
    f"CASE WHEN seq % 7 <> 0 THEN 'Rated ' || {_s('seq % 5 + 1')} || '.' || {_s('seq % 10')} || ' stars from ' || {_fmt('seq * 37')} || ' reviews' END, "
    f"CASE WHEN seq % 4 = 0 THEN 'salary Rs. ' || {_fmt('seq * 100')} || ' - ' || {_fmt('seq * 150')} "
    f"WHEN seq % 4 = 1 THEN 'LKR' || {_s('seq * 90')} END, "
    f"{_s('seq % 13')} || '.5K likes', "
    f"{_fmt('seq * 11')} || ' followers', "
    f"{_s('seq % 50')} || '-' || {_s('seq % 50 + 10')} || ' employees', "
    f"'aria ' || {_s('seq % 5 + 1')} || ' star', "
    f"CASE WHEN seq % 3 = 0 THEN {_s('seq % 5')} || ' out of 5' END, "
    f"CASE WHEN seq % 5 = 0 THEN '<span class=\"rating-big\">' || {_s('seq % 5')} || '.2</span>' END)"
)


def _rx(t: str, pat: str, g: int) -> str:
    return f"CASE WHEN regexp_matches({t}, {q(pat)}) THEN regexp_extract({t}, {q(pat)}, {g}) END"


@oracle("extract_metrics", "mentions_fx")
def _():
    from renown.functions import text as tx
    return f"""
    SELECT seq,
      CAST({_rx('t', tx.STARS_RX, 1)} AS DOUBLE) AS stars,
      coalesce(CAST(replace({_rx('t', tx.REVIEWS_RX, 1)}, ',', '') AS INTEGER), 0) AS review_count,
      {_rx('t', tx.SALARY_RX, 0)} AS salary_info,
      {_rx('t', tx.LIKES_RX, 1)} AS likes,
      {_rx('t', tx.FOLLOWERS_RX, 1)} AS followers,
      {_rx('t', tx.EMPLOYEES_RX, 1)} AS employees,
      CAST({_rx('t', tx.ARIA_STAR_RX, 1)} AS DOUBLE) AS aria_stars,
      CAST({_rx('t', tx.RATING_RX, 1)} AS DOUBLE) AS rating,
      CAST({_rx('t', tx.CLASS_RATING_RX, 1)} AS DOUBLE) AS class_rating
    FROM (SELECT seq, {METRIC_TEXT} AS t FROM mentions_fx)"""


@oracle("canonical_urls", "mentions_fx")
def _():
    from renown.functions import text as tx
    li = "'https://www.google.com/url?q=https://www.linkedin.com/company/acme-' || CAST(seq AS VARCHAR) || '/about&sa=U'"
    fb = "'https://m.facebook.com/page' || CAST(seq AS VARCHAR) || CASE WHEN seq % 2 = 0 THEN '?ref=x' ELSE '/posts' END"
    return (f"SELECT seq, 'https://www.' || {_rx(li, tx.PROFILE_URL_RX, 0)} AS profile_url, "
            f"'https://www.' || {_rx(fb, tx.PAGE_URL_RX, 0)} AS page_url FROM mentions_fx")


@oracle("source_site", "mentions_fx")
def _():
    url = f"'https://www.' || ({arr(SITE_POOL)})[seq % 10 + 1] || '/news/' || CAST(seq AS VARCHAR)"
    return f"SELECT seq, coalesce(list_filter({arr(lx.NEWS_SITES)}, lambda x: contains({url}, x))[1], 'unknown') AS source_site FROM mentions_fx"


@oracle("pros_cons", "mentions_fx")
def _():
    t = ("CASE WHEN seq % 4 = 0 THEN 'Pros good pay ' || CAST(seq AS VARCHAR) || ' Cons long hours Cons again' "
         "WHEN seq % 4 = 1 THEN 'Great Pros team Pros culture ' || CAST(seq AS VARCHAR) || ' Cons none' "
         "WHEN seq % 4 = 2 THEN 'Only Pros here ' || CAST(seq AS VARCHAR) ELSE substring(raw_text, 1, 60) END")
    return f"""
    SELECT seq, {py_strip('pros')} AS pros, {py_strip('cons')} AS cons,
      CASE WHEN pros <> '' OR cons <> '' THEN 'Pros: ' || {py_strip('pros')} || chr(10) || 'Cons: ' || {py_strip('cons')} ELSE t END AS review_text
    FROM (SELECT seq, t,
            CASE WHEN both_ THEN (CASE WHEN contains(pp, 'Pros') THEN string_split(pp, 'Pros')[-1] ELSE pp END) ELSE '' END AS pros,
            CASE WHEN both_ THEN split_part(t, 'Cons', 2) ELSE '' END AS cons
          FROM (SELECT seq, t, contains(t, 'Pros') AND contains(t, 'Cons') AS both_, split_part(t, 'Cons', 1) AS pp
                FROM (SELECT seq, coalesce({t}, '') AS t FROM mentions_fx)))"""


@oracle("export_manifest", "mentions_fx")
def _():
    stamp = f"strftime(TIMESTAMP '{fx.AS_OF}', '%Y%m%d_%H%M%S')"
    return f"SELECT DISTINCT company, replace(lower(company), ' ', '_') || '_' || {stamp} AS file_stem FROM mentions_fx"


# ------------------------------------------------------------------ entities

NEEDLES = ("needles_fx", """
SELECT c.company, list_sort(list_distinct(list_concat([lower(c.company)], coalesce(a.al, [])))) AS needles
FROM (SELECT DISTINCT company FROM mentions_fx) c
LEFT JOIN (SELECT lower(full_name) AS k, list(DISTINCT lower(alias)) AS al FROM aliases_fx GROUP BY 1) a ON a.k = lower(c.company)
""")


def alias_keys_sql() -> str:
    keys = [fx.ALIAS_TOKENS[i % 12] for i in range(fx.N_COMPANIES)] + [a for a, _ in fx.EXTRA_ALIASES]
    return arr(keys)


@oracle("normalize_company", "mentions_fx", "aliases_fx")
def _():
    pick = (f"([lower(company), upper(company), '99X', 'mit', '  people''s  bank 99x o-neil wso2 ', "
            f"({arr(fx.ALIAS_TOKENS)})[seq % 12 + 1], substring(raw_text, 1, 12)])[seq % 7 + 1]")
    from renown.plans.oracle_fixtures import PY_SPACE
    norm = f"regexp_replace({py_strip('raw_name')}, '{PY_SPACE}+', ' ', 'g')"
    return f"""
    SELECT n.seq, coalesce(a.full_name, {title_sql('n.name')}) AS company
    FROM (SELECT seq, {norm} AS name FROM (SELECT seq, '  ' || {pick} || chr(9) AS raw_name FROM mentions_fx)) n
    LEFT JOIN (SELECT lower(alias) AS k, arg_min(full_name, ord) AS full_name FROM aliases_fx GROUP BY 1) a ON a.k = lower(n.name)"""


@oracle("company_needles", "mentions_fx", "aliases_fx", extra=[NEEDLES])
def _():
    return f"SELECT company, {join_arr('needles')} AS needles FROM needles_fx"


def _mentions_any(t: str) -> str:
    return f"len(list_filter(n.needles, lambda x: contains(lower(coalesce({t}, '')), x))) > 0"


@oracle("mentions_company", "mentions_fx", "aliases_fx", extra=[NEEDLES])
def _():
    return f"SELECT m.seq, m.company, {_mentions_any('m.raw_text')} AS in_text, {_mentions_any('m.source_url')} AS in_url FROM mentions_fx m JOIN needles_fx n USING (company)"


@oracle("tag_companies", "mentions_fx", "aliases_fx", extra=[NEEDLES])
def _():
    return ("SELECT DISTINCT m.seq, n.company FROM mentions_fx m, (SELECT company, unnest(needles) AS needle FROM needles_fx) n "
            "WHERE length(n.needle) > 0 AND contains(lower(coalesce(m.raw_text, '')), n.needle)")


ORACLE["tag_companies_indexed"] = ORACLE["tag_companies"]


@oracle("enriched_queries", "mentions_fx")
def _():
    cases = " ".join(f"WHEN lower(p.platform) = {q(k)} THEN {q(v.split('{c}')[0])} || c.company || {q(v.split('{c}')[1])}"
                     for k, v in lx.QUERY_TEMPLATES.items())
    d = lx.QUERY_TEMPLATE_DEFAULT.split("{c}")
    plats = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(lx.PLATFORMS))
    return (f"SELECT c.company, p.platform_ord, p.platform, CASE {cases} ELSE {q(d[0])} || c.company || {q(d[1])} END AS query "
            f"FROM (SELECT DISTINCT company FROM mentions_fx) c, (VALUES {plats}) p(platform_ord, platform)")


# ----------------------------------------------------------------- relevance

def _relevant(m: str = "m") -> str:
    ends = f"len(list_filter({alias_keys_sql()}, lambda k: ends_with(lower(coalesce({m}.source_url, '')), k))) > 0"
    return f"({_mentions_any(m + '.raw_text')} OR {ends} OR {_mentions_any(m + '.source_url')})"


STAGES = ("stages_fx", f"""
SELECT m.*, {_relevant()} AS relevant, {geo_sql('m.raw_text', 'm.source_url')} AS geo_ok
FROM mentions_fx m JOIN needles_fx n USING (company)
""")
STAGES2 = ("stages2_fx", "SELECT *, relevant AND (source_platform = 'topjobs' OR geo_ok) AS validated FROM stages_fx")


@oracle("relevance_filter", "mentions_fx", "aliases_fx", extra=[NEEDLES])
def _():
    return f"SELECT m.seq, m.company FROM mentions_fx m JOIN needles_fx n USING (company) WHERE {_relevant()}"


@oracle("geo_filter", "mentions_fx")
def _():
    return f"SELECT seq, company FROM mentions_fx WHERE {geo_sql('raw_text', 'source_url')}"


@oracle("validated_mentions", "mentions_fx", "aliases_fx", extra=[NEEDLES, STAGES, STAGES2])
def _():
    return "SELECT seq, company, source_platform FROM stages2_fx WHERE validated"


@oracle("recent_mentions", "mentions_fx")
def _():
    cutoff = f"(TIMESTAMP '{AS_OF_RECENT}' - INTERVAL {lx.MAX_POST_AGE_DAYS} DAY)"
    return (f"SELECT seq, company FROM mentions_fx WHERE NOT (source_platform = 'reddit' AND metadata.type = 'post') "
            f"OR CAST(date_raw AS TIMESTAMP) >= {cutoff}")


@oracle("analyzable_mentions", "mentions_fx")
def _():
    return f"SELECT seq, company FROM mentions_fx WHERE {analyzable_sql('raw_text')}"


def fp_sql(t: str) -> str:
    from renown.plans.oracle_fixtures import PY_SPACE
    inner = py_strip(f"lower(coalesce({t}, ''))")
    return f"substring(regexp_replace({inner}, '{PY_SPACE}+', ' ', 'g'), 1, {lx.FINGERPRINT_CHARS})"


@oracle("pipeline_funnel", "mentions_fx", "aliases_fx", extra=[NEEDLES, STAGES, STAGES2])
def _():
    return f"""
    SELECT s.company, count(*) AS raw, {cnt('NOT relevant')} AS irrelevant, {cnt('relevant AND NOT validated')} AS non_geo,
      {cnt('validated')} AS validated, {cnt('validated AND k.seq IS NULL')} AS duplicates,
      {cnt('validated AND k.seq IS NOT NULL AND ' + analyzable_sql('raw_text'))} AS analyzed
    FROM stages2_fx s LEFT JOIN (SELECT company, min(seq) AS seq FROM stages2_fx WHERE validated GROUP BY company, {fp_sql('raw_text')}) k
      ON k.company = s.company AND k.seq = s.seq
    GROUP BY s.company"""


# ------------------------------------------------------------------- tagging

@oracle("regulatory_tags", "mentions_fx")
def _():
    return f"SELECT seq, {join_arr(regulatory_sql('raw_text'))} AS regulatory FROM mentions_fx"


@oracle("crisis_tags", "mentions_fx")
def _():
    return f"SELECT seq, {join_arr(crisis_sql('raw_text'))} AS crisis_flags FROM mentions_fx"


# ------------------------------------------------------------ classification

def unfence_sql(r: str) -> str:
    t = py_strip(r)
    after = f"CASE WHEN contains({t}, chr(10)) THEN regexp_extract({t}, '(?s)^[^\\n]*\\n(.*)$', 1) ELSE {t} END"
    cut = f"CASE WHEN ends_with({after}, '```') THEN substring({after}, 1, length({after}) - 3) ELSE {after} END"
    return f"CASE WHEN starts_with({t}, '```') THEN {py_strip(cut)} ELSE {t} END"


PARSED = ("parsed_fx", f"""
SELECT seq, j, CASE WHEN response IS NULL THEN 'missing' WHEN NOT json_valid(j) THEN 'malformed'
                    WHEN json_type(j) = 'OBJECT' THEN 'ok' ELSE 'non_object' END AS parse_status
FROM (SELECT seq, response, {unfence_sql('response')} AS j FROM responses_fx)
""")
PARSED2 = ("parsed2_fx", """
SELECT seq, parse_status,
  CASE WHEN parse_status = 'ok' THEN json_extract_string(j, '$.sentiment') END AS p_sentiment,
  CASE WHEN parse_status = 'ok' THEN TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS p_confidence,
  CASE WHEN parse_status = 'ok' THEN json_extract_string(j, '$.reviewer_type') END AS p_reviewer_type,
  CASE WHEN parse_status = 'ok' AND json_type(j, '$.themes') = 'ARRAY' THEN json_extract_string(j, '$.themes[*]') END AS p_themes,
  CASE WHEN parse_status = 'ok' THEN json_extract_string(j, '$.severity') END AS p_severity,
  CASE WHEN parse_status = 'ok' THEN json_extract_string(j, '$.language_detected') END AS p_language
FROM parsed_fx
""")


@oracle("parse_responses", "responses_fx", extra=[PARSED, PARSED2])
def _():
    return ("SELECT seq, parse_status, p_sentiment AS sentiment, p_confidence AS confidence, p_reviewer_type AS reviewer_type, "
            f"{join_arr('p_themes')} AS themes, p_severity AS severity, p_language AS language_detected FROM parsed2_fx")


CLASSIFIED = ("classified_fx", f"""
SELECT seq, company, source_platform, raw_text,
  CASE WHEN ok THEN coalesce(p_sentiment, 'neutral') ELSE 'neutral' END AS sentiment,
  CASE WHEN ok THEN coalesce(p_confidence, 0.0) ELSE 0.0 END AS confidence,
  CASE WHEN ok THEN coalesce(p_reviewer_type, reviewer_type) WHEN st = 'non_object' THEN coalesce(reviewer_type, 'general') ELSE 'general' END AS reviewer_type,
  CASE WHEN ok THEN coalesce(p_themes, []) ELSE [] END AS themes,
  CASE WHEN len(flags) > 0 AND (sev IS NULL OR sev NOT IN ('high', 'critical')) THEN 'high' ELSE sev END AS severity,
  CASE WHEN ok THEN p_language ELSE 'en' END AS language_detected,
  flags AS crisis_flags,
  CASE st WHEN 'malformed' THEN 'parse_error' WHEN 'missing' THEN 'missing_response' WHEN 'non_object' THEN 'non_object' END AS analysis_error
FROM (SELECT m.*, coalesce(p.parse_status, 'missing') AS st, coalesce(p.parse_status, 'missing') = 'ok' AS ok,
        p.p_sentiment, p.p_confidence, p.p_reviewer_type, p.p_themes, p.p_language,
        CASE WHEN coalesce(p.parse_status, 'missing') = 'ok' THEN p.p_severity ELSE 'low' END AS sev,
        CASE WHEN p.parse_status = 'non_object' THEN [] ELSE {crisis_sql('m.raw_text')} END AS flags
      FROM mentions_fx m LEFT JOIN parsed2_fx p USING (seq)
      WHERE {analyzable_sql('m.raw_text')})
""")


@oracle("classified_mentions", "responses_fx", extra=[PARSED, PARSED2, CLASSIFIED])
def _():
    return (f"SELECT seq, company, sentiment, confidence, reviewer_type, {join_arr('themes')} AS themes, severity, "
            f"language_detected, {join_arr('crisis_flags')} AS crisis_flags, analysis_error FROM classified_fx")


@oracle("classify_prompts", "mentions_fx")
def _():
    p = f"{q(lx.CLASSIFY_USER_PREFIX.replace(chr(10), '<NL>'))} || substring(coalesce(raw_text, ''), 1, {lx.CLASSIFY_TEXT_CHARS})"
    p = p.replace("<NL>", "' || chr(10) || '")
    return f"SELECT seq, length(p) AS prompt_len, md5(p) AS prompt_md5 FROM (SELECT seq, {p} AS p FROM mentions_fx WHERE {analyzable_sql('raw_text')})"


@oracle("summary_prompts", "mentions_fx")
def _():
    line = ("'[' || CAST(rn AS VARCHAR) || '] Source: ' || coalesce(source_platform, 'unknown') || ' | Sentiment: ' || coalesce(sentiment, 'unknown') "
            "|| ' | Type: ' || coalesce(reviewer_type, 'unknown') || ' | Themes: ' || array_to_string(coalesce(themes, []), ', ') "
            f"|| ' | Text: ' || substring(coalesce(raw_text, ''), 1, {lx.SUMMARY_TEXT_CHARS})")
    return f"""
    SELECT company, n_lines, length(p) AS prompt_len, md5(p) AS prompt_md5 FROM (
      SELECT company, count(*) AS n_lines,
        'Summarize these ' || CAST(count(*) AS VARCHAR) || ' classified reviews:' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rn) AS p
      FROM (SELECT company, rn, {line} AS line FROM (
              SELECT *, row_number() OVER (PARTITION BY company ORDER BY seq) AS rn FROM mentions_fx WHERE {analyzable_sql('raw_text')})
            WHERE rn <= {lx.SUMMARY_ROWS})
      GROUP BY company)"""


SUMMARY_RESP = ("summary_resp_fx", """
SELECT company, CASE WHEN k % 4 = 0 THEN 'not json' WHEN k % 4 = 1 THEN '```' || chr(10) || obj || chr(10) || '```'
                     WHEN k % 4 = 2 THEN '[]' ELSE obj END AS response
FROM (SELECT company, k, '{"what_employees_say": "emp ' || CAST(k AS VARCHAR) || '", "what_customers_say": "cust", '
        || '"top_5_pros": ["pay", "team"], "top_5_cons": ["hours"], "crisis_flags": ["Summary flag"], '
        || '"recommendation": "watch", "overall_score": ' || CAST((n * 7) % 101 AS VARCHAR) || '}' AS obj
      FROM (SELECT company, count(*) AS n, min(seq) AS k FROM mentions_fx GROUP BY company))
""")


def _summary_parsed():
    from renown.operators.summarize import SUMMARY_LIST_FIELDS, SUMMARY_TEXT_FIELDS
    cols = []
    for f in SUMMARY_TEXT_FIELDS:
        cols.append(f"CASE WHEN st = 'ok' THEN json_extract_string(j, '$.{f}') WHEN st IN ('malformed', 'missing') "
                    f"THEN {q(lx.SUMMARY_PARSE_DEFAULTS[f])} ELSE {q(lx.SUMMARY_FAILED_DEFAULTS[f])} END AS {f}")
    for f in SUMMARY_LIST_FIELDS:
        cols.append(f"CASE WHEN st = 'ok' AND json_type(j, '$.{f}') = 'ARRAY' THEN json_extract_string(j, '$.{f}[*]') "
                    f"WHEN st = 'ok' THEN NULL ELSE [] END AS {f}")
    cols.append("CASE WHEN st = 'ok' THEN TRY_CAST(json_extract_string(j, '$.overall_score') AS INTEGER) ELSE 50 END AS overall_score")
    cols.append("st AS summary_status")
    return ("summary_parsed_fx", f"""
    SELECT company, {', '.join(cols)} FROM (
      SELECT company, j, CASE WHEN response IS NULL THEN 'missing' WHEN NOT json_valid(j) THEN 'malformed'
                              WHEN json_type(j) = 'OBJECT' THEN 'ok' ELSE 'non_object' END AS st
      FROM (SELECT company, response, {unfence_sql('response')} AS j FROM summary_resp_fx))""")


SUMMARY_PARSED = _summary_parsed()


@oracle("parse_summaries", "mentions_fx", extra=[SUMMARY_RESP, SUMMARY_PARSED])
def _():
    from renown.operators.summarize import SUMMARY_LIST_FIELDS, SUMMARY_TEXT_FIELDS
    return (f"SELECT company, {', '.join(SUMMARY_TEXT_FIELDS)}, {', '.join(join_arr(f) + ' AS ' + f for f in SUMMARY_LIST_FIELDS)}, "
            "overall_score, summary_status FROM summary_parsed_fx")


SCORED = ("scored_fx", f"""
SELECT * REPLACE (CASE WHEN len(crisis_flags) > 0 AND (severity IS NULL OR severity NOT IN ('high', 'critical')) THEN 'high' ELSE severity END AS severity)
FROM (SELECT *, {crisis_sql('raw_text')} AS crisis_flags FROM mentions_fx WHERE {analyzable_sql('raw_text')})
""")


@oracle("company_crisis_flags", "mentions_fx", extra=[SCORED, SUMMARY_RESP, SUMMARY_PARSED])
def _():
    return f"""
    SELECT c.company, {join_arr("CASE WHEN len(coalesce(mf.f, [])) > 0 THEN list_sort(list_distinct(list_concat(coalesce(s.crisis_flags, []), mf.f))) ELSE coalesce(s.crisis_flags, []) END")} AS crisis_flags
    FROM (SELECT DISTINCT company FROM scored_fx) c
    LEFT JOIN (SELECT company, list(DISTINCT flag) AS f FROM (SELECT company, unnest(crisis_flags) AS flag FROM scored_fx) GROUP BY company) mf USING (company)
    LEFT JOIN summary_parsed_fx s USING (company)"""


@oracle("mention_roundtrip", "mentions_fx")
def _():
    return ("SELECT seq, source_platform, source_url, md5(raw_text) AS text_md5, date_raw AS date, rating, reviewer_type, "
            "metadata.pros AS pros, metadata.review_count AS review_count FROM mentions_fx")


# --------------------------------------------------------------- aggregates

SENT = ", ".join(f"CAST(count_if(sentiment = '{x}') AS BIGINT) AS {x}" for x in ("positive", "negative", "neutral"))


@oracle("source_counts", "mentions_fx")
def _():
    return "SELECT company, source_platform, count(*) AS result_count FROM mentions_fx GROUP BY ALL HAVING count(*) > 0"


@oracle("sentiment_breakdown", "mentions_fx")
def _():
    return f"SELECT company, source_platform, count(*) AS result_count, {SENT} FROM mentions_fx GROUP BY ALL"


@oracle("sentiment_share", "mentions_fx")
def _():
    tot = "(positive + negative + neutral)"
    cols = ", ".join(f"round(CASE WHEN {tot} = 0 THEN NULL ELSE {s} * 100.0 / {tot} END, 9) AS {s}_pct" for s in ("positive", "negative", "neutral"))
    return f"SELECT company, source_platform, {cols} FROM (SELECT company, source_platform, {SENT} FROM mentions_fx GROUP BY ALL)"


@oracle("sentiment_by_reviewer", "mentions_fx")
def _():
    return f"SELECT company, coalesce(reviewer_type, 'general') AS reviewer_type, {SENT} FROM mentions_fx GROUP BY ALL"


THEMES_SQL = """
SELECT company, source_platform, theme_rank, theme, n FROM (
  SELECT *, row_number() OVER (PARTITION BY company, source_platform ORDER BY n DESC, fs, fp) AS theme_rank FROM (
    SELECT company, source_platform, theme, count(*) AS n, arg_min(seq, seq * 1000 + pos) AS fs, arg_min(pos, seq * 1000 + pos) AS fp
    FROM (SELECT company, source_platform, seq, unnest(coalesce(themes, [])) AS theme, generate_subscripts(coalesce(themes, []), 1) AS pos FROM {src})
    GROUP BY ALL))
WHERE theme_rank <= 5
"""


@oracle("top_themes", "mentions_fx")
def _():
    return THEMES_SQL.format(src="mentions_fx")


@oracle("avg_rating", "mentions_fx")
def _():
    return f"SELECT company, source_platform, {avg_rating_sql('rating')} AS avg_rating FROM mentions_fx GROUP BY ALL"


QUOTES_SQL = """
SELECT company, source_platform, quote_rank, md5(quote) AS quote_md5, length(quote) AS quote_len FROM (
  SELECT company, source_platform, {qt} AS quote,
    row_number() OVER (PARTITION BY company, source_platform ORDER BY coalesce(CAST(confidence AS DOUBLE), 0.0) DESC, seq) AS quote_rank
  FROM {src} WHERE length(coalesce(raw_text, '')) > 20)
WHERE quote_rank <= 3
"""


@oracle("sample_quotes", "mentions_fx")
def _():
    return QUOTES_SQL.format(src="mentions_fx", qt=quote_sql("raw_text"))


@oracle("source_urls", "mentions_fx")
def _():
    return "SELECT company, source_platform, source_url, min(seq) AS first_seq FROM mentions_fx WHERE coalesce(source_url, '') <> '' GROUP BY ALL"


def score_sql(total: str, pos: str, neg: str, crisis: str) -> str:
    base = f"CAST(trunc(({pos} / {total}) * 100.0) AS INTEGER)"
    s = f"{base} - {crisis} * 5 - CASE WHEN ({neg} / {total}) > 0.5 THEN 10 ELSE 0 END"
    return f"CAST(CASE WHEN {total} = 0 THEN 50 ELSE greatest(0, least(100, {s})) END AS INTEGER)"


def band_sql(s: str) -> str:
    return f"CASE WHEN {s} >= 70 THEN 'Good' WHEN {s} >= 40 THEN 'Mixed' ELSE 'Poor' END"


@oracle("company_scorecard", "mentions_fx", extra=[SCORED])
def _():
    return f"""
    SELECT *, rule_score AS overall_score, {band_sql('rule_score')} AS score_band FROM (
      SELECT *, {score_sql('total_results', 'positive', 'negative', 'crisis_rows')} AS rule_score FROM (
        SELECT company, count(*) AS total_results, {SENT}, CAST(count_if(len(crisis_flags) > 0) AS BIGINT) AS crisis_rows
        FROM scored_fx GROUP BY company))"""


# ------------------------------------------------------------------ sections

def _ja(expr: str) -> str:
    return f"coalesce(array_to_string({expr}, '|'), '')"


def _nonempty(x: str) -> str:
    return f"coalesce({x}, '') <> ''"


def section_sql(plat: str) -> str:
    cols = ["company", "count(*) AS result_count"]
    if plat != "topjobs":
        cols.append(SENT)
    m = lambda f: f"metadata.{f}"
    if plat == "reddit":
        sub, prefix = m("subreddit"), q("r/")
        cols.append(f"{_ja(f'list_sort(list(DISTINCT {prefix} || {sub}) FILTER (WHERE {_nonempty(sub)}))')} AS subreddits_searched")
    if plat in ("google_maps", "glassdoor", "facebook"):
        cols.append(f"{avg_rating_sql('rating')} AS avg_rating")
    if plat == "google_maps":
        cols.append("coalesce(max(metadata.review_count) FILTER (WHERE metadata.review_count <> 0), 0) AS review_count")
    if plat == "glassdoor":
        cols.append("count(*) AS employee_count")
        for f, o in (("pros", "top_pros"), ("cons", "top_cons")):
            cols.append(f"{_ja(f'(list({m(f)} ORDER BY seq) FILTER (WHERE {_nonempty(m(f))}))[1:5]')} AS {o}")
        role = m("reviewer_role")
        cols.append(f"{_ja(f'list_sort(list(DISTINCT {role}) FILTER (WHERE {_nonempty(role)}))')} AS roles_represented")
    if plat == "topjobs":
        sal = m("salary_info")
        cols.append("count(*) AS active_job_count")
        cols.append(f"arg_min({sal}, seq) FILTER (WHERE {_nonempty(sal)}) AS salary_range_lkr")
        cols.append(f"{_ja(f'list({sal} ORDER BY seq) FILTER (WHERE {_nonempty(sal)})')} AS all_salary_info")
        cols.append("CASE WHEN count(*) >= 10 THEN 'growing' WHEN count(*) >= 3 THEN 'stable' WHEN count(*) >= 1 THEN 'shrinking' ELSE 'none' END AS hiring_trend")
    if plat == "linkedin":
        for f in ("followers", "employees"):
            cols.append(f"arg_max({m(f)}, seq) FILTER (WHERE {_nonempty(m(f))}) AS {f}")
    if plat == "facebook":
        cols.append(f"arg_max({m('likes')}, seq) FILTER (WHERE {_nonempty(m('likes'))}) AS page_likes")
    if plat == "news":
        art = ("concat_ws('~', coalesce(metadata.headline, substring(coalesce(raw_text, ''), 1, 100)), "
               "coalesce(metadata.source_site, 'unknown'), coalesce(date_raw, ''), sentiment, coalesce(source_url, ''))")
        cols.append(f"coalesce(string_agg({art}, '|' ORDER BY seq), '') AS articles")
        cols.append(f"coalesce(array_to_string((list({art} ORDER BY seq))[1:5], '|'), '') AS latest_articles")
    sql = f"WITH base AS (SELECT * FROM scored_fx WHERE source_platform = {q(plat)}),\n"
    sql += f"agg AS (SELECT {', '.join(cols)} FROM base GROUP BY company)"
    sel = ["agg.*"]
    joins = []
    if plat not in ("topjobs", "linkedin"):
        sql += (",\nth AS (SELECT company, array_to_string(list(theme ORDER BY theme_rank), '|') AS top_themes FROM ("
                + THEMES_SQL.format(src="base") + ") GROUP BY company)")
        sel.append("coalesce(th.top_themes, '') AS top_themes")
        joins.append("LEFT JOIN th USING (company)")
    if plat not in ("glassdoor", "news"):
        qs = (f"SELECT company, quote_rank, {quote_sql('raw_text')} AS quote FROM (SELECT *, row_number() OVER (PARTITION BY company "
              "ORDER BY coalesce(CAST(confidence AS DOUBLE), 0.0) DESC, seq) AS quote_rank FROM base WHERE length(coalesce(raw_text, '')) > 20) "
              "WHERE quote_rank <= 3")
        sql += f",\nqu AS (SELECT company, array_to_string(list(quote ORDER BY quote_rank), '|') AS sample_quotes FROM ({qs}) GROUP BY company)"
        sel.append("coalesce(qu.sample_quotes, '') AS sample_quotes")
        joins.append("LEFT JOIN qu USING (company)")
    sql += (",\nur AS (SELECT company, array_to_string(list(source_url ORDER BY first_seq), '|') AS urls FROM ("
            "SELECT company, source_url, min(seq) AS first_seq FROM base WHERE coalesce(source_url, '') <> '' GROUP BY ALL) GROUP BY company)")
    sel.append("coalesce(ur.urls, '') AS urls")
    joins.append("LEFT JOIN ur USING (company)")
    sel.append(f"{q(lx.SECTION_NAMES[plat])} AS platform")
    return sql + f"\nSELECT {', '.join(sel)} FROM agg {' '.join(joins)}"


for _name, _plat in [("section_forum", "reddit"), ("section_maps", "google_maps"), ("section_employee", "glassdoor"),
                     ("section_jobs", "topjobs"), ("section_profile", "linkedin"), ("section_social", "facebook"),
                     ("section_news", "news"), ("section_web", "web")]:
    _sql = section_sql(_plat)
    # the section SQL starts with its own WITH; splice it after the fixture CTEs
    ORACLE[_name] = with_views("SELECT * FROM sec", "mentions_fx", extra=[SCORED, ("sec", _sql.replace("WITH base AS", "SELECT * FROM (WITH base AS", 1) + ")")])


FLAGS = ("flags_fx", f"""
SELECT c.company, CASE WHEN len(coalesce(mf.f, [])) > 0 THEN list_sort(list_distinct(list_concat(coalesce(s.crisis_flags, []), mf.f)))
                       ELSE coalesce(s.crisis_flags, []) END AS crisis_flags
FROM (SELECT DISTINCT company FROM scored_fx) c
LEFT JOIN (SELECT company, list(DISTINCT flag) AS f FROM (SELECT company, unnest(crisis_flags) AS flag FROM scored_fx) GROUP BY company) mf USING (company)
LEFT JOIN summary_parsed_fx s USING (company)
""")


@oracle("company_report", "mentions_fx", extra=[SCORED, SUMMARY_RESP, SUMMARY_PARSED, FLAGS])
def _():
    d = lx.REPORT_SUMMARY_DEFAULTS
    return f"""
    SELECT c.company, coalesce(s.overall_score, c.rule_score) AS overall_score, {band_sql('coalesce(s.overall_score, c.rule_score)')} AS score_band,
      c.total_results, c.n_sections,
      coalesce(s.what_employees_say, {q(d['what_employees_say'])}) AS what_employees_say,
      coalesce(s.what_press_says, {q(d['what_press_says'])}) AS what_press_says,
      coalesce(s.recommendation, {q(d['recommendation'])}) AS recommendation,
      {join_arr('s.top_5_pros')} AS top_5_pros, {join_arr('f.crisis_flags')} AS crisis_flags,
      c.reddit_count, c.news_count
    FROM (SELECT company, count(*) AS total_results, count(DISTINCT source_platform) AS n_sections,
            {score_sql('count(*)', "count_if(sentiment = 'positive')", "count_if(sentiment = 'negative')", 'count_if(len(crisis_flags) > 0)')} AS rule_score,
            CASE WHEN count_if(source_platform = 'reddit') > 0 THEN CAST(count_if(source_platform = 'reddit') AS BIGINT) END AS reddit_count,
            CASE WHEN count_if(source_platform = 'news') > 0 THEN CAST(count_if(source_platform = 'news') AS BIGINT) END AS news_count
          FROM scored_fx GROUP BY company) c
    LEFT JOIN summary_parsed_fx s USING (company) LEFT JOIN flags_fx f USING (company)"""


# --------------------------------------------------------------------- views

def _case_map(col: str, mapping: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + f" ELSE {default} END"


@oracle("labelled_mentions", "mentions_fx", extra=[SCORED])
def _():
    badge = _case_map("coalesce(reviewer_type, 'general')", lx.REVIEWER_BADGES, q(lx.REVIEWER_BADGES["general"]))
    tl = "list_transform(coalesce(themes, []), lambda t: " + _case_map("t", lx.THEME_LABELS, "t") + ")"
    return (f"SELECT seq, company, coalesce(source_url, '') AS source_url, coalesce(sentiment, 'neutral') AS sentiment, {badge} AS badge, "
            f"substring(coalesce(date_raw, ''), 1, 10) AS date_short, array_to_string({tl}, ', ') AS theme_labels, "
            "upper(coalesce(severity, 'low')) AS severity_label FROM scored_fx")


@oracle("source_tab_rows", "mentions_fx", extra=[SCORED])
def _():
    return f"SELECT seq, company, source_platform, {_case_map('source_platform', lx.SECTION_KEYS, 'source_platform')} AS section_key FROM scored_fx"


def _view_sql(order: str) -> str:
    return f"SELECT company, source_platform, row_number() OVER (PARTITION BY company, source_platform ORDER BY {order}, seq) AS view_rank, seq FROM scored_fx"


ORACLE["view_recent"] = with_views(_view_sql("coalesce(date_raw, '') DESC"), "mentions_fx", extra=[SCORED])
for _k, (_r, _d), _c in [("view_negative", lx.RANK_MOST_NEGATIVE, "sentiment"), ("view_positive", lx.RANK_MOST_POSITIVE, "sentiment"),
                         ("view_severity", lx.RANK_SEVERITY, "coalesce(severity, 'low')")]:
    ORACLE[_k] = with_views(_view_sql(_case_map(_c, _r, str(_d))), "mentions_fx", extra=[SCORED])


@oracle("export_csv_rows", "mentions_fx", extra=[SCORED])
def _():
    e = lambda x: f"coalesce(CAST({x} AS VARCHAR), '')"
    return (f"SELECT seq, {e('source_platform')} AS source_platform, {e('source_url')} AS source_url, {e('sentiment')} AS sentiment, "
            f"{e('confidence')} AS confidence, {e('reviewer_type')} AS reviewer_type, {join_arr('themes', '; ')} AS themes, "
            f"{e('severity')} AS severity, {e('language_detected')} AS language, {e('date_raw')} AS date, md5({e('raw_text')}) AS raw_text_md5 "
            "FROM scored_fx")


# --------------------------------------------------------------------- dedup

@oracle("dedup_fingerprint", "docs_one_fx")
def _():
    return f"SELECT company, min(seq) AS seq FROM docs_one_fx GROUP BY company, {fp_sql('raw_text')}"


UNIT = ("unit_fx", """
SELECT company, seq, list_transform(v, lambda x: x / nrm) AS u FROM (
  SELECT company, seq, v, CASE WHEN sqrt(list_dot_product(v, v)) = 0 THEN 1.0 ELSE sqrt(list_dot_product(v, v)) END AS nrm
  FROM (SELECT company, seq, CAST(embedding AS DOUBLE[]) AS v FROM vectors_fx))
""")


def _edges(t: float):
    return ("edges_fx", f"SELECT a.company, a.seq AS a, b.seq AS b, list_dot_product(a.u, b.u) AS sim FROM unit_fx a JOIN unit_fx b "
                        f"ON a.company = b.company AND a.seq < b.seq WHERE list_dot_product(a.u, b.u) > {t}")


@oracle("near_dup_pairs", "vectors_fx", extra=[UNIT, _edges(0.35)])
def _():
    return "SELECT company, a, b, round(sim, 6) AS sim FROM edges_fx"


GREEDY = """
SELECT 'all' AS company, unnest(kept) AS seq FROM g WHERE rn = (SELECT max(rn) FROM nodes_fx)
"""


@oracle("dedup_semantic", "vectors_fx", extra=[UNIT, _edges(0.35)])
def _():
    return GREEDY


# greedy survivors by a sequential recursive walk (the reference rule, row by row)
ORACLE["dedup_semantic"] = with_views(GREEDY, "vectors_fx", extra=[
    UNIT, _edges(0.35),
    ("nodes_fx", "SELECT seq, row_number() OVER (ORDER BY seq) AS rn FROM unit_fx"),
]).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "\nSELECT 'all' AS company, unnest(kept)",
    """, g(rn, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT n.rn, CASE WHEN (SELECT count(*) FROM edges_fx e WHERE e.b = n.seq AND list_contains(g.kept, e.a)) > 0
                    THEN g.kept ELSE list_append(g.kept, n.seq) END
  FROM g JOIN nodes_fx n ON n.rn = g.rn + 1)
SELECT 'all' AS company, unnest(kept)""", 1)


# near duplicates from the texts: vectors, banded signatures, survivors
_SLOT = " UNION ALL ".join(
    f"SELECT company, seq, strpos('0123456789abcdef', substr(h, {2 * i + 1}, 1)) * 16 - 16 + strpos('0123456789abcdef', substr(h, {2 * i + 2}, 1)) - 1 AS dim, "
    f"CASE WHEN strpos('0123456789abcdef', substr(h, {2 * SIM.SLOTS + 1 + i}, 1)) <= 8 THEN v ELSE -v END AS v FROM weighed_fx"
    for i in range(SIM.SLOTS))
TEXT_CELLS = [
    ("words_fx", r"""SELECT company, seq, word, count(*) AS tf FROM (
  SELECT company, seq, unnest(regexp_extract_all(translate(coalesce(raw_text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x20\x09-\x0D]+')) AS word FROM docs_one_fx) GROUP BY ALL"""),
    ("weighed_fx", f"""SELECT company, seq, md5(word) AS h,
    tf * CAST(floor({SIM.IDF_SCALE} * ln((SELECT count(*) FROM docs_one_fx) / CAST(df AS DOUBLE) + 1.0)) AS BIGINT) AS v
    FROM words_fx JOIN (SELECT word, count(*) AS df FROM words_fx GROUP BY word) USING (word)"""),
    ("cells_fx", f"SELECT company, seq, CAST(dim AS INTEGER) AS dim, CAST(sum(v) AS BIGINT) AS value FROM ({_SLOT}) GROUP BY ALL HAVING sum(v) <> 0"),
]
_P = 2147483647
_T = lx.NEAR_DUP_THRESHOLD
SIGNED = [
    ("vec_fx", f"""SELECT company, seq, list(coalesce(value, 0) ORDER BY d.dim) AS e, max(abs(value)) AS top, sqrt(sum(CAST(value AS DOUBLE) * value)) AS nrm
    FROM (SELECT DISTINCT company, seq FROM cells_fx) CROSS JOIN (SELECT unnest(range({SIM.DIMS})) AS dim) d
    LEFT JOIN cells_fx c USING (company, seq, dim) GROUP BY company, seq"""),
    ("first_fx", "SELECT *, min(seq) OVER (PARTITION BY company, e) AS a FROM vec_fx"),
    ("reps_fx", "SELECT company, seq, e, nrm, top FROM first_fx WHERE seq = a"),
    ("q_fx", f"SELECT acos({_T}) / pi() AS q, greatest({SIM.MIN_BITS}, CAST(ceil(log2((SELECT count(*) FROM reps_fx) / {SIM.BUCKET_ROWS}.0)) AS BIGINT)) AS bits"),
    ("bands_fx", f"SELECT q, bits, CAST(ceil(ln(1 - {SIM.RECALL}) / ln(1 - pow(1 - q, bits))) AS BIGINT) AS bands FROM q_fx"),
    ("plan_fx", f"""SELECT *, CAST(floor(sketch * (q + {SIM.SKETCH_SIGMAS} * sqrt(q * (1 - q) / sketch))) AS BIGINT) AS far
    FROM (SELECT *, least({SIM.SKETCH_BITS}, bits * bands) AS sketch FROM bands_fx)"""),
    ("signs_fx", f"""SELECT plane, dim, ((x * x % {_P}) // 65536 % 2) * 2 - 1 AS sign FROM (
    SELECT plane, dim, y * y % {_P} * 48271 % {_P} AS x FROM (
      SELECT plane, dim, (plane * 1000003 + dim * 7919 + 17) % {_P} AS y
      FROM (SELECT unnest(range(bits * bands)) AS plane FROM plan_fx) CROSS JOIN (SELECT unnest(range({SIM.DIMS})) AS dim)))"""),
    ("steps_fx", f"""SELECT company, seq, dim, CAST(floor(CAST(value AS DOUBLE) / top * {SIM.STEPS}) AS BIGINT) AS value
    FROM cells_fx JOIN reps_fx USING (company, seq)"""),
    ("on_fx", "SELECT company, seq, plane, sum(value * sign) >= 0 AS bit FROM steps_fx JOIN signs_fx USING (dim) GROUP BY ALL"),
    ("keys_fx", """SELECT company, seq, plane // bits AS band, CAST(sum(CASE WHEN bit THEN 1 << CAST(plane % bits AS INTEGER) ELSE 0 END) AS BIGINT) AS key
    FROM on_fx, plan_fx GROUP BY ALL"""),
    ("met_fx", "SELECT DISTINCT x.company, x.seq AS a, y.seq AS b FROM keys_fx x JOIN keys_fx y USING (company, band, key) WHERE x.seq < y.seq"),
    ("sketch_fx", "SELECT company, seq, list(bit ORDER BY plane) AS bits FROM on_fx WHERE plane < (SELECT sketch FROM plan_fx) GROUP BY ALL"),
    ("near_fx", """SELECT m.company, a, b FROM met_fx m JOIN sketch_fx x ON x.company = m.company AND x.seq = a
    JOIN sketch_fx y ON y.company = m.company AND y.seq = b
    WHERE len(list_filter(list_zip(x.bits, y.bits), lambda z: z[1] <> z[2])) <= (SELECT far FROM plan_fx)"""),
    ("edges_fx", f"""SELECT * FROM (SELECT n.company, a, b, list_dot_product(CAST(x.e AS DOUBLE[]), CAST(y.e AS DOUBLE[])) / (x.nrm * y.nrm) AS sim
    FROM near_fx n JOIN reps_fx x ON x.company = n.company AND x.seq = a JOIN reps_fx y ON y.company = n.company AND y.seq = b) WHERE sim > {_T}"""),
]


@oracle("text_vectors", "docs_one_fx", extra=TEXT_CELLS)
def _():
    return "SELECT company, seq, dim, value FROM cells_fx"


@oracle("near_dup_candidates", "docs_one_fx", extra=TEXT_CELLS + SIGNED)
def _():
    return ("SELECT company, a, b, 'link' AS kind, round(sim, 6) AS sim FROM edges_fx UNION ALL "
            "SELECT company, a, seq, 'copy', 1.0 FROM first_fx WHERE seq <> a")


ORACLE["dedup_text"] = with_views(
    """, g(rn, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT n.rn, CASE WHEN (SELECT count(*) FROM edge_list e WHERE e.b = n.seq AND list_contains(g.kept, e.a)) > 0
                    THEN g.kept ELSE list_append(g.kept, n.seq) END
  FROM g JOIN nodes_fx n ON n.rn = g.rn + 1)
SELECT company, seq FROM docs_one_fx WHERE seq NOT IN (SELECT seq FROM vec_fx)
   OR seq IN (SELECT unnest(kept) FROM g WHERE rn = (SELECT max(rn) FROM nodes_fx))""",
    "docs_one_fx", extra=TEXT_CELLS + SIGNED + [
        ("nodes_fx", "SELECT seq, row_number() OVER (ORDER BY seq) AS rn FROM reps_fx"),
        ("edge_list", "SELECT a, b FROM edges_fx")]).replace("WITH ", "WITH RECURSIVE ", 1)
for _k in ("near_dup_candidates", "dedup_text"):
    for _v in ("weighed_fx", "cells_fx", "vec_fx", "first_fx", "plan_fx", "on_fx", "keys_fx", "near_fx", "nodes_fx", "edge_list"):
        ORACLE[_k] = ORACLE[_k].replace(f"{_v} AS (", f"{_v} AS MATERIALIZED (", 1)


# ---------------------------------------------------------------------- caps

@oracle("capped_mentions", "mentions_fx")
def _():
    cap = _case_map("source_platform", lx.PLATFORM_CAPS, "NULL")
    return (f"SELECT company, source_platform, seq, cap_rank FROM (SELECT *, row_number() OVER (PARTITION BY company, source_platform "
            f"ORDER BY seq) AS cap_rank FROM mentions_fx) WHERE ({cap}) IS NULL OR cap_rank <= ({cap})")


THREADS = ("threads_fx", f"""
SELECT p.company, p.conv_id AS seq, CAST(coalesce(c.n, 0) AS BIGINT) AS n_comments
FROM forum_posts_fx p LEFT JOIN (
  SELECT conv_id, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM forum_comments_fx)
  WHERE k <= {lx.FORUM_COMMENTS_PER_POST} AND coalesce(body, '') NOT IN ('', '[deleted]', '[removed]') GROUP BY conv_id) c USING (conv_id)
""")


def _threads_sql(cap: int) -> str:
    return f"""
    SELECT company, seq, n_comments, rows_before FROM (
      SELECT *, CAST(coalesce(sum(1 + n_comments) OVER (PARTITION BY company ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rows_before
      FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY seq) AS r FROM threads_fx) WHERE r <= {cap})
    WHERE rows_before < {cap}"""


ORACLE["capped_threads"] = with_views(_threads_sql(lx.FORUM_SOFT_CAP), "forum_comments_fx", extra=[THREADS])
ORACLE["capped_threads_10"] = with_views(_threads_sql(10), "forum_comments_fx", extra=[THREADS])


@oracle("source_cascade", "mentions_fx", extra=[("tm", "SELECT 'Group ' || CAST((seq // 8) % 2 AS VARCHAR) AS company, source_platform, seq, CAST((seq * 7) % 3 AS INTEGER) AS tier FROM mentions_fx")])
def _():
    t = "CAST((seq * 7) % 3 AS INTEGER)"
    return f"""
    SELECT company, source_platform, seq, tier FROM tm WHERE source_platform = 'web'
      AND tier = (SELECT min(tier) FROM tm t2 WHERE t2.company = tm.company AND t2.source_platform = 'web')
    UNION ALL
    SELECT company, source_platform, seq, tier FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY tier, seq) AS r FROM tm
      WHERE source_platform = 'news') WHERE r <= {lx.PLATFORM_CAPS['news']}
    UNION ALL
    SELECT company, source_platform, seq, tier FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY tier, seq) AS r FROM tm
      WHERE source_platform = 'glassdoor') WHERE r <= {lx.PLATFORM_CAPS['glassdoor']}"""


# ----------------------------------------------------------------- snapshots

LATEST = ("latest_fx", """
SELECT company, source, cached_at, payload, seq FROM (
  SELECT lower(company) AS company, lower(source) AS source, cached_at, payload, seq,
         row_number() OVER (PARTITION BY lower(company), lower(source) ORDER BY cached_at DESC, seq DESC) AS r
  FROM snapshots_fx) WHERE r = 1
""")
AGE = f"((epoch_us(TIMESTAMP '{fx.AS_OF}') - epoch_us(cached_at)) / 1000000.0)"


@oracle("snapshot_latest", "snapshots_fx", extra=[LATEST])
def _():
    return "SELECT * FROM latest_fx"


@oracle("snapshot_upsert", "snapshots_fx", extra=[LATEST])
def _():
    return "SELECT * FROM latest_fx"


@oracle("snapshot_fresh", "snapshots_fx", extra=[LATEST])
def _():
    return f"SELECT * FROM latest_fx WHERE {AGE} <= {lx.SNAPSHOT_TTL_SECONDS}"


@oracle("snapshot_age", "snapshots_fx", extra=[LATEST])
def _():
    h = f"CAST(floor({AGE} / 3600) AS BIGINT)"
    m = f"CAST(floor(({AGE} - floor({AGE} / 3600) * 3600) / 60) AS BIGINT)"
    return (f"SELECT company, source, CASE WHEN {h} > 0 THEN CAST({h} AS VARCHAR) || 'h ' || CAST({m} AS VARCHAR) || 'm ago' "
            f"ELSE CAST({m} AS VARCHAR) || 'm ago' END AS age_text FROM latest_fx")


@oracle("snapshot_clear", "snapshots_fx")
def _():
    return ("SELECT company, source, seq FROM snapshots_fx s WHERE lower(company) NOT IN ("
            "SELECT lower(upper(x.company)) FROM snapshots_fx x JOIN events e ON e.event_id = x.seq "
            "WHERE e.event_type = 'error' AND e.value > 300)")


@oracle("fetch_plan", "snapshots_fx", extra=[LATEST])
def _():
    srcs = ", ".join(f"({q(x)})" for x in fx.SNAPSHOT_SOURCES)
    return (f"SELECT c.company, s.source, CASE WHEN f.company IS NOT NULL THEN 'cached' ELSE 'fetch' END AS action "
            f"FROM (SELECT DISTINCT company FROM snapshots_fx) c CROSS JOIN (VALUES {srcs}) s(source) "
            f"LEFT JOIN (SELECT * FROM latest_fx WHERE {AGE} <= {lx.SNAPSHOT_TTL_SECONDS}) f "
            "ON f.company = lower(c.company) AND f.source = lower(s.source)")


@oracle("usage_totals", "usage_fx")
def _():
    return ("SELECT provider, model, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(calls_made), 0) AS BIGINT) AS calls "
            "FROM usage_fx GROUP BY ALL UNION ALL SELECT '*', '*', CAST(coalesce(sum(tokens_used), 0) AS BIGINT), "
            "CAST(coalesce(sum(calls_made), 0) AS BIGINT) FROM usage_fx")


ORACLE["usage_ledger"] = ORACLE["usage_totals"]
ORACLE["snapshot_store"] = ORACLE["snapshot_fresh"].replace("FROM snapshots_fx)", "FROM snapshots_fx WHERE coalesce(payload, '') NOT IN ('', '[]'))")


@oracle("cached_reports", "usage_fx")
def _():
    return f"""SELECT company, model AS model_used, tokens, kinds FROM (
      SELECT *, row_number() OVER (PARTITION BY company ORDER BY cached_at DESC, tokens DESC) AS r FROM (
        SELECT lower(company) AS company, model, CAST(sum(tokens_used) AS BIGINT) AS tokens, count(DISTINCT provider) AS kinds, max(run_at) AS cached_at
        FROM usage_fx GROUP BY ALL)) WHERE r = 1 AND {AGE} <= {lx.SNAPSHOT_TTL_SECONDS}"""


# ------------------------------------------------------------------- sources

from renown.plans.catalog import AS_OF_FORUM  # noqa: E402


def _safe(t: str) -> str:
    return safe_text_sql(t)


_CUTOFF = f"(TIMESTAMP '{AS_OF_FORUM}' - INTERVAL {lx.MAX_POST_AGE_DAYS} DAY)"
KEPT_COMMENTS = ("kept_comments_fx", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM forum_comments_fx)
WHERE k <= {lx.FORUM_COMMENTS_PER_POST} AND coalesce(body, '') NOT IN ('', '[deleted]', '[removed]')""")
# a post is taken while the posts and comments taken before it are below the soft cap
TAKEN = ("taken_posts_fx", f"""
SELECT * FROM (
  SELECT p.*, coalesce(sum(1 + coalesce(c.n, 0)) OVER (PARTITION BY p.company ORDER BY p.conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM forum_posts_fx p LEFT JOIN (SELECT conv_id, count(*) AS n FROM kept_comments_fx GROUP BY conv_id) c ON c.conv_id = p.conv_id
  WHERE make_timestamp(CAST(p.created_utc * 1000000 AS BIGINT)) >= {_CUTOFF})
WHERE before < {lx.FORUM_SOFT_CAP}""")


@oracle("src_forum_posts", "forum_posts_fx", "forum_comments_fx", extra=[KEPT_COMMENTS, TAKEN])
def _():
    text = "CASE WHEN coalesce(selftext, '') <> '' THEN coalesce(title, '') || chr(10) || chr(10) || selftext ELSE coalesce(title, '') END"
    return f"""
    SELECT company, conv_id, CAST(0 AS INTEGER) AS post_pos, 'https://reddit.com' || permalink AS source_url,
      md5({_safe(text)}) AS text_md5, length({_safe(text)}) AS text_len,
      strftime(make_timestamp(CAST(created_utc * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS date_raw,
      score, num_comments, subreddit
    FROM taken_posts_fx"""


@oracle("src_forum_comments", "forum_posts_fx", "forum_comments_fx", extra=[KEPT_COMMENTS, TAKEN])
def _():
    return f"""
    SELECT c.company, c.conv_id, CAST(k - 1 AS INTEGER) AS comment_pos,
      CASE WHEN coalesce(c.permalink, '') <> '' THEN 'https://reddit.com' || c.permalink ELSE '' END AS source_url,
      md5({_safe('c.body')}) AS text_md5,
      strftime(make_timestamp(CAST(c.created_utc * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS date_raw, c.score,
      coalesce(t.title, '') AS parent_post, 'general' AS reviewer_type
    FROM kept_comments_fx c JOIN taken_posts_fx t ON t.conv_id = c.conv_id"""


WEB_ROWS = ("web_fx", f"""
SELECT {company_name('(doc_id // 5) % ' + str(fx.N_COMPANIES))} AS company, doc_id // 5 AS grp,
  CAST(row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) - 1 AS INTEGER) AS result_pos,
  'https://web' || CAST(doc_id AS VARCHAR) || '.lk/r' AS source_url, substring(text, 1, 30) AS title, text,
  CASE WHEN (doc_id // 5) % 2 = 0 THEN CAST(doc_id % 100 AS DOUBLE) / 100.0 END AS score,
  CASE WHEN (doc_id // 5) % 2 = 1 THEN CAST(doc_id % 5 + 1 AS INTEGER) END AS position,
  CASE WHEN (doc_id // 5) % 2 = 0 THEN 'engine_a' ELSE 'engine_b' END AS search_engine
FROM documents
""")


@oracle("src_web_results", extra=[WEB_ROWS])
def _():
    t = "coalesce(title, '') || chr(10) || chr(10) || coalesce(text, '')"
    return f"SELECT company, grp, result_pos, source_url, md5({_safe(t)}) AS text_md5, coalesce(title, '') AS title, score, coalesce(position, 0) AS position, search_engine FROM web_fx"


@oracle("html_element_counts")
def _():
    void = ", ".join(q(t) for t in sorted(VOID))
    # comments go first, then the insides of raw-text elements, then every start tag is read
    bare = r"regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '(<(script|style)\b[^>]*>).*?(</(script|style)\s*>)', '\1\3', 'gis')"
    return rf"""
    SELECT page_id, tag, count(*) AS n, count(*) FILTER (WHERE regexp_matches(opening, '\sclass\s*=', 'i')) AS n_class FROM (
      SELECT page_id, opening, lower(regexp_extract(opening, '<([a-zA-Z][^\s/>]*)', 1)) AS tag
      FROM (SELECT page_id, unnest(regexp_extract_all({bare}, '<[a-zA-Z][^>]*>')) AS opening FROM pages))
    WHERE tag NOT IN ({void}) GROUP BY page_id, tag"""


@oracle("html_elements")
def _():
    return (f"SELECT page_id, CAST(generate_subscripts(ads, 1) AS BIGINT) AS ad_index, {py_strip('unnest(ads)')} AS text FROM ("
            "SELECT page_id, regexp_extract_all(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) AS ads FROM pages)")


@oracle("src_job_cards")
def _():
    from renown.plans.oracle_sql import any_contains
    t = "txt"
    return f"""
    SELECT page_id, card_rank, 'https://ikman.lk' AS source_url, {_safe(t)} AS raw_text,
      CASE WHEN regexp_matches({t}, {q(__import__('renown.functions.text', fromlist=['x']).SALARY_RX)})
           THEN regexp_extract({t}, {q(__import__('renown.functions.text', fromlist=['x']).SALARY_RX)}, 0) END AS salary_info
    FROM (SELECT page_id, CAST(generate_subscripts(ads, 1) AS INTEGER) AS card_rank, {py_strip('unnest(ads)')} AS txt
          FROM (SELECT page_id, regexp_extract_all(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) AS ads FROM pages))
    WHERE card_rank <= 30 AND length(txt) >= 10 AND NOT {any_contains(t, lx.JOB_CARD_IGNORE_B)}"""


# ------------------------------------------------------------- page sources

PAGES_FX = ("pg", f"""
SELECT page_id AS k, url, {company_name('page_id % ' + str(fx.N_COMPANIES))} AS company,
  ({arr(lx.NEWS_SITES)})[page_id % 9 + 1] AS site, ({arr(lx.NEWS_SITES)})[(page_id + 4) % 9 + 1] AS site2,
  (page_id + 4) % 9 AS site2_ord
FROM pages
""")


def _f(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


@oracle("src_map_listing", extra=[PAGES_FX])
def _():
    star = "CASE WHEN k % 6 <> 0 THEN CAST(CAST(k % 5 + 1 AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR) AS DOUBLE) ELSE CAST(k % 5 + 1 AS DOUBLE) END"
    rc = "CASE WHEN k % 6 <> 0 THEN CAST(k * 13 AS INTEGER) ELSE 0 END"
    return (f"SELECT k AS page_id, company, company || ' on Google Maps: ' || CAST({star} AS VARCHAR) || ' stars, ' || "
            f"CAST({rc} AS VARCHAR) || ' reviews' AS raw_text, {star} AS rating, {rc} AS review_count FROM pg")


@oracle("src_map_reviews", extra=[PAGES_FX])
def _():
    return ("SELECT k AS page_id, 0 AS review_index, 'First review of page ' || CAST(k AS VARCHAR) || ' by a visitor' AS raw_text, "
            "CAST(k % 5 + 1 AS DOUBLE) AS rating FROM pg UNION ALL "
            "SELECT k, 1, 'Second review ' || CAST(k AS VARCHAR), CAST(NULL AS DOUBLE) FROM pg")


@oracle("src_employee_reviews", extra=[PAGES_FX])
def _():
    r = "CAST(k % 5 AS DOUBLE) + 0.5"
    return (f"SELECT k AS page_id, 1 AS cascade_rank, 0 AS tier, 'Pros: friendly team ' || CAST(k AS VARCHAR) || chr(10) || 'Cons: slow promotions' AS raw_text, "
            f"{r} AS rating, 'friendly team ' || CAST(k AS VARCHAR) AS pros, 'slow promotions' AS cons, 'glassdoor' AS source_site FROM pg UNION ALL "
            f"SELECT k, 2, 0, 'Indeed review ' || CAST(k AS VARCHAR) || ' without markers', {r}, '', '', 'glassdoor' FROM pg UNION ALL "
            "SELECT k, 3, 1, 'Indeed review ' || CAST(k AS VARCHAR) || ' without markers', NULL, NULL, NULL, 'indeed' FROM pg")


@oracle("src_job_listings", extra=[PAGES_FX])
def _():
    li = f"'Engineer at ' || company || ' paying Rs. ' || {_f('k * 100')} || ' - ' || {_f('k * 150')}"
    prof = f"company || ' | ' || {_f('k * 3')} || ' followers | ' || CAST(k % 50 AS VARCHAR) || '-' || CAST(k % 50 + 10 AS VARCHAR) || ' employees'"
    return (f"SELECT k AS page_id, 1 AS item_rank, {li} AS raw_text, 'Rs. ' || {_f('k * 100')} || ' - ' || {_f('k * 150')} AS salary_info FROM pg UNION ALL "
            f"SELECT k, 2, {prof}, NULL FROM pg UNION ALL "
            "SELECT k, 3, 'Headline ' || CAST(k AS VARCHAR) || ' about ' || company, NULL FROM pg")


@oracle("src_job_cards_c", extra=[PAGES_FX])
def _():
    li = f"'Engineer at ' || company || ' paying Rs. ' || {_f('k * 100')} || ' - ' || {_f('k * 150')}"
    return (f"SELECT k AS page_id, 1 AS item_rank, {li} AS raw_text FROM pg UNION ALL "
            "SELECT k, 2, 'Vacancy ' || CAST(k AS VARCHAR) || ' open now' FROM pg")


@oracle("src_careers_link", extra=[PAGES_FX])
def _():
    return ("SELECT k AS page_id, CASE WHEN k % 3 = 0 THEN 'https://boards.greenhouse.io/co' || CAST(k AS VARCHAR) "
            "ELSE 'https://jobs.example.com/' || CAST(k AS VARCHAR) || '/all' END AS careers_url FROM pg")


@oracle("src_profiles", extra=[PAGES_FX])
def _():
    prof = f"company || ' | ' || {_f('k * 3')} || ' followers | ' || CAST(k % 50 AS VARCHAR) || '-' || CAST(k % 50 + 10 AS VARCHAR) || ' employees'"
    return (f"SELECT k AS page_id, 0 AS tier, 1 AS item_rank, 'https://www.linkedin.com/company/co-' || CAST(k % 40 AS VARCHAR) AS source_url, "
            f"{prof} AS raw_text, {_f('k * 3')} AS followers, CAST(k % 50 AS VARCHAR) || '-' || CAST(k % 50 + 10 AS VARCHAR) AS employees FROM pg "
            "UNION ALL SELECT k, 1, 1, '', 'Entity result card for page ' || CAST(k AS VARCHAR), NULL, NULL FROM pg")


@oracle("src_social_pages", extra=[PAGES_FX])
def _():
    return ("SELECT k AS page_id, 1 AS item_rank, 'https://www.facebook.com/page' || CAST(k % 30 AS VARCHAR) AS source_url, "
            "'Page ' || CAST(k % 30 AS VARCHAR) || ' has ' || CAST(k % 9 AS VARCHAR) || '.5K likes and ' || CAST(k % 5 AS VARCHAR) || '.5 out of 5' AS raw_text, "
            "CAST(k % 5 AS DOUBLE) + 0.5 AS rating, CAST(k % 9 AS VARCHAR) || '.5K' AS likes FROM pg")


@oracle("src_news_articles", extra=[PAGES_FX])
def _():
    return ("SELECT k AS page_id, 1 AS item_rank, '' AS source_url, 'Entity result card for page ' || CAST(k AS VARCHAR) AS raw_text, "
            "NULL AS date_raw, '' AS headline, 'unknown' AS source_site FROM pg UNION ALL "
            "SELECT k, 2, 'https://www.' || site || '/news/' || CAST(k AS VARCHAR), "
            "'Headline ' || CAST(k AS VARCHAR) || ' about ' || company || chr(10) || chr(10) || 'Snippet text ' || CAST(k AS VARCHAR), "
            "CAST(k % 24 AS VARCHAR) || ' hours ago', 'Headline ' || CAST(k AS VARCHAR) || ' about ' || company, site FROM pg")


@oracle("src_news_links", extra=[PAGES_FX])
def _():
    cap = lx.PLATFORM_CAPS["news"]
    return f"""
    SELECT company, page_id, cascade_rank, tier, source_url, headline, source_site FROM (
      SELECT *, row_number() OVER (PARTITION BY company ORDER BY tier, site_ord, page_id, pos) AS cascade_rank FROM (
        SELECT company, k AS page_id, 0 AS tier, -1 AS site_ord, 1 AS pos, '' AS source_url, '' AS headline, 'unknown' AS source_site FROM pg
        UNION ALL SELECT company, k, 0, -1, 2, 'https://www.' || site || '/news/' || CAST(k AS VARCHAR), 'Headline ' || CAST(k AS VARCHAR) || ' about ' || company, site FROM pg
        UNION ALL
        SELECT company, k, 1, site2_ord, 1, 'https://www.' || site2 || '/story/' || CAST(k AS VARCHAR), 'Story number ' || CAST(k AS VARCHAR) || ' in the paper', site2
        FROM pg p WHERE site2_ord < 5 AND {cap} >
          (SELECT 2 * count(*) + count(*) FILTER (WHERE o.site2_ord < p.site2_ord) FROM pg o WHERE o.company = p.company)))
    WHERE cascade_rank <= {cap}"""


@oracle("src_web_html", extra=[PAGES_FX])
def _():
    url = "'https://shop' || CAST(k % 7 AS VARCHAR) || CASE WHEN k % 2 = 1 THEN '.lk' ELSE '.com' END || '/r/' || CAST(k AS VARCHAR)"
    snip = "'Snippet for result ' || CAST(k AS VARCHAR) || CASE WHEN k % 4 = 0 THEN ' colombo' ELSE '' END"
    return (f"SELECT k AS page_id, {url} AS source_url, 'Result title ' || CAST(k AS VARCHAR) || chr(10) || chr(10) || {snip} AS raw_text, "
            "'Result title ' || CAST(k AS VARCHAR) AS title FROM pg WHERE k % 2 = 1 OR k % 4 = 0")


# ------------------------------------------------------------ report lines

def _latin1_sql(t: str) -> str:
    x = t
    for old, new in lx.LATIN1_REPLACEMENTS:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return f"regexp_replace({x}, '[^\\x{{0}}-\\x{{FF}}]', '?', 'g')"


def _report_lines_sql() -> str:
    d = lx.REPORT_SUMMARY_DEFAULTS
    plat_ord = _case_map("source_platform", {p: i for i, p in enumerate(lx.PLATFORMS)}, "NULL")
    plat_name = _case_map("source_platform", lx.SECTION_NAMES, "NULL")
    score = "coalesce(s.overall_score, c.rule_score)"
    head = [
        "SELECT company, 0 AS section_ord, 0 AS item_ord, 'Company Reputation Report' AS text FROM card",
        "SELECT company, 1, 0, 'Company: ' || company FROM card",
        f"SELECT company, 2, 0, 'Generated: ' || {q(fx.AS_OF.replace(' ', 'T'))} FROM card",
        "SELECT company, 3, 0, 'Model: external' FROM card",
        "SELECT company, 4, 0, 'Total Results: ' || CAST(total_results AS VARCHAR) FROM card",
        "SELECT company, 5, 0, 'Overall Score: ' || CAST(score AS VARCHAR) || '/100' FROM card",
        "SELECT company, 6, 0, 'What Employees Say:' FROM card",
        f"SELECT company, 6, 1, coalesce(what_employees_say, {q(d['what_employees_say'])}) FROM card",
        "SELECT company, 7, 0, 'What Customers Say:' FROM card",
        f"SELECT company, 7, 1, coalesce(what_customers_say, {q(d['what_customers_say'])}) FROM card",
        "SELECT company, 8, 0, 'What Press Says:' FROM card",
        f"SELECT company, 8, 1, coalesce(what_press_says, {q(d['what_press_says'])}) FROM card",
        "SELECT company, 9, 0, 'Top Pros:' FROM card",
        "SELECT company, 9, CAST(generate_subscripts(pros, 1) AS INTEGER), '  + ' || unnest(pros) FROM card",
        "SELECT company, 10, 0, 'Top Cons:' FROM card",
        "SELECT company, 10, CAST(generate_subscripts(cons, 1) AS INTEGER), '  - ' || unnest(cons) FROM card",
        "SELECT company, 11, 0, 'CRISIS FLAGS:' FROM card WHERE len(flags) > 0",
        "SELECT company, 11, CAST(generate_subscripts(flags, 1) AS INTEGER), '  ! ' || unnest(flags) FROM card",
        "SELECT company, 12, 0, 'Recommendation:' FROM card",
        f"SELECT company, 12, 1, coalesce(recommendation, {q(d['recommendation'])}) FROM card",
        "SELECT company, 13, 0, 'Results by Source & Links' FROM card",
        "SELECT company, 20 + ord, 0, name || ': ' || CAST(n AS VARCHAR) || ' results' FROM src",
        "SELECT company, 20 + ord, 1, '  Positive: ' || CAST(pos AS VARCHAR) || ' | Neutral: ' || CAST(neu AS VARCHAR) || "
        "' | Negative: ' || CAST(neg AS VARCHAR) FROM src WHERE source_platform <> 'topjobs'",
        "SELECT company, 20 + ord, CAST(generate_subscripts(urls, 1) + 1 AS INTEGER), '  ' || unnest(urls) FROM src",
    ]
    card = f"""
      SELECT c.company, c.total_results, {score} AS score, s.what_employees_say, s.what_customers_say, s.what_press_says,
             s.recommendation, coalesce(s.top_5_pros, []) AS pros, coalesce(s.top_5_cons, []) AS cons,
             coalesce(f.crisis_flags, []) AS flags
      FROM (SELECT company, count(*) AS total_results,
              {score_sql('count(*)', "count_if(sentiment = 'positive')", "count_if(sentiment = 'negative')", 'count_if(len(crisis_flags) > 0)')} AS rule_score
            FROM scored_fx GROUP BY company) c
      LEFT JOIN summary_parsed_fx s USING (company) LEFT JOIN flags_fx f USING (company)"""
    src = f"""
      SELECT company, source_platform, {plat_ord} AS ord, {plat_name} AS name, count(*) AS n,
             count_if(sentiment = 'positive') AS pos, count_if(sentiment = 'neutral') AS neu, count_if(sentiment = 'negative') AS neg,
             list(DISTINCT source_url) FILTER (WHERE starts_with(coalesce(source_url, ''), 'http')) AS _u
      FROM scored_fx GROUP BY company, source_platform"""
    src2 = f"""
      SELECT s.*, coalesce(u.urls, []) AS urls FROM ({src}) s LEFT JOIN (
        SELECT company, source_platform, list(source_url ORDER BY first_seq) AS urls FROM (
          SELECT company, source_platform, source_url, min(seq) AS first_seq FROM scored_fx
          WHERE starts_with(coalesce(source_url, ''), 'http') GROUP BY ALL) GROUP BY ALL) u USING (company, source_platform)"""
    body = " UNION ALL ".join(head)
    return with_views(f"SELECT company, section_ord, item_ord, {_latin1_sql('text')} AS text FROM ({body})",
                      "mentions_fx", extra=[SCORED, SUMMARY_RESP, SUMMARY_PARSED, FLAGS, ("card", card), ("src", src2)])


ORACLE["export_report_lines"] = _report_lines_sql()



@oracle("cache_hits", "snapshots_fx", extra=[LATEST])
def _():
    srcs = ", ".join(f"({q(x)})" for x in fx.SNAPSHOT_SOURCES)
    return f"""
    SELECT company, CAST(count_if(action = 'cached') AS BIGINT) AS cached, CAST(count_if(action = 'fetch') AS BIGINT) AS to_fetch,
      round(count_if(action = 'cached') / count(*), 6) AS hit_ratio FROM (
      SELECT c.company, CASE WHEN f.company IS NOT NULL THEN 'cached' ELSE 'fetch' END AS action
      FROM (SELECT DISTINCT company FROM snapshots_fx) c CROSS JOIN (VALUES {srcs}) s(source)
      LEFT JOIN (SELECT * FROM latest_fx WHERE {AGE} <= {lx.SNAPSHOT_TTL_SECONDS}) f
        ON f.company = lower(c.company) AND f.source = lower(s.source)) GROUP BY company"""



@oracle("all_mentions", "forum_posts_fx", "forum_comments_fx", extra=[KEPT_COMMENTS, TAKEN, WEB_ROWS])
def _():
    post_text = "CASE WHEN coalesce(selftext, '') <> '' THEN coalesce(title, '') || chr(10) || chr(10) || selftext ELSE coalesce(title, '') END"
    web_text = "coalesce(title, '') || chr(10) || chr(10) || coalesce(text, '')"
    return f"""
    SELECT company, 'reddit' AS source_platform, 0 AS platform_ord, CAST(conv_id AS BIGINT) AS position, 0 AS item,
      'https://reddit.com' || permalink AS source_url, md5({_safe(post_text)}) AS text_md5
    FROM taken_posts_fx
    UNION ALL
    SELECT company, 'reddit', 0, CAST(conv_id AS BIGINT), CAST(k AS INTEGER),
      CASE WHEN coalesce(permalink, '') <> '' THEN 'https://reddit.com' || permalink ELSE '' END, md5({_safe('body')})
    FROM kept_comments_fx WHERE conv_id IN (SELECT conv_id FROM taken_posts_fx)
    UNION ALL
    SELECT company, 'web', 7, CAST(grp AS BIGINT), CAST(result_pos AS INTEGER), source_url, md5({_safe(web_text)})
    FROM web_fx"""


@oracle("src_web_cascade", extra=[WEB_ROWS, PAGES_FX])
def _():
    url = "'https://shop' || CAST(k % 7 AS VARCHAR) || CASE WHEN k % 2 = 1 THEN '.lk' ELSE '.com' END || '/r/' || CAST(k AS VARCHAR)"
    return f"""
    SELECT company, tier, seq, source_url, web_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY company ORDER BY tier, seq) AS web_rank FROM (
        SELECT * FROM (
          SELECT *, min(tier) OVER (PARTITION BY company) AS mt FROM (
            SELECT company, CASE WHEN search_engine = 'engine_a' THEN 0 ELSE 1 END AS tier, grp * 10 + result_pos AS seq, source_url FROM web_fx
            UNION ALL
            SELECT company, 2, k, {url} FROM pg WHERE k % 2 = 1 OR k % 4 = 0))
        WHERE tier = mt))
    WHERE web_rank <= {lx.PLATFORM_CAPS['web']}"""


# ------------------------------------------------------------- end-to-end run

def _canon_sql() -> str:
    """The eight platforms' rows, written from the rules of the landed payloads."""
    v = lambda x: f"CAST({x} AS VARCHAR)"
    cols = ("company", "source_platform", "position", "item", "source_url", "raw_text", "date_raw", "rating", "m_type",
            "m_pros", "m_salary_info", "m_followers", "m_likes", "m_headline", "m_title", "m_parent_post")
    parts = []

    def add(src, company="company", url="url", **c):
        c = {"company": company, "source_url": url, **c}
        parts.append("SELECT " + ", ".join(f"{c.get(k, 'NULL')} AS {k}" for k in cols) + f" FROM {src}")

    iso = lambda x: f"strftime(make_timestamp(CAST({x} * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S')"
    post = "CASE WHEN coalesce(selftext, '') <> '' THEN coalesce(title, '') || chr(10) || chr(10) || selftext ELSE coalesce(title, '') END"
    add("taken_posts_fx", source_platform="'reddit'", position="conv_id", item="0", url="'https://reddit.com' || permalink", raw_text=_safe(post),
        date_raw=iso("created_utc"), m_type="'post'")
    add("kept_comments_fx c JOIN taken_posts_fx t ON t.conv_id = c.conv_id", "c.company", source_platform="'reddit'", position="c.conv_id", item="k",
        url="CASE WHEN coalesce(c.permalink, '') <> '' THEN 'https://reddit.com' || c.permalink ELSE '' END", raw_text=_safe("c.body"),
        date_raw=iso("c.created_utc"), m_type="'comment'", m_parent_post="coalesce(t.title, '')")
    star = f"CASE WHEN k % 6 <> 0 THEN CAST({v('k % 5 + 1')} || '.' || {v('k % 10')} AS DOUBLE) ELSE CAST(k % 5 + 1 AS DOUBLE) END"
    count = "CASE WHEN k % 6 <> 0 THEN CAST(k * 13 AS INTEGER) ELSE 0 END"
    add("pg", source_platform="'google_maps'", position="k", item="0", rating=star, m_type="'business_listing'",
        raw_text=f"company || ' on Google Maps: ' || {v(star)} || ' stars, ' || {v(count)} || ' reviews'")
    for i, text, rating in ((1, f"'First review of page ' || {v('k')} || ' by a visitor'", "CAST(k % 5 + 1 AS DOUBLE)"), (2, f"'Second review ' || {v('k')}", "NULL")):
        add("pg", source_platform="'google_maps'", position="k", item=str(i), rating=rating, m_type="'review'", raw_text=text)
    half = "CAST(k % 5 AS DOUBLE) + 0.5"
    indeed = f"'Indeed review ' || {v('k')} || ' without markers'"
    for i, text, rating, pros in ((1, f"'Pros: friendly team ' || {v('k')} || chr(10) || 'Cons: slow promotions'", half, f"'friendly team ' || {v('k')}"),
                                  (2, indeed, half, "''"), (3, indeed, "NULL", "NULL")):
        add("pg", source_platform="'glassdoor'", position="k", item=str(i), rating=rating, m_type="'employee_review'", raw_text=text, m_pros=pros)
    pay = f"'Rs. ' || {_f('k * 100')} || ' - ' || {_f('k * 150')}"
    job = f"'Engineer at ' || company || ' paying ' || {pay}"
    profile = f"company || ' | ' || {_f('k * 3')} || ' followers | ' || {v('k % 50')} || '-' || {v('k % 50 + 10')} || ' employees'"
    head = f"'Headline ' || {v('k')} || ' about ' || company"
    for i, text, salary in ((1, job, pay), (2, profile, "NULL"), (3, head, "NULL")):
        add("pg", url="'https://www.topjobs.lk'", source_platform="'topjobs'", position="k", item=str(i), m_type="'job_listing'", raw_text=text, m_salary_info=salary)
    add("(SELECT * FROM cards_fx JOIN pg ON pg.k = cards_fx.page_id)", url="cards_fx_url", source_platform="'topjobs'", position="k",
        item="card_rank + 100", m_type="'job_listing'", raw_text="card_text", m_salary_info="card_salary")
    for i, text in ((201, job), (202, f"'Vacancy ' || {v('k')} || ' open now'")):
        add("pg", url="'https://www.jobsnet.lk'", source_platform="'topjobs'", position="k", item=str(i), m_type="'job_listing'", raw_text=text)
    card = f"'Entity result card for page ' || {v('k')}"
    add("pg", url=f"'https://www.linkedin.com/company/co-' || {v('k % 40')}", source_platform="'linkedin'", position="k", item="1", m_type="'company_profile'",
        raw_text=profile, m_followers=_f("k * 3"))
    add("pg", url="''", source_platform="'linkedin'", position="k", item="101", m_type="'search_result'", raw_text=card)
    add("pg", url=f"'https://www.facebook.com/page' || {v('k % 30')}", source_platform="'facebook'", position="k", item="1", rating=half, m_type="'page_info'",
        raw_text=f"'Page ' || {v('k % 30')} || ' has ' || {v('k % 9')} || '.5K likes and ' || {v('k % 5')} || '.5 out of 5'", m_likes=f"{v('k % 9')} || '.5K'")
    cap = lx.PLATFORM_CAPS["news"]
    news = f"""(SELECT *, row_number() OVER (PARTITION BY company ORDER BY tier, site_ord, k, pos) AS r FROM (
        SELECT company, k, 0 AS tier, -1 AS site_ord, 1 AS pos, '' AS u, {card} AS body, NULL AS d, '' AS h FROM pg
        UNION ALL SELECT company, k, 0, -1, 2, 'https://www.' || site || '/news/' || {v('k')}, {head} || chr(10) || chr(10) || 'Snippet text ' || {v('k')},
          {v('k % 24')} || ' hours ago', {head} FROM pg
        UNION ALL SELECT company, k, 1, site2_ord, 1, 'https://www.' || site2 || '/story/' || {v('k')}, 'Story number ' || {v('k')} || ' in the paper', NULL,
          'Story number ' || {v('k')} || ' in the paper' FROM pg p WHERE site2_ord < 5 AND {cap} >
          (SELECT 2 * count(*) + count(*) FILTER (WHERE o.site2_ord < p.site2_ord) FROM pg o WHERE o.company = p.company)))"""
    add(f"{news} WHERE r <= {cap}", url="u", source_platform="'news'", position="r", item="0", m_type="'news_article'", raw_text="body", date_raw="d", m_headline="h")
    shop = f"'https://shop' || {v('k % 7')} || CASE WHEN k % 2 = 1 THEN '.lk' ELSE '.com' END || '/r/' || {v('k')}"
    snip = f"'Snippet for result ' || {v('k')} || CASE WHEN k % 4 = 0 THEN ' colombo' ELSE '' END"
    web_text = "coalesce(title, '') || chr(10) || chr(10) || coalesce(text, '')"
    web = f"""(SELECT *, row_number() OVER (PARTITION BY company ORDER BY place) AS r FROM (SELECT *, min(tier) OVER (PARTITION BY company) AS mt FROM (
        SELECT company, CASE WHEN search_engine = 'engine_a' THEN 0 ELSE 1 END AS tier, grp * 10 + result_pos AS place, source_url AS u, {_safe(web_text)} AS body,
          coalesce(title, '') AS t FROM web_fx
        UNION ALL SELECT company, 2, k, {shop}, 'Result title ' || {v('k')} || chr(10) || chr(10) || {snip}, 'Result title ' || {v('k')} FROM pg
        WHERE k % 2 = 1 OR k % 4 = 0)) WHERE tier = mt)"""
    add(f"{web} WHERE r <= {lx.PLATFORM_CAPS['web']}", url="u", source_platform="'web'", position="place", item="0", m_type="'web_result'", raw_text="body", m_title="t")
    return " UNION ALL ".join(parts)


CARDS = ("cards_fx", f"SELECT page_id, card_rank, source_url AS cards_fx_url, raw_text AS card_text, salary_info AS card_salary FROM ({ORACLE['src_job_cards']})")
CANON_TYPES = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in ("date_raw", "m_pros", "m_salary_info", "m_followers", "m_likes", "m_headline", "m_title", "m_parent_post"))
CANON = ("canon_fx", f"""
SELECT company, source_platform, {_case_map('source_platform', {p: i for i, p in enumerate(lx.PLATFORMS)}, 'NULL')} AS platform_ord,
  CAST(position AS BIGINT) AS position, CAST(item AS INTEGER) AS item, coalesce(source_url, '') AS source_url, raw_text, CAST(rating AS DOUBLE) AS rating,
  {_case_map('source_platform', __import__('renown.sources.canonical', fromlist=['x']).REVIEWER_TYPE, 'NULL')} AS reviewer_type, m_type, {CANON_TYPES}
FROM ({_canon_sql()})""")
CANON_EXTRA = [KEPT_COMMENTS, TAKEN, WEB_ROWS, PAGES_FX, CARDS, CANON]


@oracle("canonical_mentions", "forum_posts_fx", "forum_comments_fx", extra=CANON_EXTRA)
def _():
    return "SELECT * EXCLUDE (raw_text), md5(raw_text) AS text_md5 FROM canon_fx"


def _run_views() -> list[tuple[str, str]]:
    from renown.plans.end_to_end import RUN_CAPS
    order = "platform_ord, position, item"
    sentiment = f"CASE WHEN position % 50 = 7 OR position % 10 = 0 THEN 'neutral' ELSE ({arr(lx.SENTIMENTS)})[position % 3 + 1] END"
    return [
        ("capped_run", f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY company) AS extracted,
           row_number() OVER (PARTITION BY company, source_platform ORDER BY {order}) AS r FROM canon_fx) WHERE r <= {_case_map('source_platform', RUN_CAPS, 'NULL')}"""),
        ("flagged_run", f"SELECT m.*, {_relevant()} AS relevant, {geo_sql('m.raw_text', 'm.source_url')} AS geo_ok FROM capped_run m JOIN needles_fx n USING (company)"),
        ("valid_run", f"SELECT *, relevant AND (source_platform = 'topjobs' OR geo_ok) AS validated, {fp_sql('raw_text')} AS fp FROM flagged_run"),
        ("run_fx", f"""SELECT *, validated AND row_number() OVER (PARTITION BY company, fp, validated ORDER BY {order}) = 1 AS survivor,
           {analyzable_sql('raw_text')} AS ok FROM valid_run"""),
        ("kept_fx", f"SELECT *, {sentiment} AS sentiment, {crisis_sql('raw_text')} AS flags FROM run_fx WHERE survivor AND ok"),
    ]


@oracle("pipeline_report", "mentions_fx", "aliases_fx", "forum_posts_fx", "forum_comments_fx", extra=[NEEDLES, *CANON_EXTRA, *_run_views(), SUMMARY_RESP, SUMMARY_PARSED])
def _():
    score = score_sql("count(*)", "count_if(sentiment = 'positive')", "count_if(sentiment = 'negative')", "count_if(len(flags) > 0)")
    return f"""
    SELECT f.*, coalesce(s.overall_score, c.rule_score) AS overall_score, {band_sql('coalesce(s.overall_score, c.rule_score)')} AS score_band,
      c.total_results, c.n_sections, c.jobs, c.web_positive, coalesce(c.job_urls, '') AS job_urls,
      CASE WHEN c.company IS NULL THEN '' ELSE coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(s.crisis_flags, []), coalesce(c.all_flags, [])))), '|'), '') END AS crisis_flags
    FROM (
      SELECT company, any_value(extracted) AS extracted, count(*) AS raw, {cnt('NOT relevant')} AS irrelevant, {cnt('relevant AND NOT validated')} AS non_geo,
        {cnt('validated AND NOT survivor')} AS duplicates, {cnt('survivor AND NOT ok')} AS too_short, {cnt('survivor AND ok')} AS analyzed
      FROM run_fx GROUP BY company) f
    LEFT JOIN (
      SELECT company, count(*) AS total_results, count(DISTINCT source_platform) AS n_sections, {score} AS rule_score,
        {cnt("source_platform = 'topjobs'")} AS jobs, {cnt("source_platform = 'web' AND sentiment = 'positive'")} AS web_positive,
        flatten(list(flags)) AS all_flags,
        (SELECT string_agg(u, '|' ORDER BY a, b) FROM (SELECT source_url AS u, arg_min(position, position * 1000 + item) AS a, arg_min(item, position * 1000 + item) AS b
          FROM kept_fx k WHERE k.company = kept_fx.company AND source_platform = 'topjobs' GROUP BY source_url)) AS job_urls
      FROM kept_fx GROUP BY company) c USING (company)
    LEFT JOIN summary_parsed_fx s ON s.company = f.company AND c.company IS NOT NULL"""

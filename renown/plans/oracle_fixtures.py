"""DuckDB SQL for the adapter views (same rules as renown.plans.fixtures).

Each view is a CTE body; ``with_views(sql, names)`` prefixes a query with the
views it needs.  Text values and lexicons are rendered from the same Python
lists the Spark side uses.
"""

from __future__ import annotations

from renown.functions import lexicons as lx
from renown.plans.fixtures import ALIAS_TOKENS, EXTRA_ALIASES, FORUM_EPOCH0, N_COMPANIES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, idx: str) -> str:
    return f"({arr(values)})[({idx}) + 1]"


def company_name(idx: str) -> str:
    return f"('Company ' || lpad(CAST({idx} AS VARCHAR), 2, '0'))"


PY_SPACE = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"


def s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


_RATING = "CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE CAST(d.doc_id % 5 + 1 AS DOUBLE) END"

MENTIONS_FX = f"""
SELECT {company_name('d.doc_id % ' + str(N_COMPANIES))} AS company,
       d.doc_id AS seq,
       {pick(lx.PLATFORMS, 'd.doc_id % 8')} AS source_platform,
       'https://site' || {s('d.doc_id % 50')} || CASE WHEN d.doc_id % 3 = 0 THEN '.lk' ELSE '.com' END
         || '/p/' || {s('d.doc_id % 200')} AS source_url,
       d.text AS raw_text,
       strftime(DATE '2024-01-01' + CAST(d.doc_id % 730 AS INTEGER), '%Y-%m-%d') AS date_raw,
       {_RATING} AS rating,
       CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
       CAST(d.doc_id % 101 AS DOUBLE) / 100.0 AS confidence,
       {pick(lx.REVIEWER_TYPES, 'd.doc_id % 5')} AS reviewer_type,
       [{pick(lx.THEMES, 'd.doc_id % 12')}, {pick(lx.THEMES, '(d.doc_id * 7 + 3) % 12')}] AS themes,
       {pick(lx.SEVERITIES, 'd.doc_id % 4')} AS severity,
       d.lang AS language_detected,
       {{'subreddit': 'sub' || {s('d.doc_id % 3')},
        'score': CAST(d.doc_id % 50 AS DOUBLE),
        'num_comments': CAST(d.doc_id % 7 AS INTEGER),
        'type': CASE WHEN d.doc_id % 2 = 0 THEN 'post' ELSE 'comment' END,
        'parent_post': CAST(NULL AS VARCHAR),
        'star_rating': {_RATING},
        'review_count': CAST(d.doc_id % 97 AS INTEGER),
        'review_index': CAST(d.doc_id % 20 AS INTEGER),
        'pros': CASE WHEN d.doc_id % 6 <> 0 THEN 'pro ' || {s('d.doc_id % 11')} END,
        'cons': CASE WHEN d.doc_id % 6 <> 0 THEN 'con ' || {s('d.doc_id % 13')} END,
        'reviewer_role': 'role ' || {s('d.doc_id % 6')},
        'source_site': 'site' || {s('d.doc_id % 9')},
        'salary_info': CASE WHEN d.doc_id % 4 = 0 THEN 'LKR ' || {s('d.doc_id * 10')} END,
        'followers': CASE WHEN d.doc_id % 6 = 1 THEN {s('d.doc_id * 3')} END,
        'employees': CASE WHEN d.doc_id % 6 = 2 THEN {s('d.doc_id % 500')} END,
        'likes': CASE WHEN d.doc_id % 6 = 3 THEN {s('d.doc_id * 7')} END,
        'headline': CASE WHEN d.doc_id % 10 <> 0 THEN substring(d.text, 1, 40) END,
        'title': CAST(NULL AS VARCHAR),
        'search_engine': CAST(NULL AS VARCHAR),
        'position': CAST(NULL AS INTEGER)}} AS metadata
FROM documents d LEFT JOIN labels l USING (doc_id)
"""

_alias_rows = [(i, ALIAS_TOKENS[i % 12], f"Company {i:02d}") for i in range(N_COMPANIES)]
_alias_rows += [(N_COMPANIES + k, a, f) for k, (a, f) in enumerate(EXTRA_ALIASES)]
ALIASES_FX = "SELECT * FROM (VALUES " + ", ".join(f"({o}, {q(a)}, {q(f)})" for o, a, f in _alias_rows) + ") t(ord, alias, full_name)"


def _conf_text(i: str) -> str:
    return f"CASE WHEN {i} % 101 = 100 THEN '1.0' ELSE '0.' || lpad({s(i + ' % 101')}, 2, '0') END"


def _qq(x: str) -> str:
    return f"'\"' || {x} || '\"'"


_head = f"'{{\"sentiment\": ' || {_qq('m.sentiment')}"
_conf_num = f"', \"confidence\": ' || {_conf_text('m.seq')}"
_conf_str = f"', \"confidence\": ' || {_qq(_conf_text('m.seq'))}"
_rt = f"', \"reviewer_type\": ' || {_qq('m.reviewer_type')}"
_th = (f"', \"themes\": [' || {_qq('m.themes[1]')} || ', ' || {_qq('m.themes[2]')} || '], \"severity\": ' || "
       f"{_qq('m.severity')}")
_lang = f"', \"language_detected\": ' || {_qq('m.language_detected')} || '}}'"
_full = f"{_head} || {_conf_num} || {_rt} || {_th} || {_lang}"

RESPONSES_FX = f"""
SELECT m.seq,
       CASE m.seq % 10
         WHEN 0 THEN 'not json'
         WHEN 1 THEN '```json' || chr(10) || {_full} || chr(10) || '```'
         WHEN 2 THEN '[1]'
         WHEN 3 THEN {_head} || {_conf_num} || {_rt} || {_lang}
         WHEN 4 THEN {_head} || {_conf_str} || {_rt} || {_th} || {_lang}
         ELSE {_full} END AS response
FROM mentions_fx m WHERE m.seq % 50 <> 7
"""

FORUM_POSTS_FX = f"""
SELECT {company_name('conv_id % ' + str(N_COMPANIES))} AS company, conv_id,
       'sub' || {s('conv_id % 3')} AS subreddit,
       substring(text, 1, 40) AS title, text AS selftext,
       '/r/sub' || {s('conv_id % 3')} || '/comments/c' || {s('conv_id')} AS permalink,
       CAST({FORUM_EPOCH0} + conv_id * 86400 AS DOUBLE) AS created_utc,
       CAST(conv_id % 17 AS INTEGER) AS score, CAST(conv_id % 5 AS INTEGER) AS num_comments
FROM conversations WHERE turn = 0
"""

FORUM_COMMENTS_FX = f"""
SELECT p.company, p.conv_id, p.subreddit, p.title AS parent_title, c.turn,
       CASE WHEN (c.conv_id + c.turn) % 9 = 0 THEN '[deleted]' ELSE c.text END AS body,
       p.permalink || '/t' || {s('c.turn')} AS permalink,
       CAST({FORUM_EPOCH0} + c.conv_id * 86400 + c.turn * 60 AS DOUBLE) AS created_utc,
       CAST(c.turn * 3 AS INTEGER) AS score
FROM conversations c JOIN forum_posts_fx p USING (conv_id) WHERE c.turn >= 1
"""

SNAPSHOTS_FX = """
SELECT 'user_' || CAST(user_id AS VARCHAR) AS company, event_type AS source, ts AS cached_at,
       props AS payload, event_id AS seq FROM events
"""

USAGE_FX = """
SELECT 'user_' || CAST(user_id AS VARCHAR) AS company, event_type AS provider,
       'model-' || CAST(user_id % 3 AS VARCHAR) AS model, CAST(floor(value) AS BIGINT) AS tokens_used,
       CAST(1 AS BIGINT) AS calls_made, ts AS run_at FROM events
"""

VECTORS_FX = "SELECT CASE WHEN vec_id IS NOT NULL THEN 'all' ELSE 'none' END AS company, vec_id AS seq, embedding FROM embeddings"
DOCS_ONE_FX = "SELECT CASE WHEN doc_id IS NOT NULL THEN 'all' ELSE 'none' END AS company, doc_id AS seq, text AS raw_text FROM documents"

VIEWS = {
    "mentions_fx": MENTIONS_FX,
    "aliases_fx": ALIASES_FX,
    "responses_fx": RESPONSES_FX,
    "forum_posts_fx": FORUM_POSTS_FX,
    "forum_comments_fx": FORUM_COMMENTS_FX,
    "snapshots_fx": SNAPSHOTS_FX,
    "usage_fx": USAGE_FX,
    "vectors_fx": VECTORS_FX,
    "docs_one_fx": DOCS_ONE_FX,
}
DEPS = {
    "responses_fx": ["mentions_fx"],
    "forum_comments_fx": ["forum_posts_fx"],
}


def with_views(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({b})" for n, b in (extra or [])]
    if not ctes:
        return sql
    return "WITH " + ",\n".join(ctes) + "\n" + sql

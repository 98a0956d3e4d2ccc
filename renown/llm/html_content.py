"""Main-text extraction from HTML by tag-path ratios.

A page becomes text blocks (the text of a block-level element between the
boundaries of others), each with its root-to-leaf tag path.  Per path the text
outside links and its punctuation are summed and divided by the path's number
of blocks; the two ratios are fused (their product, log-scaled), carried to
the blocks, smoothed over neighbouring blocks, and blocks at or above the
threshold (a share of the mean smoothed ratio of the page) are content nodes.
The content region is the article or main element, or else the parent
elements, that hold content nodes; all of its blocks that are not lists of
links alone nor inside boilerplate elements (menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts, styles, hidden parts) form the text, in page order.
A class or id that names boilerplate does not count on an element that holds
most of the article's (else the page's) text outside links.
So a short paragraph or heading between long ones stays.

Cases: null or empty html gives an empty text; unclosed or cut markup is read
as far as it goes, an open comment, script or tag at the end is dropped; a
page of any length is handled in one row in time linear in its length;
repeated rows give equal results; extra columns are ignored; empty tables
give empty results; null page_id and url are kept.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>?|<[a-zA-Z/][^>]*\Z""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
PART = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")
BATCH = 128
SMOOTH = (0.25, 0.5, 0.25)
THRESHOLD = 0.5
MENU = 2  # items of a list of links alone

# fixed values: element names and name parts of boilerplate
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre search section summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button canvas audio video noembed noframes xmp".split())
CLOSES_P = BLOCKS - {"body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog dir search fieldset".split())
COMMENT_PARTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
BOILERPLATE_PARTS = COMMENT_PARTS | frozenset("""ad ads adv advert adverts advertisement advertisements adsense adbox banner sponsor
sponsored promo promotion promotions sidebar side nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar
footer bottombar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
signin share sharing social related recommended recommendations recommendation trending popular widget widgets pagination pager
copyright toolbar skip paywall feedback""".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())


class _Element:
    """``path`` is the number of the element's root-to-leaf path; ``named``:
    boilerplate by a part of its class or id alone; ``main``: the outermost
    article or main that it is or lies in; ``chars``: text outside links."""

    __slots__ = ("tag", "parent", "path", "flag", "named", "holds_main", "main", "chars", "out", "kept")

    def __init__(self, tag, parent, path, flag, named):
        self.tag, self.parent, self.path, self.flag, self.named = tag, parent, path, flag, named
        self.holds_main, self.chars, self.out, self.kept = False, 0, False, False
        self.main = parent and parent.main or (self if tag in ("article", "main") else None)


def _flag(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool, str]:
    """(boilerplate by its tag, role or style; by a part of its class or id;
    name with class)."""
    named = False
    flag = tag in BOILERPLATE_TAGS or (tag == "header" and not inside_main)
    name, found = tag, {}
    if attributes.strip("/ \t\r\n"):
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        parts = set(PART.findall(found.get("class", "") + " " + found.get("id", "")))
        if tag in ("article", "main"):
            flag |= bool(parts & COMMENT_PARTS)
        elif tag not in ("body", "html") and not (tag[0] == "h" and tag[1:].isdigit()):
            # a heading within the article is no page header
            named = bool(parts & (BOILERPLATE_PARTS - {"header"} if inside_main else BOILERPLATE_PARTS)) and not parts & COMMENT_PARTS
            flag |= bool(parts & COMMENT_PARTS)
        flag |= found.get("role", "") in BOILERPLATE_ROLES
        flag |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        if found.get("class"):
            name = f"{tag}.{found['class']}"
    return flag, named, name


def blocks(page: str) -> tuple[list[_Element], list[tuple[_Element, str, int]]]:
    """All elements, parents first, and (element, text, link characters) of
    every block with text, in order."""
    root = _Element("", None, 0, False, False)
    stack, out, elements, paths, opened = [root], [], [root], {}, {}
    text, linked, in_link, at = [], 0, 0, 0

    def flush():
        nonlocal text, linked
        said = " ".join(html.unescape("".join(text)).split())
        if said:
            out.append((stack[-1], said, linked))
        text, linked = [], 0

    def pop_to(i):
        flush()
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    def say(piece):
        nonlocal linked
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    while m := TOKEN.search(page, at):
        say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened.get(tag) else 0
                if i and not (tag == "p" and any(e.tag in ("div", "article", "section", "td", "li") for e in stack[i + 1:])):
                    pop_to(i)
                else:
                    flush()
            continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            in_link = 1
        elif tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag == "head":
            end = re.compile(r"</head\b[^>]*>|<body\b", re.IGNORECASE).search(page, at)
            at = len(page) if not end else end.end() if end[0][1] == "/" else end.start()
        elif tag in BLOCKS:
            flush()
            in_link = 0
            if tag in CLOSES_P:
                i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag != "p"), 0)
                pop_to(i + 1)
            scope = SCOPES.get(tag)
            if scope:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in SIBLINGS[tag]:
                        pop_to(i)
            if tag in VOID:
                continue
            up = stack[-1]
            flag, named, name = _flag(tag, m[3], up.main is not None)
            stack.append(_Element(tag, up, paths.setdefault((up.path, name), len(paths) + 1), flag, named))
            elements.append(stack[-1])
            opened[tag] = opened.get(tag, 0) + 1
            if tag in ("article", "main") and not flag:
                while up and not up.holds_main:
                    up.holds_main, up = True, up.parent
    say(page[at:])
    flush()
    return elements, out


def _mark_boilerplate(elements: list[_Element], found: list[tuple[_Element, str, int]]) -> None:
    """``out`` of every element.  A name alone makes no boilerplate of an
    element that holds most of the text outside links of its surroundings (the
    article's, else the page's): it is a wrapper."""
    for e, text, linked in found:
        e.chars += max(0, len(text) - linked)
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
    for e in elements[1:]:
        around = e.main.chars if e.main and e.main is not e else elements[0].chars
        wrapper = e.holds_main or 2 * e.chars > around
        e.out = e.parent.out or (e.flag and not e.holds_main) or (e.named and not wrapper)


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The main text of one page."""
    if not page:
        return ""
    elements, found = blocks(page)
    _mark_boilerplate(elements, found)
    found = [x for x in found if not x[0].out]
    if not found:
        return ""
    sums: dict[int, list[int]] = {}
    for e, text, linked in found:
        s = sums.setdefault(e.path, [0, 0, 0])
        s[0] += max(0, len(text) - linked)
        s[1] += len(PUNCTUATION.findall(text)) if linked < len(text) else 0
        s[2] += 1
    fused = {p: math.log1p(chars / n) * math.log1p(1 + marks / n) for p, (chars, marks, n) in sums.items()}
    own = [fused[e.path] for e, _, _ in found]
    padded = [own[0], *own, own[-1]]
    smooth = [sum(w * padded[i + j] for j, w in enumerate(SMOOTH)) for i in range(len(own))]
    least = threshold * sum(smooth) / len(smooth)
    for (e, text, linked), ratio in zip(found, smooth, strict=True):
        if ratio >= least and linked < len(text):
            _region(e).kept = True
    for e in elements[1:]:
        e.kept |= e.parent.kept
    # lists of links alone are menus wherever they stand
    menus = {p for p, (chars, _, n) in sums.items() if not chars and n >= MENU}
    return "\n".join(text for e, text, _ in found if e.kept and not (e.tag == "li" and e.path in menus))


def _region(e: _Element) -> _Element:
    """The outermost article or main around a block, else the parent of its element."""
    if e.main:
        return e.main
    return e.parent if e.parent and e.parent.tag not in ("", "html") else e


def extract_main_text(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per input row: page_id, url, text, n_chars (code points)."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                texts = [main_text(h.as_py(), threshold) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

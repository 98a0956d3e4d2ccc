"""HTML element extraction over a pages table.

One Python helper runs per partition (``mapInArrow``) with the standard
library ``html.parser``; everything after it (class/tag filters, caps,
regex extraction, joins) is native Spark.  The parser keeps an open-element
stack, so unclosed tags such as ``<p><b>...<br><p>`` nest instead of failing.
Text follows the usual "get text, stripped" rule: every text node is
stripped, empty ones are dropped, the rest are concatenated.  Script and
style contents and comments are not text.
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NON_TEXT = {"script", "style", "template"}
ERROR_TAG = "#error"
PIECE_ROWS, PIECE_CHARS = 1024, 1_000_000  # rows or text characters after which a batch is handed on

ELEMENT_SCHEMA = ("page_id long, pos int, end_pos int, parent_pos int, tag string, cls string, href string, "
                  "aria_label string, review_id string, test_id string, first_href string, depth int, "
                  "own_texts array<string>, text string, parse_error string")
FIELDS = ["page_id", "pos", "end_pos", "parent_pos", "tag", "cls", "href", "aria_label", "review_id", "test_id",
          "first_href", "depth", "own_texts", "text", "parse_error"]


class _Collector(HTMLParser):
    def __init__(self, keep: set[str] | None):
        super().__init__(convert_charrefs=True)
        self.keep = keep
        self.stack: list[dict] = []
        self.done: list[dict] = []
        self.pos = 0
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            for el in self.stack:
                if el["first_href"] is None:
                    el["first_href"] = a.get("href")
        if tag in VOID:
            return
        el = {"pos": self.pos, "tag": tag, "cls": a.get("class"), "href": a.get("href"),
              "aria_label": a.get("aria-label"), "review_id": a.get("data-review-id"),
              "test_id": a.get("data-testid") or a.get("data-test"), "first_href": None,
              "depth": len(self.stack), "parent_pos": self.stack[-1]["pos"] if self.stack else -1,
              "parts": [], "own": [], "kept": self.keep is None or tag in self.keep, "parse_error": None}
        self.pos += 1
        self.stack.append(el)
        if tag in NON_TEXT:
            self.skip += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] == tag:
                while len(self.stack) > i:
                    self._close(self.stack.pop())
                return

    def _close(self, el):
        el["end_pos"] = self.pos
        if el["tag"] in NON_TEXT:
            self.skip -= 1
        if el["kept"]:
            self.done.append(el)

    def handle_data(self, data):
        if self.skip:
            return
        if self.stack and data:
            self.stack[-1]["own"].append(data)
        s = data.strip()
        if s:
            # only elements that are emitted accumulate text
            for el in self.stack:
                if el["kept"]:
                    el["parts"].append(s)

    def finish(self):
        self.close()
        while self.stack:
            self._close(self.stack.pop())
        self.done.sort(key=lambda e: e["pos"])
        return self.done


def _error_row(e: Exception) -> dict:
    return {**dict.fromkeys(FIELDS), "pos": -1, "end_pos": -1, "parent_pos": -1, "depth": 0, "tag": ERROR_TAG, "own": [],
            "parts": [], "parse_error": f"{type(e).__name__}: {e}"}


def parse_elements(html: str, keep: set[str] | None) -> list[dict]:
    """Elements in document order.  Markup that the parser gives up on does
    not fail the job: the elements before it are followed by one row of tag
    ``#error`` whose ``parse_error`` names the fault."""
    c, failed = _Collector(keep), []
    try:
        c.feed(html or "")
    except Exception as e:
        failed = [_error_row(e)]
    try:
        return c.finish() + failed
    except Exception as e:
        while c.stack:
            c._close(c.stack.pop())
        return sorted(c.done, key=lambda x: x["pos"]) + (failed or [_error_row(e)])


SCHEMA = pa.schema([("page_id", pa.int64()), *((c, pa.int32()) for c in ("pos", "end_pos", "parent_pos")),
                    *((c, pa.string()) for c in ("tag", "cls", "href", "aria_label", "review_id", "test_id", "first_href")),
                    ("depth", pa.int32()), ("own_texts", pa.list_(pa.string())), ("text", pa.string()), ("parse_error", pa.string())])


def _elements_fn(keep: set[str] | None):
    """Pages are taken from the Arrow batch one by one and elements handed on
    in small batches, so a worker holds one batch of pages, one parsed page and
    ``PIECE_ROWS`` elements, however many pages a task has."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in FIELDS]
        chars = 0
        for batch in batches:
            for pid, html in zip(batch.column(0), batch.column(1)):
                pid = pid.as_py()
                for el in parse_elements(html.as_py(), keep):
                    el["page_id"], el["own_texts"], el["text"] = pid, el.pop("own"), "".join(el.pop("parts"))
                    for values, field in zip(columns, FIELDS):
                        values.append(el[field])
                    chars += len(el["text"]) + sum(map(len, el["own_texts"]))
                    if len(columns[0]) >= PIECE_ROWS or chars >= PIECE_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, SCHEMA)], schema=SCHEMA)
                        columns, chars = [[] for _ in FIELDS], 0
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, SCHEMA)], schema=SCHEMA)
    return fn


def html_elements(pages: DataFrame, tags=None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages(page_id, html) -> one row per element (of ``tags`` only, when
    given), in document order: position, extent (descendants have pos in
    (pos, end_pos)), parent position, tag, class, href, aria-label, review
    id, test id, first descendant link, depth, direct text children and the
    stripped text; see ``parse_elements`` for markup that cannot be parsed."""
    slim = pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string"))
    return slim.mapInArrow(_elements_fn(None if tags is None else set(tags)), ELEMENT_SCHEMA)


def class_matches(pattern: str):
    """Class attribute test: the pattern found in any single class token or
    in the whole attribute (case-insensitive search)."""
    cls = F.coalesce(F.col("cls"), F.lit(""))
    return cls.rlike(f"(?i){pattern}")

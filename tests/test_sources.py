"""Sources and sinks on hand-made payloads."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from renown.operators import entities as E
from renown.sources import exports as X
from renown.sources import forum as FO
from renown.sources import html as HT
from renown.sources import pages as PG
from renown.sources import websearch as WS


def test_alias_file_loader(spark):
    d = tempfile.mkdtemp(prefix="renown-alias-", dir="/tmp")
    good = os.path.join(d, "a.json")
    with open(good, "w") as f:
        json.dump({"JKH": "John Keells Holdings", "SLT": "Sri Lanka Telecom"}, f)
    rows = sorted(map(tuple, E.read_alias_json(spark, good).collect()))
    assert rows == [(0, "JKH", "John Keells Holdings"), (1, "SLT", "Sri Lanka Telecom")]
    assert E.read_alias_json(spark, os.path.join(d, "missing.json")).count() == 0


def test_forum_posts_and_comments(spark):
    post = {"data": {"children": [{"data": {"title": "T", "selftext": "", "permalink": "/r/x/1", "created_utc": 0.0,
                                            "score": 3, "num_comments": 2}}]}}
    comments = [{"data": {"children": []}},
                {"data": {"children": [{"data": {"body": b, "permalink": f"/c{i}", "created_utc": 60.0, "score": 1}}
                                       for i, b in enumerate(["a", "[deleted]", "", "b", "[removed]", "c", "d"])]}}]
    land = spark.createDataFrame([("co", json.dumps(post)), ("co", json.dumps(comments))], "company string, payload string")
    p = FO.extract_posts(land.limit(1)).collect()
    assert p[0]["raw_text"] == "T" and p[0]["source_url"] == "https://reddit.com/r/x/1"
    c = FO.extract_comments(land.where(F.col("payload").startswith("["))).collect()
    # the first five children are cut before the deleted/removed/empty filter
    assert sorted(r["raw_text"] for r in c) == ["a", "b"]


def test_comments_follow_their_posts(spark):
    posts = spark.createDataFrame([("co", i, 0, f"T{i}", "" if i == 2 else f"/p{i}") for i in range(6)],
                                  "company string, conv_id long, post_pos int, title string, permalink string")
    comments = spark.createDataFrame([("co", i, j) for i in range(9) for j in range(2)], "company string, conv_id long, comment_pos int")
    taken, kept = FO.taken_threads(posts, comments, cap=8)
    # 3 + 3 rows, then a post without a permalink (1 row), then the one that passes the cap
    assert sorted((r["conv_id"], r["n_comments"]) for r in taken.collect()) == [(0, 2), (1, 2), (2, 0), (3, 2)]
    assert sorted({(r["conv_id"], r["parent_post"]) for r in kept.collect()}) == [(0, "T0"), (1, "T1"), (3, "T3")]
    assert kept.count() == 6


def test_web_search_layouts(spark):
    a = {"results": [{"url": "u1", "title": "t1", "content": "c1", "score": 0.5}]}
    b = {"organic_results": [{"link": "u2", "title": "t2", "snippet": "s2", "position": 1}]}
    land = spark.createDataFrame([(json.dumps(a),), (json.dumps(b),)], "payload string")
    got = sorted((r["source_url"], r["raw_text"]) for r in WS.extract_results(land).collect())
    assert got == [("u1", "t1\n\nc1"), ("u2", "t2\n\ns2")]


def test_html_broken_nesting_and_cards(spark):
    html = ('<ul><li class="card">Senior Engineer Rs. 90,000<a href="/ad/1">x</a></li>'
            '<li class="card">No ads found here at all</li><li class="item">short</li></ul><p><b>open<br><p>more')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    el = HT.html_elements(pages)
    cards = el.where(HT.class_matches("card|listing|item|ad")).orderBy("pos").collect()
    assert [c["text"] for c in cards] == ["Senior Engineer Rs. 90,000x", "No ads found here at all", "short"]
    assert cards[0]["first_href"] == "/ad/1"


def test_text_nodes_and_parents_of_any_tag(spark):
    html = ('<dl><dt>Engineer at Acme</dt></dl><label>Clerk, <em>Acme</em></label>'
            '<p><strong><a href="https://www.linkedin.com/company/acme">Acme | 1,200 followers</a> of it</strong></p>')
    pages = spark.createDataFrame([(1, "Acme", html)], "page_id long, company string, html string")
    el = HT.html_elements(pages).join(pages.select("page_id", "company"), "page_id")
    assert [r["raw_text"] for r in PG.job_listings(el).orderBy("item_rank").collect()][:3] == ["Engineer at Acme", "Acme", "Acme | 1,200 followers"]
    assert "of it" in PG.profile_links(el).first()["raw_text"]


def test_parse_errors_are_rows(monkeypatch):
    def broken(self, tag, attrs):
        if tag == "bad":
            raise ValueError("no")
        return start(self, tag, attrs)

    start = HT._Collector.handle_starttag
    monkeypatch.setattr(HT._Collector, "handle_starttag", broken)
    got = HT.parse_elements("<div>a<p>b</p><bad>c", None)
    assert [(e["tag"], e["parse_error"]) for e in got][-1] == (HT.ERROR_TAG, "ValueError: no")
    assert {e["tag"] for e in got} >= {"div", "p"}


def test_news_cap_counts_per_company(spark):
    link = '<a href="https://{}/{}">A headline of some length</a>'
    sites = ["one.example", "two.example"]
    pages = spark.createDataFrame([(i, "co", "".join(link.format(s, i) for s in sites)) for i in range(4)], "page_id long, company string, html string")
    el = HT.html_elements(pages).join(pages.select("page_id", "company"), "page_id")
    arts = PG.news_articles(el)
    # the first site's four links reach the cap over all pages: the second site is not read
    links = PG.news_links(el, sites=sites, cap=4, already=arts)
    assert sorted(r["source_url"] for r in links.collect()) == [f"https://one.example/{i}" for i in range(4)]
    assert [r["source_url"] for r in PG.news_cascade(arts, links, cap=3).orderBy("cascade_rank").collect()] == [f"https://one.example/{i}" for i in range(3)]


def test_careers_link_precedence(spark):
    html = ('<a href="https://x.io/a">Explore</a><a href="https://boards.greenhouse.io/c">Apply</a>'
            '<a href="https://x.io/b">View jobs</a>')
    pages = spark.createDataFrame([(1, "https://acme.example/careers", html)], "page_id long, url string, html string")
    el = HT.html_elements(pages)
    assert PG.careers_link(el, pages).first()["careers_url"] == "https://boards.greenhouse.io/c"
    pages2 = spark.createDataFrame([(2, "https://acme.example/careers", html.replace("greenhouse.io", "example.org"))],
                                   "page_id long, url string, html string")
    # no tracking-system link: the last phrase link wins
    assert PG.careers_link(HT.html_elements(pages2), pages2).first()["careers_url"] == "https://x.io/b"


def test_csv_sink_and_header(spark):
    d = tempfile.mkdtemp(prefix="renown-csv-", dir="/tmp")
    df = spark.createDataFrame([("web", "u", "positive", 0.5, "general", ["a", "b"], None, "en", None, "text, with comma")],
                               "source_platform string, source_url string, sentiment string, confidence double, "
                               "reviewer_type string, themes array<string>, severity string, language_detected string, "
                               "date_raw string, raw_text string")
    X.write_csv(df, os.path.join(d, "out"))
    back = spark.read.option("header", True).csv(os.path.join(d, "out")).first()
    assert back["Themes"] == "a; b" and back["Raw Text (truncated)"] == "text, with comma" and back["Confidence"] == "0.5"


def test_elements_leave_the_worker_in_small_batches():
    import pyarrow as pa

    from renown.sources import html as HT

    page = "<div>" + "<p>some text</p>" * 300 + "</div>"
    pages = pa.RecordBatch.from_arrays([pa.array([1, 2, None, 4, 5, 6, 7, 8, 9, 10], pa.int64()), pa.array([page] * 9 + [None])], ["page_id", "html"])
    out = list(HT._elements_fn(None)(iter([pages, pages])))
    assert max(b.num_rows for b in out) <= HT.PIECE_ROWS == 1024
    assert sum(b.num_rows for b in out) == 18 * 301
    long = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["<p>" + "x" * HT.PIECE_CHARS + "</p>"] * 2)], ["page_id", "html"])
    assert [b.num_rows for b in HT._elements_fn(None)(iter([long]))] == [1, 1]

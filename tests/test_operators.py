"""Operators on hand-made rows and property checks."""

import random

from pyspark.sql import functions as F

from renown.operators import caps as CP
from renown.operators import classify as C
from renown.operators import dedup as D
from renown.operators import entities as E
from renown.operators import report as RP
from renown.operators import snapshots as SN


def test_normalize_company_alias_first_wins(spark):
    al = spark.createDataFrame([(0, "ABC", "Alpha"), (1, "abc", "Beta")], "ord int, alias string, full_name string")
    df = spark.createDataFrame([("  abc ",), ("wso2  labs",)], "name string")
    out = {r["name"]: r["company"] for r in E.normalize_company(df, "name", al).collect()}
    assert out["  abc "] == "Alpha"
    assert out["wso2  labs"] == "Wso2 Labs"


def test_tag_companies_equals_plain_search(spark):
    """Needles of every length, both join forms, letters beyond the BMP."""
    import random

    from renown.operators import entities as E
    rng = random.Random(11)
    letters = "abcÉé \n日😀x"
    pick = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, pick(rng.randint(0, 60))) for i in range(150)] + [(150, None), (151, ""), (152, "A"), (153, "aé")]
    needles = {f"c{i}": sorted({pick(rng.randint(1, 9)).lower() for _ in range(3)}) for i in range(40)}
    needles["long"] = [rows[3][1][2:30].lower(), rows[5][1].lower()]
    needles["none"] = ["", "not there at all"]
    texts = spark.createDataFrame(rows, "seq long, raw_text string")
    table = spark.createDataFrame(list(needles.items()), "company string, needles array<string>")
    want = sorted((i, c) for i, t in rows for c, ns in needles.items() if any(n and n in (t or "").lower() for n in ns))
    assert sorted(map(tuple, E.tag_companies(texts, table, few=1000).collect())) == want
    assert sorted(map(tuple, E.tag_companies(texts, table).collect())) == want  # broadcast index
    assert sorted(map(tuple, E.tag_companies(texts, table, max_broadcast=0).collect())) == want
    assert E.tag_companies(texts, table.limit(0)).count() == 0
    plan = E.tag_companies(texts, table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_parse_responses_statuses(spark):
    rows = [(1, "not json"), (2, "```json\n{\"sentiment\": \"negative\"}\n```"), (3, "[1]"),
            (4, "{\"confidence\": \"0.9\"}"), (5, None)]
    df = spark.createDataFrame(rows, "seq long, response string")
    out = {r["seq"]: r for r in C.parse_responses(df).collect()}
    assert out[1]["parse_status"] == "malformed"
    assert out[2]["parse_status"] == "ok" and out[2]["p_sentiment"] == "negative"
    assert out[3]["parse_status"] == "non_object"
    assert out[4]["p_confidence"] == 0.9
    assert out[5]["parse_status"] == "missing"


def test_rule_score(spark):
    df = spark.createDataFrame([(10, 3, 6, 1), (0, 0, 0, 0), (100, 29, 0, 0)], "t long, p long, n long, c long")
    got = [r[0] for r in df.select(RP.rule_score(F.col("t"), F.col("p"), F.col("n"), F.col("c"))).collect()]
    # 30 - 5 - 10; empty -> 50; int(29/100*100) == 28 after float error
    assert got == [15, 50, 28]


def greedy_brute(n, edges):
    nb = {}
    for a, b in edges:
        nb.setdefault(b, set()).add(a)
    kept = []
    ks = set()
    for i in range(n):
        if not (nb.get(i, set()) & ks):
            kept.append(i)
            ks.add(i)
    return kept


def test_greedy_survivors_matches_sequential(spark):
    rnd = random.Random(7)
    n = 120
    edges = sorted({(a, b) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(260)) if a < b})
    nodes = spark.createDataFrame([("c", i) for i in range(n)], "company string, seq long")
    e = spark.createDataFrame([("c", a, b) for a, b in edges], "company string, a long, b long")
    want = greedy_brute(n, edges)
    assert sorted(r["seq"] for r in D.greedy_rounds(nodes, e).where("kept").collect()) == want


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 10,000 and chains that hang on knots: equal to the
    sequential walk, with under 30 tables written each."""
    cuts, real = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: cuts.append(1) or real(df))
    knots = [(0, 2), (1, 2), (2, 3), (0, 3), (20, 40), (30, 40)] + [(i, i + 1) for i in range(3, 60)]
    for n, edges in ((61, knots), (10_001, [(i, i + 1) for i in range(10_000)])):
        earlier, kept = {}, set()
        for a, b in edges:
            earlier.setdefault(b, set()).add(a)
        for i in range(n):
            if not earlier.get(i, set()) & kept:
                kept.add(i)
        cuts.clear()
        got = D.greedy_rounds(spark.createDataFrame([("c", i) for i in range(n)], "company string, seq long"),
                              spark.createDataFrame([("c", a, b) for a, b in edges], "company string, a long, b long"))
        assert {r.seq for r in got.where("kept").collect()} == kept and len(cuts) < 30


def test_chain_is_not_connected_components(spark):
    nodes = spark.createDataFrame([("c", i) for i in range(12)], "company string, seq long")
    e = spark.createDataFrame([("c", i, i + 1) for i in range(11)], "company string, a long, b long")
    assert sorted(r["seq"] for r in D.greedy_rounds(nodes, e).where("kept").collect()) == [0, 2, 4, 6, 8, 10]


def test_failing_classifier_keeps_rows(spark):
    from renown.operators.classify import responses_from

    def broken(pdf):
        raise ValueError("no model")

    rows = responses_from(spark.createDataFrame([(1, "p"), (2, "q")], "seq long, prompt string"), broken).collect()
    assert sorted((r["seq"], r["response"]) for r in rows) == [(1, None), (2, None)]


def test_near_dup_pairs_blocked_equals_brute(spark):
    import numpy as np
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(5, 8))
    vecs = [base[i % 5] + rnd.normal(scale=0.2, size=8) for i in range(60)] + [np.zeros(8)]
    df = spark.createDataFrame([("c", i, [float(x) for x in v]) for i, v in enumerate(vecs)], "company string, seq long, embedding array<double>")
    got = sorted((r["a"], r["b"]) for r in D.near_dup_pairs(df, 0.85, block_rows=7).collect())
    u = [v / (np.linalg.norm(v) or 1.0) for v in vecs]
    want = sorted((i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if float(u[i] @ u[j]) > 0.85)
    assert got == want


def test_capped_threads_soft_cap(spark):
    posts = spark.createDataFrame([("c", i, n) for i, n in enumerate([4, 4, 4, 0, 9])], "company string, seq long, n_comments long")
    got = [r["seq"] for r in CP.capped_threads(posts, 10).orderBy("seq").collect()]
    # rows before each post: 0, 5, 10 -> the third post is not taken
    assert got == [0, 1]


def test_snapshot_ttl_and_age(spark):
    df = spark.createDataFrame([("Co", "web", "2024-01-29 00:00:00", "[1]", 1), ("co", "WEB", "2024-01-30 22:30:00", "[2]", 2),
                                ("x", "web", "2024-01-28 23:59:59", "[3]", 3)], "company string, source string, ts string, payload string, seq long")
    df = df.withColumn("cached_at", F.to_timestamp("ts")).drop("ts")
    latest = SN.snapshot_latest(df)
    assert {r["payload"] for r in latest.collect()} == {"[2]", "[3]"}
    fresh = {r["company"] for r in SN.snapshot_fresh(latest, "2024-01-31 00:00:00").collect()}
    assert fresh == {"co"}
    ages = {r["company"]: r["age_text"] for r in SN.snapshot_age(latest, "2024-01-31 00:00:00").collect()}
    assert ages["co"] == "1h 30m ago"


def test_rank_within_groups_hot_group(spark):
    from pyspark.sql import Window

    from renown.plans.strategy import rank_within_groups

    rows = [("hot", i % 7, i) for i in range(300)] + [("cold", i % 3, 1000 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, k long, seq long")
    got = rank_within_groups(df, ["g"], [F.col("k").desc(), F.col("seq").asc()], "r", num_partitions=9)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.col("k").desc(), "seq")))
    assert sorted(map(tuple, got.select("g", "seq", "r").collect())) == sorted(map(tuple, want.select("g", "seq", "r").collect()))


def test_hashed_embedder_exact_copies(spark):
    df = spark.createDataFrame([("c", 1, "the same words here"), ("c", 2, "The  same words HERE"), ("c", 3, "entirely different")],
                               "company string, seq long, raw_text string")
    v = D.hashed_text_vectors(df, num_features=64)
    pairs = [(r["a"], r["b"]) for r in D.near_dup_pairs(v, 0.85).collect()]
    assert pairs == [(1, 2)]


def test_clear_all_and_cached_reports(spark):
    df = spark.createDataFrame([("Co", "m1", "2024-01-30 12:00:00", '{"overall_score": 70}', 1),
                                ("co", "m2", "2024-01-30 18:00:00", '{"overall_score": 40}', 2),
                                ("Old", "m1", "2024-01-01 00:00:00", '{"overall_score": 10}', 3)],
                               "company string, source string, ts string, payload string, seq long")
    df = df.withColumn("cached_at", F.to_timestamp("ts")).drop("ts")
    assert SN.snapshot_clear(df).count() == 0
    got = {r["company"]: (r["model_used"], r["report"]["overall_score"])
           for r in SN.cached_reports(df, "2024-01-31 00:00:00", "overall_score int").collect()}
    assert got == {"co": ("m2", 40)}


def _toy_model(pdf):
    import pandas as pd

    out = []
    for s, p in zip(pdf["seq"], pdf["prompt"]):
        if "broken" in p:
            out.append(None)
        else:
            sent = "negative" if "bad" in p else "positive"
            out.append('{"sentiment": "%s", "confidence": 0.9, "themes": ["pricing"]}' % sent)
    return pd.DataFrame({"seq": pdf["seq"], "response": out})


def test_pluggable_classifier(spark):
    m = spark.createDataFrame([("c", 1, "a very bad product indeed", "customer"), ("c", 2, "a lovely product overall", None),
                               ("c", 3, "this one is broken text", "press"), ("c", 4, "short", None)],
                              "company string, seq long, raw_text string, reviewer_type string")
    got = {r["seq"]: r for r in C.classify_with(m, _toy_model).collect()}
    assert set(got) == {1, 2, 3}  # text under 10 chars is not analyzed
    assert got[1]["sentiment"] == "negative" and got[1]["reviewer_type"] == "customer"
    assert got[2]["themes"] == ["pricing"] and got[2]["confidence"] == 0.9
    assert got[3]["analysis_error"] == "missing_response" and got[3]["reviewer_type"] == "general"


def test_usage_append_and_totals(spark):
    import tempfile

    d = tempfile.mkdtemp(prefix="renown-usage-", dir="/tmp")
    u = spark.createDataFrame([("Co", "p", "m", 10, 2)], "company string, provider string, model string, tokens_used long, calls_made long")
    SN.usage_append(u, d)
    SN.usage_append(u, d)
    tot = {(r["provider"], r["model"]): (r["tokens"], r["calls"]) for r in SN.usage_totals(spark.read.parquet(d)).collect()}
    assert tot == {("p", "m"): (20, 4), ("*", "*"): (20, 4)}


def test_pluggable_summarizer(spark):
    import pandas as pd

    from renown.operators import summarize as SM

    def model(pdf):
        return pd.DataFrame({"company": pdf["company"],
                             "response": ['{"overall_score": %d, "top_5_pros": ["x"]}' % p.count("\n") for p in pdf["prompt"]]})

    c = spark.createDataFrame([("A", i, "positive", "employee", ["pricing"], "reddit", "some text here") for i in range(3)],
                              "company string, seq long, sentiment string, reviewer_type string, themes array<string>, "
                              "source_platform string, raw_text string")
    r = SM.summarize_with(c, model).first()
    # 'Summarize these 3 classified reviews:' + blank line + 3 lines -> 4 newlines
    assert r["overall_score"] == 4 and r["top_5_pros"] == ["x"] and r["summary_status"] == "ok"
